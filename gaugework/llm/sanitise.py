"""Information-theoretic sanitisation of personal data.

Personal data of four kinds is found by pattern; each value is a protected entity. A term discloses an entity to the extent
that the corpus links the two: the pointwise mutual information of term and entity, over the documents they occur in,
against the information content of the entity itself. At a share of 1 the term occurs only together with the entity, so reading it
is as good as reading the entity. Terms beyond the thresholds are generalised or removed in the documents that hold the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.scratch import BROADCAST_ROWS, Scratch

KINDS = ("email", "ip", "card", "phone")
#: The patterns, leftmost and without overlap. Runs are taken whole and searched from their start only (or from where the last
#: match ended), which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What every match of a kind holds; texts without it are not searched.
SIGNS = {"email": "@", "phone": "+"}
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Term spans: generalised from this share of an entity's information on, removed from the second.
GENERALISE, REMOVE = 0.85, 0.95
#: Different texts holding term and entity together from which their counts are taken as they are; copies of one text are no
#: evidence. With fewer, each text counts once and one more text is supposed that holds the term without the entity.
MIN_TEXTS = 3
#: Bytes of the terms that a broadcast may hold at most.
BROADCAST_BYTES = 16 << 20
LETTER = r"[\p{L}\p{M}\p{N}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(turned, at, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(*CARD_DIGITS), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(*PHONE_DIGITS)
    return F.lit(True)


def _begins(lengths: Column) -> Column:
    """The sum of the lengths before each place: within blocks of about the cube root of their number, and over the blocks, so
    that no array grows step by step."""
    none = F.array().cast("array<int>")

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)

    def sums(bound: Column) -> Column:
        wide, numbers = bound["wide"], bound["numbers"]
        blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / wide).cast("int"))
        whole = F.transform(blocks, lambda n: total(F.slice(numbers, n * wide + 1, wide)))

        def of_block(both: Column) -> Column:
            def within(n: Column, whole: Column) -> Column:
                inner = F.slice(numbers, n * wide + 1, wide)
                return F.transform(F.array(F.struct(total(F.slice(whole, F.lit(1), n)).alias("before"), inner.alias("inner"))), lambda block: F.transform(block["inner"], lambda _, at: block["before"] + total(F.slice(block["inner"], F.lit(1), at))))

            return F.flatten(F.flatten(F.transform(both["blocks"], lambda n: within(n, both["whole"]))))

        return F.get(F.transform(F.array(F.struct(blocks.alias("blocks"), whole.alias("whole"))), of_block), F.lit(0))

    bound = F.struct(lengths.alias("numbers"), F.ceil(F.cbrt(F.size(lengths))).cast("int").alias("wide"))
    return F.when(F.size(lengths) > 0, F.get(F.transform(F.array(bound), sums), F.lit(0))).otherwise(none)


def _located(text: Column, matches: Column, pattern: Column, kind: Column) -> Column:
    """The matches, of which there is one at least, with their places in code points: what stands between them is what splitting leaves."""

    def spans(both: Column) -> Column:
        steps = F.transform(both["matches"], lambda match, n: F.length(F.get(both["gaps"], n)) + F.length(match))

        def placed(bound: Column) -> Column:
            def span(match: Column, n: Column) -> Column:
                begin = F.get(bound["begins"], n) + F.length(F.get(both["gaps"], n))
                return F.struct(kind.alias("kind"), begin.alias("start"), (begin + F.length(match)).alias("end"), match.alias("value"))

            return F.transform(both["matches"], span)

        return F.get(F.transform(F.array(F.struct(_begins(steps).alias("begins"))), placed), F.lit(0))

    # Bound once: inside the steps the text would be searched again for every match.
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches"))
    return F.get(F.transform(F.array(both), spans), F.lit(0)).cast(_SPAN)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text`` (null as empty) and ``__base``: the spans of the four kinds, by kind, then start."""
    named = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all("__text", F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains("__text", F.lit(SIGNS[kind])), found) if kind in SIGNS else found

    matched = named.withColumns({f"__{kind}": matches(kind) for kind in KINDS})

    def spans(kind: str) -> Column:
        # Only texts with a match that holds are split to find the places.
        located = _located(F.col("__text"), F.col(f"__{kind}"), F.lit(PATTERNS[kind]), F.lit(kind))
        some = F.exists(f"__{kind}", lambda match: _holds(kind, match))
        return F.when(some, F.filter(located, lambda s: _holds(kind, s["value"]))).otherwise(F.array().cast(_SPAN))

    return matched.withColumn("__base", F.concat(*[spans(kind) for kind in KINDS])).drop(*[f"__{kind}" for kind in KINDS])


def _rewritten(text: Column, spans: Column, put) -> Column:
    """The text with each span replaced by ``put(span, length)``; where spans overlap, the first one speaks for both."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(state["at"], span["start"])
        hidden = F.greatest(span["end"] - begin, F.lit(0))
        between = F.substring(text, state["at"] + 1, begin - state["at"])
        fill = F.when(span["start"] >= state["at"], put(span, hidden)).otherwise(put(None, hidden))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], between, fill).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces for the spans, so that places stay."""
    return _rewritten(text, spans, lambda span, length: F.repeat(F.lit(" "), length))


def _entity(span: Column) -> Column:
    """The protected value: numbers by their digits, addresses in lower case."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"{LETTER}+"), F.lit(0)))


def _bounded(terms: DataFrame) -> tuple[DataFrame, bool]:
    """The terms, marked for a broadcast if their number and bytes are proven small; and whether they are."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    fits = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    return (F.broadcast(terms) if fits else terms), fits


def disclosures(found: DataFrame, scratch: Scratch, generalise: float = GENERALISE, min_texts: int = MIN_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(class, term, share) for the terms that disclose an entity, and (entity, class) of every entity. ``found`` has doc_id,
    __digest, __text and __base.

    Entities found in the same texts have the same shares, so they are one class: a long list of values costs as much as one.
    """
    holding = found.where(F.size("__base") > 0)
    entities = F.array_distinct(F.transform("__base", _entity))
    held = scratch.put(holding.select("__digest", F.explode(entities).alias("entity")).groupBy("entity", "__digest").count())
    # Support is counted over different texts, probabilities over documents.
    same = F.xxhash64(F.count(F.lit(1)), F.bit_xor("__digest"), F.bit_xor(F.xxhash64("__digest")))
    known = scratch.put(held.groupBy("entity").agg(same.alias("class"), F.sum("count").alias("entity_docs")))
    members = held.join(known, "entity").select("__digest", "class").distinct()
    # Each text's terms with its number of documents: the words of a text are looked at once, however many hold it.
    blank = _blanked(F.col("__text"), F.col("__base"))
    texts = holding.select("__digest", blank.alias("blank")).groupBy("__digest").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"))
    texts = scratch.put(texts.select("__digest", "n", F.explode(_terms(F.col("blank"))).alias("term")))
    within = texts.groupBy("term").agg(F.sum("n").alias("within"))
    together = members.join(texts, "__digest").groupBy("class", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts"))
    total = F.lit(float(found.count()))

    def share(term_docs: Column) -> Column:
        rare = F.col("texts") < min_texts
        seen = F.when(rare, F.col("texts")).otherwise(F.col("both"))
        among = F.when(rare, term_docs - F.col("both") + F.col("texts") + 1).otherwise(term_docs)
        # An entity found in every document has no information to disclose.
        return F.try_divide(F.log2(total * seen / (among * F.col("entity_docs"))), F.log2(total / F.col("entity_docs")))

    facts = together.join(known.select("class", "entity_docs").distinct(), "class").join(within, "term")
    # A term is in no fewer documents than hold it beside an entity, and shares only fall with that number.
    facts = scratch.put(facts.where(share(F.col("within")) >= generalise))
    wanted, fits = _bounded(facts.select("term").distinct())
    # Documents without an entity hold the rest; a term is sent once for each task that meets it.
    outside = found.where(F.size("__base") == 0).select(F.explode(_terms(F.col("__text"))).alias("term"))
    outside = outside.join(wanted, "term", "left_semi") if fits else outside
    counted = outside.groupBy("term").agg(F.count(F.lit(1)).alias("without"))
    shares = facts.join(counted, "term", "left").withColumn("share", share(F.col("within") + F.coalesce("without", F.lit(0))))
    return scratch.put(shares.where(F.col("share") >= generalise).select("class", "term", "share")), known.select("entity", "class")


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text) plus ``base_spans``, ``term_spans`` (arrays of kind, start, end, value;
    code points, end exclusive) and ``sanitised``, the text with every span replaced.

    Personal data becomes its kind in brackets. A term is ``generalised`` (to the class of its shape) or ``removed`` by the
    share of an entity's information that it discloses. A null text counts as empty and stays null. A document only loses terms for entities
    that it holds itself. Rows of the same doc_id and text are treated alike. Columns named like the three added are replaced, all
    others stay, whatever their names. An empty table gives no rows.

    The texts are searched once, and written once beside what was found; only those that hold an entity are moved again.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    docs = docs.drop("base_spans", "term_spans", "sanitised")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    held = docs.select(row).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.text").alias("text"))
    found = with_base_spans(held).select("__row", "doc_id", F.xxhash64(F.col("text").cast("string")).alias("__digest"), "__base")
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    found = scratch.put(found).withColumn("__text", text)
    leaks, known = disclosures(found.select("doc_id", "__digest", "__text", "__base"), scratch, generalise, min_texts)
    holding = found.where(F.size("__base") > 0)
    entities = F.array_distinct(F.transform("__base", _entity))
    hit = holding.select(F.col("doc_id").alias("__doc"), F.col("__digest").alias("__own"), F.explode(entities).alias("entity"))
    hit = hit.join(known, "entity").select("__doc", "__own", "class").distinct().join(leaks, "class")
    hit = hit.groupBy("__doc", "__own", "term").agg(F.max("share").alias("share"))
    gone = F.collect_set(F.when(F.col("share") >= remove, F.col("term")))
    loose = F.collect_set(F.when(F.col("share") < remove, F.col("term")))
    hit = scratch.put(hit.groupBy("__doc", "__own").agg(gone.alias("__gone"), loose.alias("__loose")))
    joined = holding.join(hit, holding["doc_id"].eqNullSafe(hit["__doc"]) & (F.col("__digest") == F.col("__own")), "left")
    joined = joined.withColumn("__blank", F.when(F.col("__own").isNotNull(), _blanked(F.col("__text"), F.col("__base"))))

    def pattern(terms: str) -> Column:
        # Terms are letters and digits only, so they stand for themselves in a pattern.
        return F.concat(F.lit(f"(?i)(?<!{LETTER})(?:"), F.array_join(terms, "|"), F.lit(f")(?!{LETTER})"))

    def matches(terms: str) -> Column:
        return F.when(F.size(terms) > 0, F.regexp_extract_all("__blank", pattern(terms), F.lit(0)))

    def spans_of(terms: str, places: str, kind: str) -> Column:
        located = _located(F.col("__blank"), F.col(places), pattern(terms), F.lit(kind))
        return F.when(F.size(places) > 0, located).otherwise(F.array().cast(_SPAN))

    joined = joined.withColumns({"__at_loose": matches("__loose"), "__at_gone": matches("__gone")})
    joined = joined.withColumn("__term", F.concat(spans_of("__loose", "__at_loose", "generalised"), spans_of("__gone", "__at_gone", "removed")))

    def put(span: Column | None, length: Column) -> Column:
        if span is None:
            return F.lit("")
        shape = F.when(span["value"].rlike(r"\p{N}"), "[NUMBER]").when(span["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        return F.when(span["kind"] == "removed", "").when(span["kind"] == "generalised", shape).otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))

    def out(base: Column, term: Column, clean: Column) -> list[Column]:
        return [*[F.col("__row").getField(c).alias(c) for c in docs.columns], base.alias("base_spans"), term.alias("term_spans"), clean.alias("sanitised")]

    clean = F.when(F.col("__row.text").isNotNull(), _rewritten(F.col("__text"), F.concat("__base", "__term"), put))
    rest = found.where(F.size("__base") == 0)
    untouched = rest.select(*out(F.col("__base"), F.array().cast(_SPAN), F.col("__row.text").cast("string")))
    return untouched.unionByName(joined.select(*out(F.col("__base"), F.col("__term"), clean)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(sanitised: DataFrame) -> DataFrame:
    """doc_id, the counts by kind, base_sha256 and spans of :func:`sanitise`'s result."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    term = F.array_sort(F.transform("term_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    term = F.transform(term, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.concat(F.transform("base_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), term)
    return sanitised.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(both).alias("spans"))
