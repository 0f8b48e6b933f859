import hashlib
import math
import re

from pyspark.sql import functions as F

from gaugework.llm.sanitise import sanitise, span_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def check(frame):
    texts = sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())
    found = sorted(span_digest(sanitise(frame)).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == [i for i, _ in texts]
    for (_, text), row in zip(texts, found):
        spans = base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS], text
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert row["spans"] == joined or row["spans"].startswith(joined)


def test_base_spans_of_the_whole_table(spark, documents):
    check(documents)


def test_base_spans_of_hard_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x@y x@y.z.", "a@b@c.d", "..@-.-", "é😀 me@x.org 1.2.3.4.5.6.7.8", "1.2.3.256 0001.2.3.004 12345.1.2.3",
        "4111 1111-1111 1111 4111111111111112 4111  1111", "+1 (743) 555-3824) +12345678 +1((((((((2", "+1 234 567 890 123 456 7", "9" * 20_000,
        "a" * 30_000 + "@b.cc", "1-2 3" * 3000, "+1" + "(" * 20_000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1.", "+4111111111111111",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("term", F.lit(2)))


def disclosing(texts, generalise, min_texts):
    """(entity, term) -> share by brute force, for e-mail addresses only."""
    words, entities = [], []
    for text in texts:
        entities.append({m[0].lower() for m in re.finditer(PATTERNS["email"], text)})
        words.append({w.lower() for w in re.findall(r"[^\W_]+", re.sub(PATTERNS["email"], " ", text))})
    out = {}
    for e in set().union(*entities):
        at = [n for n, found in enumerate(entities) if e in found]
        for term in set().union(*(words[n] for n in at)):
            both = [n for n in at if term in words[n]]
            if len({texts[n] for n in both}) >= min_texts and len({texts[n] for n in at}) >= min_texts:
                mutual = math.log2(len(texts) * len(both) / (sum(term in w for w in words) * len(at)))
                share = mutual / math.log2(len(texts) / len(at))
                if share >= generalise:
                    out[e, term] = share
    return out


def test_terms_that_disclose_an_entity(spark):
    texts = [f"Quill wrote to bob@x.org about topic {n} in March" for n in range(6)]
    texts += [f"plain note {n} about weather in March and topic {n}" for n in range(60)] + ["Quill is mentioned here", "Quill wrote too"]
    texts += ["zebra only@once.org"] * 5  # copies of one text are no evidence
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sanitise(frame).collect()}
    expected = disclosing(texts, 0.85, 3)
    assert {term for _, term in expected} == {"quill", "wrote", "to"}
    row = rows[0]
    assert {s["value"].lower() for s in row["term_spans"]} == {"quill", "wrote", "to"}
    for span in row["term_spans"]:
        assert texts[0][span["start"] : span["end"]] == span["value"]
        share = expected["bob@x.org", span["value"].lower()]
        assert span["kind"] == ("removed" if share >= 0.95 else "generalised")
    assert row["sanitised"] == "[NAME] [TERM]  [EMAIL] about topic 0 in March"
    assert rows[67]["sanitised"] == texts[67] and rows[70]["sanitised"] == "zebra [EMAIL]"


def test_nulls_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a@b.cc"), (None, None), (2, "a@b.cc"), (2, "a@b.cc")], "doc_id long, text string")
    assert sorted(str(r["sanitised"]) for r in sanitise(frame).collect()) == ["None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    assert sanitise(frame.limit(0)).collect() == []
