"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, one line kept per component."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.components import link_buckets
from gaugework.llm.parity import FINE_WORDS, WORDS, marks, near, packed_bytes, unequal_bytes
from gaugework.llm.scratch import Scratch, small

#: Characters of a shingle, and the Jaccard similarity of lines that are one.
SHINGLE_CHARS, SIMILARITY = 7, 0.8
#: Bands and rows of a band: a pair at the similarity meets in some band with probability 1 - (1 - 0.8**4)**11 = 0.997. Lines of one
#: language have some hundredths of their shingles in common, and meet by chance with the fourth power of that.
BANDS, BAND_ROWS = 11, 4
#: Equal minima below which a pair is not compared: at the similarity 35 of 44 are equal, and fewer than 22 twice in a million pairs
#: if they are independent; of very short lines, for which they are less so, once in some thousand.
MIN_EQUAL = 22
SEED = 5
#: Neighbouring shingles whose least is taken before the grouped minimum, which costs more than a comparison.
BLOCK = 4
#: The columns of the minima's lowest bytes.
PRINT = [f"b{n}" for n in range(-(-BANDS * BAND_ROWS // 8))]

_SIDE = 4  # bytes of a character in UTF-32


def normal_line(line: Column) -> Column:
    """What is compared: the line without white space at its ends, in lower case."""
    return F.lower(F.btrim(line, F.lit(" \t\r\f\u000b ")))


def _shingle_hash(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at * _SIDE + 1, F.lit(SHINGLE_CHARS * _SIDE)))


def _positions(line: Column) -> Column:
    return F.greatest(F.length(line) - (SHINGLE_CHARS - 1), F.lit(1))


def shingles(line: Column) -> Column:
    """The line's shingles as hashes, repeats included; a shorter line is one shingle."""
    at = F.sequence(F.lit(0), _positions(line) - 1)
    return _once(F.encode(line, "UTF-32"), lambda wide: F.transform(at, lambda n: _shingle_hash(wide, n)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_shingles(line: Column) -> Column:
    return F.size(F.array_distinct(shingles(line)))


def jaccard(left: Column, right: Column) -> Column:
    """The Jaccard similarity of two lines' shingle sets."""
    sets = F.struct(shingles(left).alias("a"), shingles(right).alias("b"))
    return _once(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"])))


def _blocks(lines: DataFrame, width: int) -> DataFrame:
    """(id, last, h0, h1, ...): the shingles of ``lines`` (id, line) as hashes, so many neighbours a row; the last row repeats the last one,
    whose place in the line is ``last``."""
    wide = lines.select("id", F.encode("line", "UTF-32").alias("wide"), (_positions(F.col("line")) - 1).alias("last"))
    rows = wide.select("id", "wide", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(width))).alias("at"))
    hashes = [_shingle_hash(F.col("wide"), F.least(F.col("at") + i, F.col("last"))).alias(f"h{i}") for i in range(width)]
    return rows.select("id", "last", *hashes)


def band_keys(lines: DataFrame) -> DataFrame:
    """(id, keys, b0, b1, ...) of ``lines`` (id, line): a key for every band, and the lowest byte of each minimum.

    Minima of all shingles under the permutations h -> h xor c; repeats do not change them, so nothing has to be made distinct.
    """
    rng = random.Random(SEED)
    masks = [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS * BAND_ROWS)]
    blocks = _blocks(lines, BLOCK)
    least = [F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(mask)) for i in range(BLOCK)]) for mask in masks]
    signed = blocks.groupBy("id").agg(*[F.min(value).alias(f"m{n}") for n, value in enumerate(least)])
    keys = [F.xxhash64(F.lit(band), *[F.col(f"m{band * BAND_ROWS + row}") for row in range(BAND_ROWS)]) for band in range(BANDS)]
    return signed.select("id", F.array(*keys).alias("keys"), *packed_bytes([F.col(f"m{n}") for n in range(len(masks))]))


def _is_near(words: int) -> Callable[[str, str], Column]:
    """Whether two lines have enough minima in common, and their marks allow the similarity."""

    def test(a: str, b: str) -> Column:
        equal = BANDS * BAND_ROWS - unequal_bytes([(F.col(f"{word}_{a}"), F.col(f"{word}_{b}")) for word in PRINT])
        return (equal >= MIN_EQUAL) & near(SIMILARITY, words)(a, b)

    return test


def _facts(lines: DataFrame, words: int = WORDS) -> DataFrame:
    """Positions and marked places of the shingles of ``lines`` (id, line)."""
    return marks(_blocks(lines, BLOCK), words, [f"h{i}" for i in range(BLOCK)], F.max("last") + 1)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no, line, id) of every line that is not blank; id is the hash of the normalised line."""
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "digest", "line_no", normal_line(F.col("raw")).alias("line")).where("line <> ''").withColumn("id", F.xxhash64("line"))


def line_components(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of those of the distinct lines (id, line) that resemble another one."""
    signed = scratch.put(band_keys(distinct))
    entries = signed.select("id", F.explode("keys").alias("key"))
    repeated = scratch.put(entries.groupBy("key").count().where("count > 1").select("key"))
    met = scratch.put(entries.join(small(repeated), "key", "left_semi"))
    # Only lines that met another one are read again.
    ids = small(met.select("id").distinct())
    texts = scratch.put(distinct.select("id", "line").join(ids, "id", "left_semi"))
    prints = scratch.put(signed.select("id", *PRINT).join(ids, "id", "left_semi"))
    scratch.drop(signed, repeated)
    facts = scratch.put(_facts(texts).join(prints, "id"))

    def finer(ids: DataFrame) -> DataFrame:
        # The shingles are gone through once more for each line, which saves many of the pairs of lines that vary one template.
        return _facts(texts.join(small(ids), "id", "left_semi"), FINE_WORDS).join(prints, "id")

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("id").alias(side), F.col("line").alias(f"line_{side}")) for side in "ab")
        return pairs.join(left, "a").join(right, "b").where(jaccard(F.col("line_a"), F.col("line_b")) >= SIMILARITY)

    linked = link_buckets(met, verify, scratch, facts, _is_near(WORDS), (finer, _is_near(FINE_WORDS)))
    scratch.drop(met, texts, prints, facts)
    return linked


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text) without the lines that repeat another one, plus ``n_lines`` and
    ``n_dropped`` (int).

    Lines are what stands between line feeds. Two lines are alike if the Jaccard similarity of their character shingles is at least
    0.8 after trimming and lower-casing; of all lines connected that way the first by (doc_id, text hash, line number) stays as it
    was written. Blank lines are no content and stay. A line shorter than a shingle matches only its equals. Rows of the same doc_id and
    text are one document and are treated alike; a null doc_id comes first. A null text stays null with no lines; a text that
    loses every line becomes empty. Columns called n_lines or n_dropped are replaced. An empty table gives no rows.

    Lines are told apart by a 64-bit hash.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    place = F.struct("doc_id", "digest", "line_no")
    # Equal lines meet first, reduced before the shuffle. The rows stay where the signatures need them.
    distinct = _occurrences(docs).groupBy("id").agg(F.min("line").alias("line"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = distinct.persist(StorageLevel.MEMORY_AND_DISK)
    linked = line_components(distinct, scratch)
    # Of the lines that may go, the place of the one that stays.
    decided = distinct.select("id", "first", "n").join(linked, "id", "left").where("n > 1 or component is not null")
    decided = scratch.put(decided.select("id", "first", F.coalesce("component", "id").alias("component")))
    distinct.unpersist()
    winners = decided.groupBy("component").agg(F.min("first").alias("winner"))
    decided = decided.join(winners, "component").select("id", "winner")
    repeats = _occurrences(docs).select("doc_id", "digest", "line_no", "id").join(decided, "id").where(~place.eqNullSafe(F.col("winner")))
    drops = scratch.put(repeats.groupBy("doc_id", "digest").agg(F.collect_set("line_no").alias("gone")))
    # The caller's columns are kept apart from the names used here.
    text = F.col("row.text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drops = drops.select(F.col("doc_id").alias("drop_doc"), F.col("digest").alias("drop_digest"), "gone")
    # The same plan at all sizes: the lists are several times larger in memory than their files, by which a broadcast would be judged.
    joined = keyed.join(drops.hint("merge"), F.xxhash64(text).eqNullSafe(F.col("drop_digest")) & F.col("row.doc_id").eqNullSafe(F.col("drop_doc")), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains("gone", at)), "\n")
    columns = [F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(F.when(text.isNotNull(), lines)), F.lit(0)).alias("n_lines"), F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).alias("n_dropped"))
