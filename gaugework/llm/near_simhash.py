"""SimHash near-duplicates over an inverted index of fingerprint bytes with count filtering.

The corpus pipeline drops near-duplicates by the Jaccard similarity of word shingles. At 0.8 some ten of 64 bits over all shingles
differ, and a byte of them survives once in four times. Its fingerprint has 64 bytes, each the majority over three shingles only, which
texts that share most of their shingles take alike; half of these bytes survive. Index, tally and an exact check then follow.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm.components import link_buckets
from gaugework.llm.parity import unequal_bytes
from gaugework.llm.scratch import Scratch, small

#: Words of a shingle, and bits by which linked fingerprints may differ.
SHINGLE_WORDS, MAX_BITS = 3, 2
SEED = 42
BYTES = 8
#: Two fingerprints within MAX_BITS bits agree in at least so many of the eight positions.
MIN_SHARED = BYTES - MAX_BITS
#: The pipeline's rule: words of a shingle, and the Jaccard similarity of two texts' shingle sets from which one is dropped.
TEXT_WORDS, TEXT_SIMILARITY = 5, 0.8
#: Bytes of the pipeline's fingerprint, shingles each is taken over, and bytes a key of the index joins, counted from its first one.
#: No two keys share two bytes.
PARTS, SAMPLE, JOINED = 64, 3, (0, 1, 3)
#: Equal bytes below which a pair is not compared: at the similarity 35 are equal, with a deviation of 4.
MIN_EQUAL = 16
WORDS = PARTS // BYTES


def _shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of all shingles of so many words; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if 0 < len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")


def fingerprint_of(text: bytes | None) -> int:
    """The fingerprint of one whole text as a signed 64-bit number; no words give zero.

    A-Z are lower-cased, words are split at ASCII white space, repeated shingles count each time.
    """
    hashes = _shingle_hashes(text, SHINGLE_WORDS)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view("<i8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints = pa.array([fingerprint_of(text) for text in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row."""
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), T.StructField("fingerprint", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, schema)


def _byte(position: int):
    return F.shiftrightunsigned(F.col("id"), 8 * position).bitwiseAND(F.lit(255))


def _postings(prints: DataFrame) -> DataFrame:
    """(key, id): the byte-position index.

    A list of one positional byte holds 1/256 of all rows, so lists are kept joined: of the four neighbouring
    byte pairs at most MAX_BITS are damaged, so any two fingerprints that reach MIN_SHARED positions share two whole pairs,
    and meet in one of the six lists of two pairs.
    """
    pairs = [(i, i + 1) for i in range(0, BYTES, 2)]
    keys = []
    for number, chosen in enumerate(combinations(pairs, len(pairs) - MAX_BITS)):
        key = F.lit(number).cast("bigint")
        for position in [p for pair in chosen for p in pair]:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "id")


def _verify(pairs: DataFrame) -> DataFrame:
    """Tallies the shared positional bytes, keeps pairs with enough of them, then counts the differing bits."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(F.when(F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(BYTES))
    return pairs.where(shared >= MIN_SHARED).where(F.bit_count(differ) <= MAX_BITS)


def _bits_near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _smallest_ids(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, component_id): the smallest doc_id of each id's component."""
    joined = distinct.join(linked, "id", "left").select("id", "first", F.coalesce("component", "id").alias("class"))
    smallest = joined.groupBy("class").agg(F.min("first").alias("component_id"))
    return joined.join(smallest, "class").select("id", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint string, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at most two differing bits, itself included.
    Documents without words (null and empty texts too) have fingerprint zero and link like any other. Rows of a
    null doc_id keep their place; they take the smallest known doc_id of their component, null if there is none. Repeated rows each give a
    row. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs))
    # Copies meet as one fingerprint; min() is reduced before the shuffle.
    distinct = scratch.put(prints.groupBy(F.col("fingerprint").alias("id")).agg(F.min("doc_id").alias("first")))
    linked = link_buckets(_postings(distinct), _verify, scratch, near=_bits_near)
    labels = _smallest_ids(distinct, linked).withColumnRenamed("id", "fingerprint")
    return prints.join(labels, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; all columns stay.

    Of rows that share a kept doc_id all stay only if they are in its component. Rows of a null doc_id stay only if their
    component has no doc_id.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = simhash_components(docs)
    # A document is kept by its own id; its text decides the component, so id and fingerprint are both compared.
    kept = scratch.put(found.where("doc_id <=> component_id").select("doc_id").distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors, their inverses and summands of PARTS permutations of 64-bit numbers, one a row."""
    rng = random.Random(SEED)
    pairs = [(rng.getrandbits(64) | 1, rng.getrandbits(64)) for _ in range(PARTS)]
    columns = [[f for f, _ in pairs], [pow(f, -1, 1 << 64) for f, _ in pairs], [c for _, c in pairs]]
    return tuple(np.array(column, dtype="<u8")[:, None] for column in columns)


def sampled_print(hashes: np.ndarray, permutations: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The PARTS fingerprint bytes of a set of shingle hashes.

    Byte n is a SimHash byte over the SAMPLE shingles that are first in the n-th permutation (all, if there are fewer): a bit is 1 if
    set in over half of their hashes.
    """
    factors, inverses, summands = permutations
    first = np.empty((PARTS, 0), dtype="<u8")
    # In blocks, so that a long text takes no more memory than a short one.
    for start in range(0, len(hashes), 4096):
        first = np.concatenate([first, hashes[start : start + 4096] * factors + summands], axis=1)
        if first.shape[1] > SAMPLE:
            first = np.partition(first, SAMPLE - 1, axis=1)[:, :SAMPLE]
    shifts = (np.arange(PARTS, dtype="<u8") % np.uint64(BYTES) * np.uint64(8))[:, None]
    parts = ((first - summands) * inverses >> shifts).astype(np.uint8)
    ones = np.unpackbits(parts[:, :, None], axis=2).sum(axis=1)
    return np.packbits(ones * 2 > parts.shape[1], axis=1).ravel()


def _print_batches(batches):
    permutations = _permutations()
    for batch in batches:
        ids, sizes, prints = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            hashes = np.unique(_shingle_hashes(text, TEXT_WORDS))
            ids.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63))
            sizes.append(len(hashes))
            prints.append(sampled_print(hashes, permutations).view("<i8"))
        words = [pa.array([row[n] for row in prints], pa.int64()) for n in range(WORDS)]
        columns = [batch.column("doc_id"), batch.column("digest"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *words]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "id", "size", *[f"x{n}" for n in range(WORDS)]])


def _part(n: int) -> Column:
    return F.shiftrightunsigned(F.col(f"x{n % PARTS // BYTES}"), n % BYTES * 8).bitwiseAND(F.lit(255))


def _part_postings(prints: DataFrame) -> DataFrame:
    """(key, id): the byte-position index of ``prints`` (id, x0 to x7), its lists joined three at a time.

    A list of one positional byte holds 1/256 of all rows, one of three 1/2**24. At the similarity a pair shares some eleven of the 64 keys.
    """
    keys = []
    for number in range(PARTS):
        key = F.lit(number).cast("bigint")
        for offset in JOINED:
            key = F.shiftleft(key, 8).bitwiseOR(_part(number + offset))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "id")


def _parts_near(a: str, b: str) -> Column:
    """Tallies the equal positional bytes; the sizes of sets that are too far apart cannot be similar enough."""
    size_a, size_b = F.col(f"size_{a}"), F.col(f"size_{b}")
    differ = unequal_bytes([(F.col(f"x{n}_{a}"), F.col(f"x{n}_{b}")) for n in range(WORDS)])
    return (F.least(size_a, size_b) >= F.greatest(size_a, size_b) * TEXT_SIMILARITY - 1e-6) & (PARTS - differ >= MIN_EQUAL)


def _set_batches(batches):
    for batch in batches:
        # One text at a time, so that a batch of long texts is not held twice.
        for row in range(batch.num_rows):
            text = batch.column("text").slice(row, 1).cast(pa.binary())[0].as_py()
            hashes = np.unique(_shingle_hashes(text, TEXT_WORDS)).view("<i8")
            offsets = pa.array([0, len(hashes)], pa.int32())
            arrays = [batch.column("id").slice(row, 1), pa.ListArray.from_arrays(offsets, pa.array(hashes))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "shingles"])


def similar_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, component_id) of every row of ``docs`` (doc_id, text); digest is the hash of the text.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8: candidates meet in the index of
    fingerprint bytes and have enough of them in common, and each is decided by its whole sets. Texts with equal sets are one, those without
    words too. Sets, texts and shingles are told apart by 64-bit hashes. ``component_id`` is as for :func:`simhash_components`.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))
    words = [f"x{n}" for n in range(WORDS)]
    longs = [T.StructField(name, T.LongType()) for name in ("digest", "id", "size", *words)]
    signed = scratch.put(rows.mapInArrow(_print_batches, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs])))
    distinct = scratch.put(signed.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("size", *words)]))
    entries = _part_postings(distinct.where("size > 0"))
    repeated = scratch.put(entries.groupBy("key").count().where("count > 1").select("key"))
    met = scratch.put(entries.join(small(repeated), "key", "left_semi"))
    facts = scratch.put(distinct.join(small(met.select("id").distinct()), "id", "left_semi").select("id", "size", *words))

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # One text of each set.
        wanted = distinct.join(small(ends), "id", "left_semi").select("id", "digest")
        texts = rows.select("digest", "text").join(small(wanted), "digest").groupBy("id").agg(F.first("text").alias("text"))
        sets = scratch.put(texts.mapInArrow(_set_batches, "id long, shingles array<long>"))
        left, right = (sets.select(F.col("id").alias(s), F.col("shingles").alias(f"shingles_{s}")) for s in "ab")
        both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("shingles_a", "shingles_b")))
        return both.where(F.col("shared") / (F.size("shingles_a") + F.size("shingles_b") - F.col("shared")) >= TEXT_SIMILARITY)

    labels = _smallest_ids(distinct.select("id", "first"), link_buckets(met, verify, scratch, facts, _parts_near))
    return signed.select("doc_id", "digest", "id").join(labels, "id").select("doc_id", "digest", "component_id")


def drop_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component of :func:`similar_components`; all columns stay.

    Rows alike in doc_id and text stay together. Rows of a null doc_id stay only if their component has no doc_id. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "similar-keep")
    found = similar_components(docs, scratch)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest")).distinct()
    kept = scratch.put(kept)
    own = F.xxhash64(F.col("text").cast("string"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__doc"]) & (own == kept["__digest"]), "left_semi")
