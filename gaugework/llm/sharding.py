"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt in two local permutations around one exchange. How many rows of each source part go to each shard is
drawn beforehand, with the law that a uniform permutation of all rows would give, so every part can place its rows
alone and the shard sizes come out exact.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
#: Rows that one task sorts, on average.
PART_ROWS = 50_000
SEED = 20_240_117
#: Bytes added to each row's text for its size.
ROW_BYTES = 16


def _draw(rng: random.Random, good: int, bad: int, taken: int) -> int:
    """One hypergeometric draw: how many of ``taken`` are good. Steps outward from the mode, so its time follows the spread."""
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, taken - mode) - log_choose(good + bad, taken))
    left = rng.random() - top
    up = down = mode
    p_up = p_down = top
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (taken - up) / ((up + 1) * (bad - taken + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - taken + down) / ((good - down + 1) * (taken - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(part_rows: list[int], shard_rows: list[int], seed: int = SEED) -> list[list[int]]:
    """Counts by part and shard with exactly these row and column sums, as a uniform permutation would have them."""
    if sum(part_rows) != sum(shard_rows):
        raise ValueError("parts and shards must hold the same number of rows")
    rng = random.Random(seed)
    open_rows = list(shard_rows)
    matrix = []
    for rows in part_rows:
        left, pool, counts = rows, sum(open_rows), []
        for shard, room in enumerate(open_rows):
            count = _draw(rng, room, pool - room, left)
            counts.append(count)
            open_rows[shard] -= count
            left -= count
            pool -= room
        matrix.append(counts)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A literal table in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _row_hash(frame: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.xxhash64(F.to_json(F.struct(c))) if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in frame.dtypes])


def shard_rows(frame: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``frame`` plus ``shard`` int and ``slot`` bigint, gapless from 0 in each shard.

    Shard sizes are at most one row apart, and the order over shards and slots is a uniform shuffle. Any values are
    allowed, nulls too; rows alike in all columns are interchangeable and each get a place of their own. Columns called ``shard`` or
    ``slot`` are replaced, other names never clash. An empty table gives no rows. The driver sees one count per part.
    """
    if not 1 <= shards:
        raise ValueError("shards must be at least 1")
    spark = frame.sparkSession
    body = frame.drop("shard", "slot")
    names = body.columns
    rows = body.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _row_hash(body, seed).alias("order1"), _row_hash(body, seed + 1).alias("order2"))
    total = frame.count()
    parts = max(1, math.ceil(total / part_rows))
    # Parts are chosen by content and not by task, so a part that is computed again holds the same rows.
    rows = rows.withColumn("part", F.pmod("order2", F.lit(parts)).cast("int"))
    counted = {row["part"]: row["count"] for row in rows.groupBy("part").count().collect()}
    sizes = [counted.get(part, 0) for part in range(parts)]
    matrix = communication_matrix(sizes, shard_sizes(total, shards), seed)
    ends = []
    for part, counts in enumerate(matrix):
        reach, sums = 0, []
        for count in counts:
            reach += count
            sums.append(reach)
        ends.append({"part": part, "ends": sums})
    matrix_table = _table(spark, ends, "part int, ends array<bigint>")

    # The first permutation, within the part: a row's rank says which shard's share it belongs to.
    local = Window.partitionBy("part").orderBy("order1", "order2")
    ranked = rows.withColumn("rank", F.row_number().over(local) - 1).join(matrix_table, "part")
    placed = ranked.withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("rank"))))

    # The exchange, and the second permutation. A shard may be larger than a task should sort, so it is cut by a
    # random number into pieces, whose offsets follow from their counts.
    pieces = max(1, math.ceil(total / shards / part_rows))
    second = F.xxhash64(F.lit(seed + 2), "order1", "order2")
    placed = placed.withColumn("order3", second).withColumn("piece", F.pmod(second, F.lit(pieces)).cast("int"))
    if pieces > 1:
        before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        offsets = placed.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
        placed = placed.join(offsets, ["shard", "piece"])
    else:
        placed = placed.withColumn("offset", F.lit(0).cast("bigint"))
    mixed = Window.partitionBy("shard", "piece").orderBy("order3", "order1", "order2")
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.row_number().over(mixed) - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """``docs`` (doc_id, text) with ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law`` = rows, ``shard``,
    ``slot`` and ``grown_shard`` (null: the law of rows moves rows freely when a shard is added).

    A null text counts as no bytes. See :func:`shard_rows` for the other cases.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.drop("size", "text_crc32", "law", "grown_shard")
    return shard_rows(body, shards, **options).select(
        "*", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"),
    )
