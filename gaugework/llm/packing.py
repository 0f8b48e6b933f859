"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm.scratch import Scratch

#: Permitted sequence lengths in words.
CAPACITIES = (512, 1_024, 2_048, 4_096, 8_192)
#: Pieces that one task packs, on average. The loss at the end of a group is at most one bin.
GROUP_ROWS = 20_000


def default_cost(capacity: int) -> float:
    """What a sequence of this length costs: its places, and attention that grows with the square."""
    return capacity * (1 + capacity / 16_384)


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost=default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each item; items must fit the largest capacity.

    Longest items first, each into the open bin that it fills best. When none has room, a bin is opened of the size of least cost per
    place that items of this length would use. Besides, each permitted size is tried as the one that is opened wherever it has room. Every
    bin of a trial is cut down to the smallest size that holds its contents, and the cheapest trial counts.
    """
    sizes = sorted(set(capacities))
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order].tolist()
    price = {size: cost(size) for size in sizes}
    best = None
    for wanted in (None, *sizes):
        left_over = sum(sorted_lengths)
        rooms: list[tuple[int, int]] = []  # (free places, bin), ascending
        used: list[int] = []
        where, offset = [0] * len(sorted_lengths), [0] * len(sorted_lengths)
        for at, length in enumerate(sorted_lengths):
            found = bisect_left(rooms, (length, -1))
            if found < len(rooms):
                room, number = rooms.pop(found)
            else:
                fitting = [s for s in sizes if s >= length]
                if wanted is not None:
                    room = wanted if wanted >= length else fitting[0]
                else:
                    # What is left may be too little to fill a large bin.
                    room = min(fitting, key=lambda s: (price[s] / max(1, min(s // length * length, left_over)), s))
                number = len(used)
                used.append(0)
            where[at], offset[at] = number, used[number]
            used[number] += length
            left_over -= length
            if room > length:
                insort(rooms, (room - length, number))
        final = [sizes[bisect_left(sizes, total)] for total in used]
        total_cost = sum(price[size] for size in final)
        if best is None or total_cost < best[0]:
            best = (total_cost, where, offset, final)
    bins, offsets, capacity = (np.empty(len(lengths), np.int64) for _ in range(3))
    _, where, offset, final = best
    bins[order], offsets[order] = where, offset
    capacity[:] = np.array(final, np.int64)[bins] if len(lengths) else 0
    return bins, offsets, capacity


def _pack_group(capacities, cost):
    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets, sizes = pack(table.column("length").to_numpy().astype(np.int64), capacities, cost)
        first = TaskContext.get().partitionId() << 32
        added = [pa.array(first + bins), pa.array(offsets), pa.array(sizes)]
        for name, column in zip(("bin_id", "bin_offset", "capacity"), added):
            table = table.append_column(name, column)
        yield from table.to_batches(max_chunksize=10_000)

    return run


def word_count(text: Column) -> Column:
    """Words as separated by white space."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+")
    # Only the first and the last part can be empty.
    edge = lambda part, counts: F.when(counts & (part == ""), 1).otherwise(0)
    return F.size(parts) - edge(F.element_at(parts, 1), F.lit(True)) - edge(F.element_at(parts, -1), F.size(parts) > 1)


def pack_documents(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, cost=default_cost, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity): where each piece of ``docs`` (doc_id, text) goes.

    ``length`` gives a row's length (words of the text unless given). A row longer than the largest capacity is cut into pieces, so
    nothing is dropped. Pieces are dealt evenly over groups that are packed each by one task. Rows of length 0, null or empty texts, take
    no place: one row with piece 0 and no bin. Repeated rows are packed each; other columns are ignored; an empty table gives no
    rows. Lengths below 0 count as 0.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    scratch = Scratch(docs.sparkSession, "packing")
    most = max(capacities)
    measured = docs.select("doc_id", F.greatest(F.coalesce((length if length is not None else word_count(F.col("text"))).cast("bigint"), F.lit(0)), F.lit(0)).alias("whole"))
    pieces = measured.where("whole > 0").select("doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("whole") - 1) / most))).alias("piece"))
    start = F.col("piece") * most
    pieces = scratch.put(pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("whole") - start, F.lit(most)).alias("length"))
                         .unionByName(measured.where("whole = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("whole").alias("length"))))
    groups = max(1, math.ceil(pieces.where("length > 0").count() / group_rows))
    added = [T.StructField(name, T.LongType()) for name in ("bin_id", "bin_offset", "capacity")]
    # Round robin, so that no value can make a group large; Spark sorts first and so deals alike when a task is run again.
    packed = pieces.where("length > 0").repartition(groups).mapInArrow(_pack_group(tuple(capacities), cost), T.StructType([*pieces.schema.fields, *added]))
    none = [F.lit(None).cast("bigint").alias(name) for name in ("bin_id", "bin_offset", "capacity")]
    return packed.unionByName(pieces.where("length = 0").select("*", *none))
