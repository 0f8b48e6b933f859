"""Approximate nearest neighbours by collision counting with query-centred windows.

Every vector is projected on a number of random lines. For one line, the vectors are held as an array sorted by
projection; a query's window on it is a run around its own projection. A vector collides where it lies in the window.
Windows widen step by step (virtual rehashing: no table is built again) and only their new margins are counted; vectors
with enough collisions are verified on the original vectors. Inner products become distances by one further coordinate that
lifts all vectors to the same length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.scratch import Scratch
from gaugework.llm.vectors import matrix, unit, usable

NEIGHBOURS = 20
#: Random lines (at most 255: collisions are counted in bytes) and runs into which each sorted array is cut.
LINES, RUNS = 128, 64
#: Share of the lines on which a vector has to collide.
COLLISIONS = 0.5
#: Windows start at this share of the median distance of projections, and widen by the factor.
FIRST_WINDOW, WIDEN = 0.75, 1.12
#: In a block, windows widen until this share of it, and so many vectors for each neighbour wanted, were verified. The
#: README has the recall measured.
VERIFIED, VERIFIED_EACH = 0.2, 40
BLOCK_ROWS, QUERY_ROWS = 8_192, 2_048
#: Queries of a block from which the first window of the others is taken.
PILOT = 32
SEED = 11


class SortedLines:
    """The sorted projections of one block of vectors.

    Each sorted array is cut into runs, and for each cut the vectors before it are kept as a row of bytes. The vectors
    between two cuts are then the difference of two such rows, so a window is tallied without touching its vectors one by
    one. Window ends are widened to the next cut.
    """

    def __init__(self, rows: np.ndarray, length: float, seed: int = SEED):
        rng = np.random.default_rng(seed)
        count = len(rows)
        self.rows = rows
        self.lines = rng.standard_normal((rows.shape[1] + 1, LINES))
        lift = np.sqrt(np.maximum(length * length - np.einsum("ij,ij->i", rows, rows), 0))
        points = np.column_stack([rows, lift]) / length @ self.lines
        order = np.argsort(points, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(points, order, axis=0).T)
        self.run = max(1, math.ceil(count / RUNS))
        cuts = math.ceil(count / self.run)
        self.before = np.zeros((LINES, cuts + 1, count), np.uint8)
        for line in range(LINES):
            place = np.empty(count, np.int64)
            place[order[:, line]] = np.arange(count)
            self.before[line] = place[None, :] < (np.arange(cuts + 1) * self.run)[:, None]
        self.step = FIRST_WINDOW * max(float(np.median(np.abs(points - np.median(points, axis=0)))), 1e-12)
        self.farthest = float(np.abs(points).max())

    def search(self, queries: np.ndarray, wanted: int):
        """Yields for each query its number and the numbers of the vectors to verify."""
        own = unit(queries)
        centre = np.column_stack([own, np.zeros(len(own))]) @ self.lines
        enough = min(len(self.rows), max(VERIFIED_EACH * wanted, math.ceil(VERIFIED * len(self.rows))))
        limit = self.farthest + float(np.abs(centre).max())
        # No query ends much before the others do, so the rest starts with the narrowest window that was enough for the first ones.
        first, ends = np.arange(min(PILOT, len(queries))), []
        for query, found, reach in self._widened(centre, first, self.step, enough, limit):
            ends.append(reach)
            yield query, found
        for query, found, _ in self._widened(centre, np.arange(len(first), len(queries)), min(ends, default=self.step), enough, limit):
            yield query, found

    def _widened(self, centre: np.ndarray, open_: np.ndarray, reach: float, enough: int, limit: float):
        """Each query with its vectors and the window with which they were enough."""
        threshold, every = math.ceil(COLLISIONS * LINES), np.arange(LINES)
        while len(open_):
            low, high = (np.empty((len(open_), LINES), np.int64) for _ in range(2))
            for line in every:
                low[:, line] = np.searchsorted(self.sorted[line], centre[open_, line] - reach, "left") // self.run
                high[:, line] = -(-np.searchsorted(self.sorted[line], centre[open_, line] + reach, "right") // self.run)
            still = []
            for at, query in enumerate(open_):
                # The difference of the two sums fits a byte although the sums wrap around.
                tally = self.before[every, high[at]].sum(axis=0, dtype=np.uint8) - self.before[every, low[at]].sum(axis=0, dtype=np.uint8)
                found = np.nonzero(tally >= threshold)[0]
                if len(found) >= enough or reach > limit:
                    yield query, found, reach
                else:
                    still.append(query)
            open_, reach = np.array(still, np.int64), reach * WIDEN


def _best(scores: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """The places of the largest scores, ties to the smaller id; only those that reach the last of them are sorted."""
    if len(scores) > wanted:
        near = np.nonzero(scores >= np.partition(scores, -wanted)[-wanted])[0]
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:wanted]]


def _search_block(width: int, largest: float, length: float, wanted: int):
    def run(table):
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        rows = matrix(table.column("vector"), width)
        ids, row_ids = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        # In the order of the rows, whatever order they came in, so that a task run again finds the same.
        order = np.argsort(row_ids, kind="stable")
        here, asked = order[~is_query[order]], order[is_query[order]]
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(here) and len(asked):
            index = SortedLines(rows[here] / largest, length)
            for number, found in index.search(rows[asked], wanted + 1):
                query = asked[number]
                found = here[found]
                found = found[ids[found] != ids[query]]
                scores = np.einsum("ij,j->i", rows[found], rows[query])
                best = _best(scores, ids[found], wanted)
                out["query_row"].append(np.full(len(best), row_ids[query]))
                out["query_id"].append(np.full(len(best), ids[query]))
                out["vec_id"].append(ids[found][best])
                out["score"].append(scores[best])
        kinds = {"query_row": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({name: np.concatenate(parts).astype(kinds[name]) if parts else np.empty(0, kinds[name]) for name, parts in out.items()})

    return run


def nearest(vectors: DataFrame, is_query: Column, wanted: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds, the ``wanted`` others of largest inner
    product that are found, ties to the smaller vec_id.

    Every row is indexed, in blocks; each query block meets each of them, and the best of the blocks are merged.
    Rows whose vec_id is null or whose vector is null, empty, zero or not finite take no part. Vectors of different lengths are
    compared as if filled with zeros. Rows that share the query's vec_id are its own and are left out; repeated rows of one query
    are asked once. Fewer candidates than ``wanted`` are all returned; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = scratch.put(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()))
    entry = F.array_max(F.transform("vector", F.abs))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q"), F.max(F.size("vector")).alias("width"), F.max(entry).alias("largest")).first()
    # The index holds the vectors by the largest entry of all, so that no square leaves the range; scores are of the vectors themselves.
    largest = facts["largest"] or 1.0
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    length = math.sqrt(rows.agg(F.max(square)).first()[0] or 1.0)
    result = "query_row bigint, query_id bigint, vec_id bigint, score double"
    blocks, parts = max(1, math.ceil(facts["n"] / block_rows)), max(1, math.ceil(facts["q"] / query_rows))
    mixed = F.xxhash64("row")
    index = rows.select("vec_id", "vector", "row", F.lit(False).alias("is_query"), F.pmod(mixed, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    queries = rows.where("asked").dropDuplicates(["vec_id", "vector"])
    queries = queries.select("vec_id", "vector", "row", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(mixed, F.lit(parts)).cast("int").alias("part"))
    found = index.unionByName(queries).groupBy("block", "part").applyInArrow(_search_block(facts["width"] or 1, largest, length, wanted), result)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
