"""Near-duplicate embeddings by tiles in the order of their principal components.

Vectors are turned so that the leading coordinates carry most of their length. A tile pair accumulates products over the
leading coordinates; what is left of a pair's cosine is at most the product of the two remaining norms, so most
pairs stop early, and only those that can still reach the threshold are carried on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.components import connected_components
from gaugework.llm.scratch import Scratch
from gaugework.llm.vectors import matrix, unit, usable

THRESHOLD = 0.95
TILE_ROWS = 8_192
#: Rows of the square blocks in which a pair of tiles is compared, and pairs carried on at a time.
BLOCK_ROWS, PAIR_BATCH = 1_024, 65_536
#: Coordinates of a tile's bounding box, and those by which tiles are ordered.
BOX_AXES, ORDER_AXES = 6, 3
#: Coordinates after which the bound is looked at; the last stage takes all.
STAGES = (16, 32)
ROUNDING = 1e-9


def _moments(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = unit(matrix(batch.column("vector"), width))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["entry", "value"])

    return run


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Axes of the uncentred second moment over all unit vectors, the strongest first; the driver sees width² sums."""
    sums = nodes.select("vector").mapInArrow(_moments(width), "entry bigint, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    moment = np.zeros(width * width)
    for row in sums.collect():
        moment[row["entry"]] = row["value"]
    _, axes = np.linalg.eigh(moment.reshape(width, width))
    return axes[:, ::-1]


def _projected(axes: np.ndarray, reach: float):
    width = len(axes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = unit(matrix(batch.column("vector"), width)) @ axes[:, :BOX_AXES]
            lead = np.pad(lead, ((0, 0), (0, BOX_AXES - lead.shape[1])))
            columns = [batch.column("node"), batch.column("vector"), batch.column("copies")]
            columns += [pa.array(np.floor(lead[:, axis] / reach).astype(np.int32)) for axis in range(ORDER_AXES)]
            columns += [pa.array(np.ascontiguousarray(lead[:, axis])) for axis in range(BOX_AXES)]
            names = ["node", "vector", "copies", *[f"c{a}" for a in range(ORDER_AXES)], *[f"y{a}" for a in range(BOX_AXES)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _tiles(nodes: DataFrame, axes: np.ndarray, reach: float, count: int, tile_rows: int, scratch: Scratch) -> DataFrame:
    """Nodes with their tile: runs of ``tile_rows`` rows in the order of the leading coordinates."""
    cells = [f"c{a}" for a in range(ORDER_AXES)]
    schema = ", ".join(["node bigint, vector array<double>, copies bigint", *[f"{c} int" for c in cells], *[f"y{a} double" for a in range(BOX_AXES)]])
    keys = [*cells, "y0", "node"]
    ordered = nodes.mapInArrow(_projected(axes, reach), schema).repartitionByRange(max(1, math.ceil(count / tile_rows)), *keys).sortWithinPartitions(*keys)
    # The id counts up inside a partition; once written it no longer changes.
    ordered = scratch.put(ordered.withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("run", F.shiftright("at", 33))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    starts = starts.select("run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("at") - F.col("first")
    return ordered.join(starts, "run").withColumn("tile", F.floor(rank / tile_rows).cast("int")).drop("run", "at", "first", "start", *cells)


def _tile_pairs(tiled: DataFrame, reach: float) -> DataFrame:
    """(a, b) with a <= b for tiles whose bounding boxes come within reach of each other."""
    axes = range(BOX_AXES)
    boxes = tiled.groupBy("tile").agg(*[F.min(f"y{a}").alias(f"lo{a}") for a in axes], *[F.max(f"y{a}").alias(f"hi{a}") for a in axes])

    def over(low, high):
        return F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("cell")

    left = boxes.select("*", over(F.col("lo0"), F.col("hi0")))
    right = boxes.select(F.col("tile").alias("b"), *[F.col(f"{e}{a}").alias(f"b{e}{a}") for e in ("lo", "hi") for a in axes], over(F.col("lo0") - reach, F.col("hi0") + reach))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"bhi{a}"), F.col(f"blo{a}") - F.col(f"hi{a}")), F.lit(2)) for a in axes)
    near = left.join(right, "cell").where(gap <= reach * reach + ROUNDING).select("tile", "b")
    return near.select(F.least("tile", "b").alias("a"), F.greatest("tile", "b").alias("b")).distinct()


def near_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Yields index arrays (i, j) of rows of the two sets whose cosine reaches the threshold; with ``same`` only i < j."""
    unit_left, unit_right = unit(left), unit(right)
    turned_left, turned_right = unit_left @ axes, unit_right @ axes
    width = len(axes)
    stages = [s for s in STAGES if s < width] + [width]

    def tails(rows):
        squares = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
        return {s: np.sqrt(squares[:, s]) if s < width else np.zeros(len(rows)) for s in stages}

    tail_left, tail_right = tails(turned_left), tails(turned_right)
    lead, low = stages[0], threshold - ROUNDING
    for top in range(0, len(left), BLOCK_ROWS):
        for start in range(top if same else 0, len(right), BLOCK_ROWS):
            a, b = slice(top, top + BLOCK_ROWS), slice(start, start + BLOCK_ROWS)
            begun = turned_left[a, :lead] @ turned_right[b, :lead].T
            rows, cols = np.nonzero(begun + np.multiply.outer(tail_left[lead][a], tail_right[lead][b]) >= low)
            begun = begun[rows, cols]
            rows, cols = rows + top, cols + start
            if same:
                upper = rows < cols
                rows, cols, begun = rows[upper], cols[upper], begun[upper]
            for at in range(0, len(rows), PAIR_BATCH):
                i, j, product = (x[at : at + PAIR_BATCH] for x in (rows, cols, begun))
                for since, stage in zip(stages, stages[1:]):
                    product = product + np.einsum("ij,ij->i", turned_left[i, since:stage], turned_right[j, since:stage])
                    open_ = product + tail_left[stage][i] * tail_right[stage][j] >= low
                    i, j, product = i[open_], j[open_], product[open_]
                exact = np.einsum("ij,ij->i", unit_left[i], unit_right[j]) >= threshold
                if exact.any():
                    yield i[exact], j[exact]


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of linked rows; labels point to the smallest row of a class."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _compare(axes: np.ndarray, threshold: float):
    width = len(axes)

    def run(key, table):
        a, b = (k.as_py() for k in key)
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        node, copies, tile = (table.column(c).to_numpy() for c in ("node", "copies", "tile"))
        rows = matrix(table.column("vector"), width)
        left, right = np.nonzero(tile == a)[0], np.nonzero(tile == b)[0]
        links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, j in near_pairs(rows[left], rows[right], axes, threshold, a == b):
            i, j = left[i], right[j]
            links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
            _merge(labels, i, j)
        found = links > 0
        return pa.table({"node": node[found], "links": links[found], "root": node[labels][found]})

    return run


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows with a cosine of at least ``threshold``; ``component_id`` is the smallest vec_id
    reachable over links. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors
    of different lengths are compared as if filled with zeros. Repeated rows each count; a null vec_id links like others but names no
    component, unless it is alone. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).withColumn("ok", usable(F.col("vector")))
    good = rows.where("ok")
    # Equal vectors meet as one node that stands for its copies.
    nodes = scratch.put(good.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return alone
    axes = principal_axes(nodes, size["width"])
    reach = math.sqrt(max(2 - 2 * threshold, 0.0)) + ROUNDING
    tiled = scratch.put(_tiles(nodes.select("node", "vector", "copies"), axes, reach, size["n"], tile_rows, scratch))
    pairs = scratch.put(_tile_pairs(tiled, reach))
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    dealt = tiled.select("tile", "node", "copies", "vector").join(sides, "tile")
    found = dealt.groupBy("a", "b").applyInArrow(_compare(axes, threshold), "node bigint, links bigint, root bigint")
    found = scratch.put(found)
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = (
        nodes.join(counts, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left")
        .select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    )
    smallest = labelled.groupBy("class").agg(F.min("first").alias("component_id"))
    labels = labelled.join(smallest, "class").select("vector", "n_links", "component_id")
    linked = good.join(labels, "vector").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
