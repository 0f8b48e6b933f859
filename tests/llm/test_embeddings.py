import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm.near_embeddings import embedding_components, near_pairs
from gaugework.llm.neighbours import nearest


def _vectors(rng, groups, size, width=24):
    rows = []
    for _ in range(groups):
        base = rng.standard_normal(width)
        rows += [base * rng.uniform(0.5, 4) + rng.standard_normal(width) * rng.uniform(0.02, 0.3) for _ in range(size)]
    return np.array(rows + [rows[0], rows[0] * 3])


def _expected(ids, vectors, classes, threshold=0.95):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in zip(ids, vectors) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    groups, links = classes(ids), dict.fromkeys(ids, 0)
    for a in unit:
        for b in unit:
            if a < b and unit[a] @ unit[b] >= threshold:
                groups.link(a, b)
                links[a] += 1
                links[b] += 1
    return sorted((i, links[i], groups.find(i), groups.find(i) == i) for i in ids)


@pytest.mark.parametrize("tile_rows", [16, 8192])
def test_links_against_all_pairs(spark, classes, tile_rows):
    vectors = _vectors(np.random.default_rng(1), 8, 9).tolist()
    vectors += [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1e-200] * 24, [1e200] * 24]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    found = sorted(tuple(r) for r in embedding_components(frame, tile_rows=tile_rows).collect())
    safe = [[1.0] * 24 if v and v[0] in (1e-200, 1e200) else v for v in vectors]
    assert found == _expected(range(len(rows)), safe, classes)


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    rows = _vectors(rng, 40, 30, 48)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    found = {(i, j) for part in near_pairs(rows, rows, axes[:, ::-1], 0.95, True) for i, j in zip(*part)}
    cosine = unit @ unit.T
    assert found == {(i, j) for i, j in zip(*np.nonzero(np.triu(cosine >= 0.95, 1)))}


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_components(frame).collect() == []
    assert nearest(frame, F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_against_all_products(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    vectors[7] = vectors[40]  # a tie
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(600, None), (None, [1.0] * 16), (620, [0.0] * 16), (640, [math.nan] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    found = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0, block_rows=200, query_rows=16).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for query, got in found.items():
        got.sort()
        scores = vectors @ vectors[query]
        assert [rank for rank, _, _ in got] == list(range(1, 21))
        assert all(v != query and math.isclose(score, scores[v], rel_tol=1e-12) for _, v, score in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        best = sorted((v for v in range(600) if v != query), key=lambda v: (-scores[v], v))[:20]
        hits += len({v for _, v, _ in got} & set(best))
    assert hits >= 0.9 * 20 * len(found)


def test_few_candidates_are_all_returned(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.5]), (5, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    found = nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 3, 0.5), (0, 2, 5, -1.0)]
