import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugework.llm.sharding import communication_matrix, shard_documents, shard_rows, shard_sizes


def test_matrix_has_exact_sums_and_the_right_mean():
    parts, shards = [700, 0, 301, 5], shard_sizes(1006, 7)
    total = [[0] * 7 for _ in parts]
    for seed in range(200):
        matrix = communication_matrix(parts, shards, seed)
        assert [sum(row) for row in matrix] == parts and [sum(col) for col in zip(*matrix)] == shards
        assert min(map(min, matrix)) >= 0
        total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, matrix)]
    for row, part in zip(total, parts):
        for value, shard in zip(row, shards):
            assert abs(value / 200 - part * shard / 1006) < 3
    with pytest.raises(ValueError):
        communication_matrix([1], [2])


def test_documents(spark, documents):
    rows = shard_documents(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    assert all(r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(count))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_many_parts_and_pieces(spark):
    """Uniform: each part's rows spread over all shards, and slots do not follow the input."""
    frame = spark.range(3000).withColumn("slot", F.lit("clash"))
    rows = shard_rows(frame, shards=6, part_rows=100).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    for shard in range(6):
        own = sorted((r["slot"], r["id"]) for r in rows if r["shard"] == shard)
        assert [slot for slot, _ in own] == list(range(500))
        assert 1350 < sum(i for _, i in own) / 500 < 1650
        assert 0.4 < sum(a[1] < b[1] for a, b in zip(own, own[1:])) / 499 < 0.6


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 50_000)], "doc_id long, text string").withColumn("part", F.lit(1))
    rows = shard_documents(frame).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == [(16, 0), (16, 0), (16, 0), (100_016, zlib.crc32(("é" * 50_000).encode()))]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert shard_documents(frame.limit(0)).collect() == []
