"""Inputs on which operators once ran on, took minutes or lost text."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm.neighbours import nearest
from gaugework.llm.packing import word_count
from gaugework.llm.warc import parse_html


@pytest.mark.parametrize("scale", [1e-200, 1e-310, 1e150])
def test_neighbours_of_vectors_of_extreme_length(spark, scale):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((60, 8)) * np.where(np.arange(60) % 3 == 0, scale, 1.0)[:, None]
    vectors = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(rows)], "vec_id bigint, embedding array<double>")
    found = {}
    for row in nearest(vectors, F.col("vec_id") % 20 == 0, 5).collect():
        found.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
    for query in (0, 20, 40):
        # Sums of products whose terms leave the range follow no order, so scores are compared with a margin.
        scores = [float(np.einsum("j,j->", rows[k], rows[query])) for k in range(60)]
        best = sorted((k for k in range(60) if k != query), key=lambda k: (-scores[k], k))[:5]
        assert [found[query][rank][1] for rank in range(1, 6)] == pytest.approx([scores[k] for k in best], rel=1e-9, abs=0)


def test_word_counts_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", " a", "a ", "\n a\tb\r\n", "a" + " " * 200_000 + "b", " " * 200_000]
    texts += ["".join(rng.choices(["x", " ", "\n", "\t", "yz"], k=rng.randint(0, 12))) for _ in range(100)]
    began = time.time()
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [row.n for row in made] == [len((text or "").split()) for text in texts]
    assert time.time() - began < 20


def test_letters_that_grow_in_lower_case_do_not_move_places():
    text, title, _ = parse_html("<title>İİ</title><p>" + "İ" * 30 + "<SCRIPT>var a = '</p>';</Script> after<p>tail t")
    assert title == "İİ" and text.split("\n")[-2:] == ["İ" * 30 + " after", "tail t"]
