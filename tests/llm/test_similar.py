import random

import corpus_pipeline
from pyspark.sql import functions as F

from gaugework.llm.near_simhash import drop_similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def expected(rows, classes):
    """Every pair of different shingle sets is compared."""
    sets = {i: shingles(t) for i, t in rows}
    groups, ids = classes(sorted(sets)), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.link(a, b)
    return {groups.find(i) for i in ids}


def kept(frame):
    return sorted(r["doc_id"] for r in drop_similar(frame).collect())


def test_whole_table_against_all_pairs(spark, documents, classes):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert kept(documents) == sorted(expected(rows, classes))


def test_changed_words_on_both_sides_of_the_similarity(spark, sf_dir, classes):
    rng = random.Random(3)
    rows = []
    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 100, 400]))]
        for changes in range(5):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(expected(rows, classes))
    assert 60 < len(wanted) < 300
    assert kept(frame) == wanted
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, sf_dir).collect()) == wanted


def test_one_changed_word_in_a_hundred(spark, sf_dir):
    words = [f"word{n}" for n in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] + ["other"] + words[51:])), (3, " ".join(words[:40]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, sf_dir).collect()) == [1, 3]


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (8, "x " * 3000), (8, "x " * 3000), (8, "one two"), (None, "q r"), (None, "one two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("digest", F.lit("clash"))
    found = drop_similar(frame)
    assert found.columns == frame.columns
    assert sorted((str(r["doc_id"]), r["text"][:3]) for r in found.collect()) == [("1", ""), ("4", "One"), ("6", "a b"), ("8", "x x"), ("8", "x x"), ("None", "q r")]
    assert drop_similar(frame.limit(0)).collect() == []
