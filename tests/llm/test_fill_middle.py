import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from gaugework.llm import registry
from gaugework.llm.fill_middle import BLOCK, Sentinels, count_units, fill_in_middle, restore


def expected(doc_id, text, seed=1, plain=10, spm=20, marks=Sentinels()):
    """One row, cut by slices."""
    text = text or ""
    n = len(text)
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in marks.all) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{marks.suffix}{s}{marks.prefix}{p}{marks.middle}{m}"
    return n, "psm", a, b - a, f"{marks.prefix}{p}{marks.suffix}{s}{marks.middle}{m}"


HARD = [None, "", "a", "\n", "\r\n \u0085 end\n", "😀" * 9 + "é", "a<P>b", "<S", "<M>", "<<S>>", "$1\\$2 \\E \\Q", "<P" * 30, "x" * (3 * BLOCK), "y\n😀" * BLOCK + "z", "<" * 50, ">S>" * 20, "é" * 40]


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("marks", [Sentinels(), Sentinels("<|pre|>", "<|suf|>", "<|mid|>")])
def test_texts_of_all_kinds_equal_slices_and_come_back(spark, marks):
    texts = [(k * 100 + r, text) for k, text in enumerate(HARD) for r in range(12)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    cut = fill_in_middle(docs, plain_percent=15, spm_percent=40, sentinels=marks)
    made = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restore(F.col("output"), F.col("form"), marks).alias("back"))
    wanted = [(i, *expected(i, text, plain=15, spm=40, marks=marks), text or "") for i, text in texts]
    assert rows(made) == sorted(wanted, key=repr)
    assert {row[2] for row in wanted} == {"plain", "psm", "spm"}


def test_a_very_long_text_is_counted_in_blocks(spark):
    text = "ab\n😀" * 500_000 + "tail"
    docs = spark.createDataFrame([(3, text)], "doc_id bigint, text string")
    assert docs.select(count_units(F.col("text"))).first()[0] == len(text)
    row = fill_in_middle(docs, plain_percent=0).select("n", "form", "prefix_chars", "middle_chars", "output").first()
    assert tuple(row) == expected(3, text, plain=0)


def test_clashing_columns_empty_tables_and_parameters(spark):
    docs = spark.createDataFrame([(1, "abc", "h", 5, "o")], "doc_id bigint, text string, hash string, n int, output string")
    assert fill_in_middle(docs).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert tuple(fill_in_middle(docs).select("n", "form", "prefix_chars", "middle_chars", "output").first()) == expected(1, "abc")
    assert fill_in_middle(docs.limit(0)).count() == 0
    everything = spark.range(200).selectExpr("id as doc_id", "'some text of a page' as text")
    assert fill_in_middle(everything, plain_percent=100).where("form <> 'plain'").count() == 0
    assert fill_in_middle(everything, plain_percent=0, spm_percent=100).where("form <> 'spm'").count() == 0
    assert fill_in_middle(everything, seed=2).exceptAll(fill_in_middle(everything)).count() > 150


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "b"), ("aba", "x", "y"), ("ab", "ba", "x"), ("a", "xax", "y")])
def test_sentinels_that_could_be_misread_are_refused(marks):
    with pytest.raises(ValueError):
        Sentinels(*marks)


def test_query_matches_sql(spark, sf_dir):
    query, sql = registry.REGISTRY["op11_fill_middle"]
    assert differences(query(spark, sf_dir), connect(sf_dir), sql) is None


def test_nothing_is_shuffled(spark, documents):
    plan = fill_in_middle(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
