import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugework.llm.bpe import encode_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("head_words", [0, 3])
def test_long_words_copies_and_equal_ids(spark, head_words):
    long = "ab" * 400
    texts = [long, f"{long} {long}", f"start {long} middle {long} end", "start middle end", "", None]
    rows = [(n % 4, text) for n, text in enumerate(texts * 6)] + [(None, f"{long} start"), (None, f"{long} start"), (None, "end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    wanted = [(str(i), tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    found = [(str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in encode_documents(frame, VOCABULARY, head_words).collect()]
    assert sorted(found) == sorted(wanted)


def test_ids_of_another_type(spark):
    frame = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string").withColumn("at", F.lit(1)).withColumn("payload", F.lit(2))
    assert sorted((r["doc_id"], r["decoded"]) for r in encode_documents(frame, VOCABULARY).collect()) == [("a", "one two"), ("b", "")]
