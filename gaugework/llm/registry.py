"""The registered queries of this subpackage: name -> (Spark query, SQL counterpart or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gaugework.llm import oracles
from gaugework.llm.bpe import encode_documents
from gaugework.llm.fill_middle import fill_in_middle, restore
from gaugework.llm.fuzzy_lines import dedup_lines
from gaugework.llm.near_embeddings import embedding_components
from gaugework.llm.near_simhash import simhash_components
from gaugework.llm.neighbours import nearest
from gaugework.llm.ordinal_quality import quality_scores
from gaugework.llm.packing import pack_documents
from gaugework.llm.prefix_trie import conversation_trie, rebuilt_turns
from gaugework.llm.rule_cascade import BASE, quality_cascade
from gaugework.llm.sanitise import sanitise, span_digest
from gaugework.llm.sharding import shard_documents
from gaugework.llm.warc import derivatives, responses

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "expected_grade", "top_probability", "selected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(sanitise(_table(spark, sf_dir, "documents")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(_table(spark, sf_dir, "pages")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(_table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(_table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie(rebuilt_turns(_table(spark, sf_dir, "conversations"))).with_ends()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_embeddings": (op1_embeddings, None),
    "op2_quality": (op2_quality, None),
    "op3_packing": (op3_packing, None),
    "op4_sanitise": (op4_sanitise, None),
    "op5_lines": (op5_lines, None),
    "op6_neighbours": (op6_neighbours, None),
    "op7_simhash": (op7_simhash, None),
    "op8_bpe": (op8_bpe, None),
    "op9_warc": (op9_warc, None),
    "op10_sharding": (op10_sharding, None),
    "op11_fill_middle": (op11_fill_middle, oracles.FILL_MIDDLE),
    "op12_rules": (op12_rules, oracles.CASCADE),
    "op13_trie": (op13_trie, oracles.TRIE),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
