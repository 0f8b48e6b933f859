"""The corpus pipeline: documents in, packed training pieces out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.fuzzy_lines import dedup_lines
from gaugework.llm.near_simhash import drop_similar
from gaugework.llm.ordinal_quality import quality_scores
from gaugework.llm.packing import pack_documents
from gaugework.llm.sanitise import sanitise
from gaugework.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(frame: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents with a new text, and its length where they hold one."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return frame.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).where("selected").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or resemble an earlier one; one that loses all its lines has an empty text."""
    return _with_text(dedup_lines(docs), "text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8."""
    return drop_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced."""
    return _with_text(sanitise(docs), "sanitised", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: No SQL: the first stage fits a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
