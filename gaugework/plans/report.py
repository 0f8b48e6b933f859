"""The nested report of each table, and its JSON and table sinks."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators.integrity import table_fingerprint
from gaugework.plans.analysis import Analysis

SCHEMA_VERSION = "0.1"


def _listed(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """All rows of a table as one sorted array. Every input has a number of rows set by the schema."""
    payload = [column for column in frame.columns if column != "table_name"]
    item = F.struct(F.struct(*order).alias("_order"), F.struct(*sorted(payload)).alias("_item"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda pair: pair["_item"])
    return frame.groupBy("table_name").agg(rows.alias(name))


def analysis_report(analysis: Analysis, metadata: DataFrame | None = None) -> DataFrame:
    """One nested struct per table with profiling, quality, governance and recommendations."""
    totals = analysis.profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )
    parts = [
        totals,
        analysis.duplicates,
        analysis.quality_score,
        analysis.governance_summary,
        _listed(analysis.profile, ["position"], "columns"),
        _listed(analysis.candidates, ["position"], "candidate_identifiers"),
        _listed(analysis.quality_dimensions, ["dimension_rank"], "dimensions"),
        _listed(analysis.classifications.drop("tokens"), ["position", "category_rank"], "classifications"),
        _listed(analysis.findings, ["source", "finding_order"], "findings"),
        _listed(analysis.evidence, ["source", "finding_order", "evidence_order"], "evidence"),
        _listed(analysis.recommendations, ["rank"], "recommendations"),
        _listed(analysis.recommendation_summary, ["counted_by", "counted_value"], "recommendation_summary"),
    ]
    joined = analysis.tables.select("table_name")
    for part in parts:
        joined = joined.join(part, "table_name", "left")
    if metadata is not None:
        joined = joined.join(
            metadata.select("table_name", F.struct(*sorted(set(metadata.columns) - {"table_name"})).alias("source_info")),
            "table_name",
            "left",
        )
    else:
        joined = joined.withColumn("source_info", F.lit(None).cast("string"))
    return joined.select("table_name", _report_struct().alias("report"))


def _of(name: str, source: str) -> Column:
    """The findings or evidence of one engine."""
    return F.filter(F.coalesce(F.col(name), F.array()), lambda item: item["source"] == source).alias(name)


def _report_struct() -> Column:
    profiling = F.struct(
        "candidate_identifiers", "column_count", "columns", "complete_duplicate_group_count",
        "duplicate_excess_row_count", "duplicate_row_count", _of("evidence", "PROFILING"),
        _of("findings", "PROFILING"), "row_count",
    )
    quality = F.struct(
        "applicability", "applied_weights", "dimensions", _of("evidence", "QUALITY"), _of("findings", "QUALITY"),
        "not_applicable_reasons", "observed_completeness", "overall_score",
    )
    governance = F.struct(
        "category_counts", "classifications", "classified_column_count", "columns_with_potential_personal_data",
        _of("evidence", "GOVERNANCE"), _of("findings", "GOVERNANCE"),
    )
    suggested = F.struct("recommendations", F.col("recommendation_summary").alias("summary"))
    analysis = F.struct(
        governance.alias("governance"), profiling.alias("profiling"), quality.alias("quality"),
        suggested.alias("recommendations"),
    )
    metadata = F.struct("column_count", "row_count", "source_info", "table_name")
    return F.struct(
        analysis.alias("analysis"), metadata.alias("metadata"), F.lit(SCHEMA_VERSION).alias("schema_version")
    )


def json_reports(reports: DataFrame) -> DataFrame:
    """Reports as JSON text with keys in a fixed order."""
    return reports.select("table_name", F.to_json("report", {"ignoreNullFields": "false"}).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON sink: one line per table."""
    reports.write.mode("overwrite").json(path)


RESULTS = (
    "profile", "duplicates", "candidates", "quality_dimensions", "quality_score", "classifications", "signals",
    "governance_summary", "findings", "evidence", "recommendations", "recommendation_summary",
)
_RUN, _STAGING, _MANIFEST = "run-", "_staging-", "_manifest"


class IncompleteRun(Exception):
    """A folder that holds no committed run, or one whose tables are not as its manifest says."""


def write_tables(analysis: Analysis, path: str) -> str:
    """Table sink: each result table as parquet in one new run below ``path``; returns the run's folder.

    Tables are written to a staging folder and read back for a manifest of their row counts and fingerprints; then the folder gets its name
    in one rename. Whoever reads sees a whole run or none of it, and a run that stops midway leaves earlier ones as they were.
    """
    spark = analysis.profile.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    staging, final = (f"{path.rstrip('/')}/{kind}{name}" for kind in (_STAGING, _RUN))
    manifest = []
    for table in RESULTS:
        getattr(analysis, table).write.parquet(f"{staging}/{table}")
        manifest.append(table_fingerprint(spark.read.parquet(f"{staging}/{table}")).select(F.lit(table).alias("table"), "row_count", "fingerprint"))
    reduce(DataFrame.unionAll, manifest).coalesce(1).write.parquet(f"{staging}/{_MANIFEST}")
    files, made = _files(spark, path)
    if not files.rename(made(staging), made(final)):
        raise IncompleteRun(f"{final} could not be committed")
    return final


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The result tables of the last committed run below ``path``, or of the run ``path`` itself.

    Refuses a folder without a manifest. ``verify`` compares every table with its row count and fingerprint.
    """
    files, made = _files(spark, path)
    run = path.rstrip("/")
    if not files.exists(made(f"{run}/{_MANIFEST}")):
        runs = sorted(status.getPath().getName() for status in files.listStatus(made(run)) if status.getPath().getName().startswith(_RUN)) if files.exists(made(run)) else []
        if not runs or not files.exists(made(f"{run}/{runs[-1]}/{_MANIFEST}")):
            raise IncompleteRun(f"{path} holds no committed run")
        run = f"{run}/{runs[-1]}"
    listed = {row.table: row for row in spark.read.parquet(f"{run}/{_MANIFEST}").collect()}
    tables = {}
    for table, wanted in listed.items():
        if not files.exists(made(f"{run}/{table}")):
            raise IncompleteRun(f"{run} lacks {table}")
        tables[table] = spark.read.parquet(f"{run}/{table}")
    if verify:
        found = reduce(DataFrame.unionAll, [table_fingerprint(frame).select(F.lit(table).alias("table"), "row_count", "fingerprint") for table, frame in tables.items()])
        wrong = [row.table for row in found.collect() if (row.row_count, row.fingerprint) != (listed[row.table].row_count, listed[row.table].fingerprint)]
        if wrong:
            raise IncompleteRun(f"{run} was changed: {', '.join(sorted(wrong))}")
    return tables


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made
