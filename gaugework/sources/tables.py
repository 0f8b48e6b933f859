"""Loading a table by the suffix of its path, and the metadata row of what was loaded."""

from __future__ import annotations

from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.csv_files import load_csv
from gaugework.sources.errors import UnsupportedFormat
from gaugework.sources.limits import Limits, check_table

COLUMNAR = ("parquet", "orc", "json")


def format_of(path: str) -> str:
    """The format a path's suffix stands for, in any case."""
    suffix = PurePath(path.rstrip("/")).suffix.lower().lstrip(".")
    if suffix == "csv" or suffix in COLUMNAR:
        return suffix
    raise UnsupportedFormat(f"{path} has no supported suffix")


def load_table(spark: SparkSession, path: str, format: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """A table from CSV (all text) or from a self-describing format."""
    chosen = (format or format_of(path)).lower()
    if chosen == "csv":
        return load_csv(spark, path, limits)
    if chosen in COLUMNAR:
        frame = getattr(spark.read, chosen)(path)
        check_table(frame, limits)
        return frame
    raise UnsupportedFormat(f"{chosen} is not supported")


METADATA = ("source_filename", "source_format", "sheet_name", "row_count", "column_count", "delimiter", "formula_cell_count", "warnings")


def ingest_metadata(
    spark: SparkSession, profile: DataFrame, sources: dict[str, tuple[str, str]], sheet_name: str | None = None, facts: DataFrame | None = None
) -> DataFrame:
    """One row per table: file name, format, sheet, rows, columns, delimiter, formula cells and warnings. ``sources`` gives the file name and
    format of each table, ``facts`` (source_filename, sheet_name, delimiter, formula_cell_count, warnings) what reading it told:
    :func:`csv_metadata` or :func:`grid_metadata`."""
    named = spark.createDataFrame(
        pa.table(
            {
                "table_name": list(sources),
                "source_filename": [name for name, _ in sources.values()],
                "source_format": [kind for _, kind in sources.values()],
                "given_sheet": pa.array([sheet_name] * len(sources), pa.string()),
            }
        )
    )
    sizes = profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )
    joined = named.join(sizes, "table_name", "left")
    told = ("sheet_name", "delimiter", "formula_cell_count", "warnings")
    if facts is None:
        joined = joined.selectExpr("*", "cast(null as string) as sheet_name", "cast(null as string) as delimiter", "0L as formula_cell_count", "cast(array() as array<string>) as warnings")
    else:
        joined = joined.join(facts.select("source_filename", *told), "source_filename", "left").fillna(0, ["formula_cell_count"])
    warnings = F.array_union(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("row_count") == 0, "header_only_dataset"))))
    result = joined.withColumn("warnings", warnings).withColumn("sheet_name", F.coalesce("given_sheet", "sheet_name"))
    return result.select("table_name", *METADATA)


def csv_metadata(audit: DataFrame) -> DataFrame:
    """The metadata of every CSV file that an audit accepts."""
    none = F.lit(None).cast("string")
    return audit.where("verdict = 'accepted'").select(
        F.col("file").alias("source_filename"), F.lit("csv").alias("source_format"), none.alias("sheet_name"), "row_count",
        F.col("column_count").cast("bigint").alias("column_count"), "delimiter", F.lit(0).cast("bigint").alias("formula_cell_count"), "warnings",
    )


def grid_metadata(summary: DataFrame) -> DataFrame:
    """The metadata of every workbook that a summary accepts, each with its own sheet and formula cells."""
    return summary.where("verdict = 'accepted'").select(
        F.col("file").alias("source_filename"), F.lit("xlsx").alias("source_format"), F.col("sheet").alias("sheet_name"), "row_count",
        F.col("column_count").cast("bigint").alias("column_count"), F.lit(None).cast("string").alias("delimiter"), F.col("formula_count").alias("formula_cell_count"), "warnings",
    )
