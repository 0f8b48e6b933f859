"""Checks on finished reports: fingerprints, leaks, counts and stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.operators.cells import row_text

# Keys that would mean rows were put into a report.
ROW_SHAPED_KEYS = ("dataframe", "rows", "raw_rows", "records")


def fingerprints(reports: DataFrame) -> DataFrame:
    """SHA-256 of each report; reports list their keys and rows in a fixed order."""
    return reports.select("table_name", F.sha2("report", 256).alias("fingerprint"))


#: Parts that a row's digest is cut into.
LANES = 8


def table_fingerprint(frame: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table of any size: ``row_count`` and ``fingerprint``.

    Each row is a canonical text, in which microseconds, signed zeros, nulls and types tell, and its SHA-256 is cut into lanes that are summed
    apart. Equal tables have equal sums however they are split, and a row more or less of any kind changes them. Names and types of the
    columns, in the order of their names, go into the fingerprint as well.
    """
    order = sorted(range(len(frame.columns)), key=lambda i: frame.columns[i])
    fields = [frame.schema.fields[i] for i in order]
    schema = repr([(field.name, field.dataType.simpleString()) for field in fields])
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    columns = [(f"c{i}", field.dataType) for i, field in zip(order, fields)]
    digest = F.sha2(F.expr(row_text(columns, exact=True)) if columns else F.lit(""), 256)
    lanes = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(LANES)]
    # Sums of 32 bits fit 64 within a task; those of the tasks are added as decimals.
    by_task = plain.select(digest.alias("digest")).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(lane).alias(f"s{k}") for k, lane in enumerate(lanes)])
    sums = by_task.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), *[F.coalesce(F.sum(F.col(f"s{k}").cast("decimal(28,0)")), F.lit(0)).alias(f"s{k}") for k in range(LANES)])
    parts = [F.lit(schema), F.col("row_count").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(LANES)]]
    return sums.select("row_count", F.sha2(F.concat_ws(",", *parts), 256).alias("fingerprint"))


def stability(runs: DataFrame) -> DataFrame:
    """Whether every run of a table gave the same fingerprint."""
    return runs.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("runs"), (F.count_distinct("fingerprint") == 1).alias("is_stable")
    )


def report_checks(reports: DataFrame, sentinel: str) -> DataFrame:
    """Per report: holds the sentinel text, or a key shaped like raw rows."""
    shaped = F.lit(False)
    for key in ROW_SHAPED_KEYS:
        shaped = shaped | F.col("report").contains(f'"{key}":')
    return reports.select(
        "table_name",
        F.col("report").contains(sentinel).alias("holds_sentinel"),
        shaped.alias("holds_row_shaped_key"),
    )


#: Letters of the pieces that texts are looked up by; shorter values turn up in any text by chance.
GRAM = 8


def text_strings(*frames: DataFrame) -> DataFrame:
    """All texts of result tables as (value), also those within arrays and structs."""
    parts = [frame.select(F.explode(_texts_of(frame)).alias("value")) for frame in frames]
    return reduce(DataFrame.unionAll, parts).where("value is not null").distinct()


def _texts_of(frame: DataFrame) -> Column:
    found = [item for field in frame.schema.fields for item in _strings(F.col(f"`{field.name}`"), field.dataType)]
    return F.flatten(F.array(*found)) if found else F.array().cast("array<string>")


def _strings(value: Column, kind: T.DataType) -> list[Column]:
    """Array columns that together hold every text of a value."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return [F.array(value)]
    if isinstance(kind, T.StructType):
        return [item for field in kind.fields for item in _strings(value.getField(field.name), field.dataType)]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return [F.coalesce(value, none)]
        if not _strings(F.lit(None), kind.elementType):
            return []
        return [F.coalesce(F.flatten(F.transform(value, lambda item: F.flatten(F.array(*[F.coalesce(part, none) for part in _strings(item, kind.elementType)])))), none)]
    return []


def cell_texts(frame: DataFrame) -> DataFrame:
    """Every cell of every column as a text, as (value); nested values give all their texts. Cells too short to be told from chance are left out."""
    plain = frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])
    nested = (T.StructType, T.ArrayType)
    parts = []
    for field in plain.schema.fields:
        parts += _strings(F.col(field.name), field.dataType) if isinstance(field.dataType, nested) else [F.array(F.col(field.name).cast("string"))]
    if not parts:
        return frame.select(F.lit(None).cast("string").alias("value")).limit(0)
    return plain.select(F.explode(F.flatten(F.array(*parts))).alias("value")).where(F.length("value") >= GRAM)


def leaked_values(report_strings: DataFrame, values: DataFrame) -> DataFrame:
    """(value, string): the values that stand in a string of a report, whole or as part of it. Values of fewer than eight letters are not looked for.

    The report's pieces of eight letters are an index, bounded by the schema as the report is; a value can only be in a string that holds its
    rarest piece, so values whose pieces are not all there go at once, and what is left is compared with the strings of that piece.
    """
    strings = report_strings.where(F.length("value") >= GRAM).select(F.col("value").alias("string")).distinct()
    pieces = lambda text: F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    postings = strings.select("string", F.explode(F.array_distinct(pieces(F.col("string")))).alias("gram"))
    index = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("strings"))
    # Three pieces of each value, first, middle and last, are enough to drop nearly all; the rarest of them is the one that is looked up.
    wanted = values.where(F.length("value") >= GRAM).select("value").distinct()
    size = F.length("value")
    probes = F.array(*[F.substring(F.col("value"), start, F.lit(GRAM)) for start in (F.lit(1), F.floor((size - GRAM) / 2).cast("int") + 1, size - GRAM + 1)])
    probed = wanted.select("value", F.explode(F.array_distinct(probes)).alias("gram"), F.size(F.array_distinct(probes)).alias("probes"))
    found = probed.join(index, "gram").groupBy("value", "probes").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("strings", "gram")).alias("rarest"))
    candidates = found.where("hits = probes").select("value", F.col("rarest.gram").alias("gram"))
    return candidates.join(postings, "gram").where(F.col("string").contains(F.col("value"))).select("value", "string")


def counts(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings per table and engine, and recommendations per table."""
    by_engine = findings.groupBy("table_name", F.col("source").alias("engine")).agg(F.count(F.lit(1)).alias("count"))
    suggested = items.groupBy("table_name", F.lit("RECOMMENDATIONS").alias("engine")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return by_engine.unionByName(suggested)
