"""Views over the result tables: what a report shows, as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATTENTION_LIMIT = 6
PERSONAL = "POTENTIAL_PERSONAL_DATA"


def evidence_of_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every finding with the evidence it names."""
    links = findings.select(
        "table_name", "finding_id", F.posexplode("evidence_ids").alias("link_order", "evidence_id")
    )
    return links.join(evidence.drop("finding_order"), ["table_name", "evidence_id"])


def column_inventory(profile: DataFrame, classified: DataFrame, query: str = "", category: str = "all") -> DataFrame:
    """Columns whose name contains the query, ignoring case, and which have the category."""
    shown = profile.where(F.lower("name").contains(query.strip().lower()))
    if category == "all":
        return shown
    wanted = classified.where(F.col("category") == category).select("table_name", "column_id")
    return shown.join(wanted, ["table_name", "column_id"], "left_semi")


def classifications_by_column(classified: DataFrame) -> DataFrame:
    """The categories of each classified column in report order (at most eleven per column)."""
    listed = F.array_sort(F.collect_list(F.struct("category_rank", "category")))
    return classified.groupBy("table_name", "position", "column_id", "name").agg(
        F.transform(listed, lambda item: item["category"]).alias("categories")
    )


def category_options(classified: DataFrame) -> DataFrame:
    return classified.select("category").distinct().orderBy("category")


def related_findings(profile: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings about a column: by its id, or by its name. Two equi-joins instead of an OR."""
    columns = profile.select("table_name", "position", "column_id", "name")
    by_id = columns.join(findings.withColumnRenamed("subject", "column_id"), ["table_name", "column_id"])
    by_name = columns.join(findings.withColumnRenamed("subject", "name"), ["table_name", "name"])
    picked = ("table_name", "position", "name", "source", "finding_id", "severity")
    return by_id.select(*picked).unionByName(by_name.select(*picked)).distinct()


def attention_list(findings: DataFrame, profile: DataFrame, limit: int = ATTENTION_LIMIT) -> DataFrame:
    """The first findings to look at per table, and how many more there are."""
    rank = F.when(F.col("source") == "QUALITY", 0).when(F.col("source") == "GOVERNANCE", 1).otherwise(2)
    wanted = findings.where((F.col("source") == "GOVERNANCE") | (F.col("severity") != "INFO"))
    named = with_subject_name(wanted.withColumn("source_rank", rank), profile)
    per_table = Window.partitionBy("table_name")
    placed = named.withColumn(
        "place", F.row_number().over(per_table.orderBy("source_rank", "finding_order", "finding_id"))
    ).withColumn("total", F.count(F.lit(1)).over(per_table))
    return placed.where(F.col("place") <= limit).select(
        "table_name",
        "place",
        "source",
        "finding_id",
        "field",
        "severity",
        "confidence",
        F.greatest(F.col("total") - limit, F.lit(0)).alias("remaining"),
    )


def with_subject_name(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ``field``: the column name of the subject, or the subject itself."""
    names = profile.select("table_name", F.col("column_id").alias("subject"), F.col("name").alias("_name"))
    return (
        findings.join(names, ["table_name", "subject"], "left")
        .withColumn("field", F.coalesce("_name", "subject"))
        .drop("_name")
    )


def recommendation_groups(items: DataFrame, profile: DataFrame) -> DataFrame:
    """Recommendations with the same wording, with the fields they concern in first-seen order."""
    named = with_subject_name(items, profile)
    fields = F.transform(F.array_sort(F.collect_list(F.struct("rank", "field"))), lambda item: item["field"])
    return named.groupBy("table_name", "priority", "category", "action", "rationale", "source").agg(
        F.min("rank").alias("group_rank"),
        F.count(F.lit(1)).alias("recommendation_count"),
        F.array_distinct(fields).alias("affected_fields"),
    )


def review_queue(classified: DataFrame) -> DataFrame:
    """Columns with potential personal data, in column order, with all their categories."""
    personal = classified.where(F.col("category") == PERSONAL).select("table_name", "column_id")
    return (
        classifications_by_column(classified)
        .join(personal, ["table_name", "column_id"], "left_semi")
        .orderBy("table_name", "position")
    )


def category_field_counts(classified: DataFrame) -> DataFrame:
    """Distinct columns per category."""
    return classified.groupBy("table_name", "category").agg(F.count_distinct("column_id").alias("field_count"))


def dimension_weights(dimensions: DataFrame, score: DataFrame) -> DataFrame:
    """Dimensions with the weight that was applied, null where it was not."""
    weights = score.select("table_name", F.explode("applied_weights").alias("w")).select(
        "table_name", F.col("w.name").alias("name"), F.col("w.weight").alias("applied_weight")
    )
    return dimensions.join(weights, ["table_name", "name"], "left")
