"""Prioritised recommendations, each traced to one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules in order, with the finding they answer, their source, priority and category.
RULES = (
    ("REC-QUALITY-DUPLICATE-ID-001", "duplicate_structural_identifier", "QUALITY", "P0", "DATA_QUALITY"),
    ("REC-QUALITY-MALFORMED-001", "malformed_value", "QUALITY", "P1", "DATA_QUALITY"),
    ("REC-GOV-PERSONAL-001", "potential_personal_data", "GOVERNANCE", "P1", "PRIVACY_REVIEW"),
    ("REC-GOV-QUASI-001", "quasi_identifier", "GOVERNANCE", "P1", "GOVERNANCE"),
)
PRIORITIES = ("P0", "P1", "P2")
SOURCES = ("QUALITY", "GOVERNANCE")
NO_POSITION = 10**9

ACTIONS = (
    "Find out why identifier values repeat and settle them before using the column to tell rows apart.",
    "Bring the values that do not parse into the column's prevailing format before using them further.",
    "Write down who owns these fields, how they may be handled and how long they are kept.",
    "Decide whether these fields together call for extra documentation before the data is shared.",
)


def recommendations(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Recommendations of every table in their final order (``rank`` starts at 1 per table)."""
    rule = F.lit(None).cast("int")
    for number, (_, category, source, _, _) in enumerate(RULES):
        answers = (F.col("source") == source) & (F.col("category") == category)
        rule = F.when(answers, number).otherwise(rule)
    chosen = (
        findings.withColumn("rule", rule)
        .where("rule is not null")
        .dropDuplicates(["table_name", "rule", "finding_id"])
        .select("table_name", "source", "rule", "finding_id", "subject", F.get("evidence_ids", F.lit(0)).alias("evidence_id"))
    )
    observed = evidence.where("source = 'QUALITY'").select("table_name", "evidence_id", "observed_value")
    joined = chosen.join(observed, ["table_name", "evidence_id"], "left")
    # The position is read from the fourth dash-separated part of the finding id where that is a number.
    position = F.coalesce(
        F.get(F.split("finding_id", "-"), F.lit(3)).try_cast("bigint"), F.lit(NO_POSITION).cast("bigint")
    )
    recommendation_id = F.concat(F.lit("R-"), F.col("rule_id"), F.lit("-"), F.col("finding_id"))
    built = (
        joined.withColumn("rule_id", _pick([row[0] for row in RULES]))
        .withColumn("priority", _pick([row[3] for row in RULES]))
        .withColumn("category", _pick([row[4] for row in RULES]))
        .withColumn("action", _pick(list(ACTIONS)))
        .withColumn("rationale", _rationale())
        .withColumn("recommendation_id", recommendation_id)
        .withColumn("position_key", position)
    )
    order = Window.partitionBy("table_name").orderBy(
        "priority", F.col("source") != "QUALITY", "rule", "position_key", "finding_id", "recommendation_id"
    )
    return built.select(
        "table_name",
        F.row_number().over(order).alias("rank"),
        "recommendation_id",
        "finding_id",
        "source",
        "priority",
        "category",
        "action",
        "rationale",
        F.lit("SUGGESTED").alias("assertion_level"),
        "rule_id",
        F.lit("0.1").alias("model_version"),
        "subject",
    )


def recommendation_summary(items: DataFrame) -> DataFrame:
    """Counts per table by priority, by category and in total, from one grouping-sets pass."""
    grouped = items.groupingSets(
        [["table_name", "priority"], ["table_name", "category"], ["table_name"]], "table_name", "priority", "category"
    ).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_level"))
    level = (
        F.when(F.col("priority").isNotNull(), "priority").when(F.col("category").isNotNull(), "category").otherwise("total")
    )
    return grouped.select(
        "table_name",
        level.alias("counted_by"),
        F.coalesce("priority", "category", F.lit("all")).alias("counted_value"),
        "count",
    )


def orphans(items: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Broken links: recommendations without their finding, findings without their evidence."""
    lost_findings = items.join(findings, ["table_name", "finding_id"], "left_anti").select(
        "table_name", F.lit("recommendation").alias("kind"), F.col("recommendation_id").alias("id")
    )
    links = findings.select("table_name", "finding_id", F.explode("evidence_ids").alias("evidence_id"))
    lost_evidence = links.join(evidence, ["table_name", "evidence_id"], "left_anti").select(
        "table_name", F.lit("finding").alias("kind"), F.col("finding_id").alias("id")
    )
    return lost_findings.unionByName(lost_evidence)


def _pick(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), F.col("rule") + 1)


def _rationale() -> Column:
    count = F.coalesce(F.col("observed_value"), F.lit("Some"))
    return (
        F.when(F.col("rule") == 0, F.concat(count, F.lit(" rows repeat an identifier value that occurs before.")))
        .when(F.col("rule") == 1, "Some filled cells do not fit the type nearly all others have.")
        .when(F.col("rule") == 2, "Fixed rules take the column for potential personal data; this is no legal finding.")
        .otherwise("Fixed rules see several describing columns side by side; no re-identification is claimed.")
    )
