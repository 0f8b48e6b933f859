"""Governance classification from column names, types and counts; no cell value is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.names import ends_with_phrase, has_word, is_phrase, name_tokens
from gaugework.operators import judgements as J
from gaugework.session import sql_over

# Categories in report order, with their rules.
RULES = {
    "IDENTIFIER": "GOV-ID-001",
    "QUASI_IDENTIFIER": "GOV-QUASI-001",
    "CONTACT_INFORMATION": "GOV-CONTACT-001",
    "GEOGRAPHIC_INFORMATION": "GOV-GEO-001",
    "DEMOGRAPHIC_INFORMATION": "GOV-DEMO-001",
    "FINANCIAL_INFORMATION": "GOV-FIN-001",
    "TEMPORAL_FIELD": "GOV-TEMP-001",
    "FREE_TEXT": "GOV-TEXT-001",
    "BUSINESS_METRIC": "GOV-METRIC-001",
    "CATEGORICAL_DIMENSION": "GOV-CAT-001",
    "POTENTIAL_PERSONAL_DATA": "GOV-PERSONAL-001",
}
CATEGORIES = tuple(RULES)

# The vocabulary.
IDENTIFIER_WORDS = ("id", "identifier", "uuid", "guid")
TIME_NAMES = ("date", "datetime", "timestamp", "time", "created at", "updated at")
CONTACT = ("email", "phone", "phone number", "telephone", "mobile", "mobile phone")
NOT_CONTACT = ("campaign", "sent", "count", "call")
PLACE = ("country", "country code", "city", "postal code", "postcode", "zip code", "latitude", "longitude")
WHOLE_NAME_PLACE = ("region", "state", "province")
DEMOGRAPHIC = ("age", "birth date", "date of birth", "dob", "gender")
MONEY = ("revenue", "amount", "price", "cost", "salary")
METRIC = ("revenue", "amount", "price", "cost", "quantity", "count", "score")
FREE_TEXT = ("description", "comment", "comments", "note", "notes", "free text")
OTHER_CONTEXT = ("application state", "order state", "workflow state", "sales region", "business region")

# Limits of the categorical rule.
CATEGORICAL_ROWS, CATEGORICAL_VALUES, CATEGORICAL_DISTINCT, CATEGORICAL_RATIO = 20, 10, 2, 0.2

# Signal strengths and the confidence they add up to.
NAME_STRENGTH, OTHER_STRENGTH, STRONG = 2, 1, 3
HIGH_TOTAL, MEDIUM_TOTAL = 5, 3


def with_categories(profile: DataFrame) -> DataFrame:
    """Adds ``tokens``, ``words`` and one Boolean per category; quasi-identifiers look at the whole
    table."""
    numeric = "inferred_type in ('INTEGER', 'FLOAT')"

    def named(phrases: tuple[str, ...]) -> str:
        return f"({ends_with_phrase('words', phrases)} and not {is_phrase('words', OTHER_CONTEXT)})"

    identifier_name = f"({is_phrase('words', IDENTIFIER_WORDS)} or {ends_with_phrase('words', ('id',))})"
    return sql_over(
        f"""
        with tokenized as (select *, {name_tokens('name')} as tokens from $profile),
        worded as (select *, array_join(tokens, ' ') as words from tokenized),
        by_name as (
            select *, is_candidate_identifier and has_name_signal and {identifier_name} as IDENTIFIER,
                inferred_type in ('DATE', 'DATETIME') as TEMPORAL_FIELD,
                {named(CONTACT)} and not {has_word('tokens', NOT_CONTACT)} as CONTACT_INFORMATION,
                {named(PLACE)} or {is_phrase('words', WHOLE_NAME_PLACE)} as GEOGRAPHIC_INFORMATION,
                {named(DEMOGRAPHIC)} as DEMOGRAPHIC_INFORMATION,
                {numeric} and {named(MONEY)} as FINANCIAL_INFORMATION,
                {numeric} and {named(METRIC)} as BUSINESS_METRIC,
                inferred_type = 'STRING' and {named(FREE_TEXT)} as FREE_TEXT
            from worded)
        select *,
            inferred_type in ('STRING', 'BOOLEAN') and row_count >= {CATEGORICAL_ROWS}
                and non_null_count >= {CATEGORICAL_VALUES} and distinct_count >= {CATEGORICAL_DISTINCT}
                and coalesce(cardinality_ratio <= {CATEGORICAL_RATIO}D, false)
                and not (IDENTIFIER or FREE_TEXT or BUSINESS_METRIC) as CATEGORICAL_DIMENSION,
            (DEMOGRAPHIC_INFORMATION or GEOGRAPHIC_INFORMATION) and not IDENTIFIER and not CONTACT_INFORMATION
                and count_if(DEMOGRAPHIC_INFORMATION or GEOGRAPHIC_INFORMATION) over (partition by table_name) >= 2
                as QUASI_IDENTIFIER,
            IDENTIFIER or CONTACT_INFORMATION or DEMOGRAPHIC_INFORMATION as POTENTIAL_PERSONAL_DATA
        from by_name""",
        profile=profile,
    )


def classifications(profile: DataFrame) -> DataFrame:
    """One row per column and category, with its signals and confidence."""
    rows = ", ".join(f"case when {name} then {_classification(name)} end" for name in CATEGORIES)
    exploded = with_categories(profile).selectExpr(
        "table_name", "position", "column_id", "name", "tokens", "inferred_type", "is_candidate_identifier",
        f"explode(array_compact(array({rows}))) as class",
    ).select("*", "class.*").drop("class")
    total = "aggregate(signals, 0, (total, item) -> total + item.strength)"
    return exploded.selectExpr(
        "*",
        f"""case when {total} >= {HIGH_TOTAL} and exists(signals, item -> item.strength = {STRONG}) then 'HIGH'
            when {total} >= {MEDIUM_TOTAL} then 'MEDIUM' else 'LOW' end as confidence""",
        "concat('C-GOV-', column_id, '-', category) as classification_id",
    )


def signals(classified: DataFrame) -> DataFrame:
    """One row per signal of each classification."""
    return classified.select(
        "table_name", "position", "column_id", "name", "category", "category_rank", "rule_id",
        F.posexplode("signals").alias("signal_order", "signal"),
    ).select("*", "signal.*").drop("signal")


def governance_judgements(classified: DataFrame) -> DataFrame:
    """One informational finding per classification, with one piece of evidence per signal."""
    item = J.evidence(
        "item.evidence_id", "governance_signal", "column_id", "rule_id", "governance_signal_strength",
        "item.strength", "item.strength",
        details=[
            J.detail("position", "position"),
            J.detail("normalized_name_tokens", "array_join(tokens, ',')"),
            J.detail("primitive_type", "inferred_type"),
            J.detail("candidate_identifier", "is_candidate_identifier"),
        ],
    )
    finding = J.finding(
        finding_id="concat('F-GOV-', column_id, '-', category)", assertion_level="'INFERRED'", severity="'INFO'",
        confidence="confidence", category="lower(category)", subject="column_id",
        title="concat('Looks like ', replace(lower(category), '_', ' '))",
        description="concat('Name, type and counts of ', name, ' fit fixed rules; no legal claim is made.')",
        method="rule_id",
    )
    judgement = J.judgement("position * 100L + category_rank", finding, f"transform(signals, item -> {item})")
    return J.explode_judgements(classified, "GOVERNANCE", [judgement])


def governance_summary(classified: DataFrame) -> DataFrame:
    """Per table: classified columns, columns with potential personal data, counts per category."""
    per_category = classified.groupBy("table_name", "category_rank", "category").agg(
        F.count(F.lit(1)).alias("count"),
        # Bounded by the columns of the table, as is every list below.
        F.collect_list(F.struct("position", "column_id")).alias("members"),
    )
    personal = F.when(F.col("category") == "POTENTIAL_PERSONAL_DATA", F.col("members"))
    folded = per_category.groupBy("table_name").agg(
        F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"),
        F.flatten(F.collect_list(personal)).alias("personal"),
        F.array_sort(F.collect_list(F.struct("category_rank", "category", "count"))).alias("counts"),
    )
    return folded.select(
        "table_name",
        F.size("members").cast("bigint").alias("classified_column_count"),
        F.transform(F.array_sort("personal"), lambda item: item["column_id"]).alias(
            "columns_with_potential_personal_data"
        ),
        F.transform(
            "counts", lambda item: F.struct(item["category"].alias("category"), item["count"].alias("count"))
        ).alias("category_counts"),
    )


def _classification(category: str) -> str:
    return (
        f"named_struct('category_rank', {CATEGORIES.index(category)}, 'category', '{category}',"
        f" 'rule_id', '{RULES[category]}', 'signals', array_compact(array({', '.join(_signals(category))})))"
    )


def _signals(category: str) -> list[str]:
    """The signals a category carries, in report order."""
    approved = _signal(category, "COLUMN_NAME", "'approved_name'", NAME_STRENGTH)
    typed = _signal(category, "PRIMITIVE_TYPE", "inferred_type", OTHER_STRENGTH)
    if category in ("POTENTIAL_PERSONAL_DATA", "QUASI_IDENTIFIER"):
        return [_signal(category, "COLUMN_NAME", "'contributing_category'", OTHER_STRENGTH)]
    if category == "IDENTIFIER":
        return [approved, _signal(category, "UNIQUENESS", "'structural_candidate_identifier'", OTHER_STRENGTH)]
    if category == "TEMPORAL_FIELD":
        return [f"case when {is_phrase('words', TIME_NAMES)} then {approved} end", typed]
    if category == "CATEGORICAL_DIMENSION":
        return [typed, _signal(category, "VALUE_DISTRIBUTION", "'bounded_cardinality'", OTHER_STRENGTH)]
    if category in ("CONTACT_INFORMATION", "GEOGRAPHIC_INFORMATION"):
        return [approved]
    return [approved, typed]


def _signal(category: str, source: str, kind: str, strength: int) -> str:
    tail = f"'-GOV-COL-', position, '-{category}-{source}'"
    return (
        f"named_struct('signal_id', concat('S', {tail}), 'signal_source', '{source}', 'signal_type', {kind},"
        f" 'strength', {strength}, 'evidence_id', concat('E', {tail}))"
    )
