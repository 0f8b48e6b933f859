"""Profiles, scores, classifications and recommendations on small literal tables."""

import math
import statistics
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugework import analysis_report, analyze, analyze_catalog, json_reports
from gaugework.operators import views
from gaugework.operators.duplicates import flag_repeated_rows, flag_repeated_values
from gaugework.operators.integrity import report_checks
from gaugework.operators.recommendations import orphans
from gaugework.plans.analysis import profile_columns, profile_counts
from gaugework.sources import generators


def column(spark, values, name="value", kind="string"):
    return spark.createDataFrame([(value,) for value in values], f"`{name}` {kind}")


def one(spark, values, name="value", kind="string"):
    return profile_columns(spark, {"t": column(spark, values, name, kind)}).head()


@pytest.mark.parametrize(
    "values, expected",
    [
        (["true", "FALSE"], "BOOLEAN"), (["yes", "no"], "STRING"), (["1", "-2"], "INTEGER"), (["1.0", "-2.5"], "FLOAT"),
        (["1", "2.5"], "STRING"), (["001", "002"], "STRING"), (["2026-01-01"], "DATE"), (["2026-02-30"], "STRING"),
        (["2026-01-01T00:00:00Z"], "DATETIME"), ([" 1"], "STRING"), ([None, None], "NULL"), (["", "1"], "STRING"),
    ],
)
def test_inferred_types(spark, values, expected):
    assert one(spark, values).inferred_type == expected


@pytest.mark.parametrize(
    "values, expected, invalid",
    [
        (["1"] * 98 + ["x"] * 2, "INTEGER", 2), (["1"] * 97 + ["x"] * 3, "STRING", 0), ([" yes "] * 5, "BOOLEAN", 0),
        (["007"] * 95 + ["1"] * 5, "STRING", 0), (["007"] * 2 + ["1"] * 98, "INTEGER", 2),
    ],
)
def test_parser_types(spark, values, expected, invalid):
    row = one(spark, values)
    assert (row.parser_type, row.invalid_count) == (expected, invalid)


def test_physical_types(spark):
    frame = spark.createDataFrame(
        [(True, 1, 1.5, date(2026, 1, 1), datetime(2026, 1, 1), Decimal("3"), Decimal("1.5"), [1.0], bytearray(b"a"))],
        "b boolean, i int, f float, d date, ts timestamp, whole decimal(20,0), part decimal(5,2), a array<double>, raw binary",
    )
    rows = profile_columns(spark, {"t": frame}).collect()
    assert {r.name: r.inferred_type for r in rows} == {
        "b": "BOOLEAN", "i": "INTEGER", "f": "FLOAT", "d": "DATE", "ts": "DATETIME", "whole": "INTEGER", "part": "FLOAT",
        "a": "STRING", "raw": "STRING",
    }
    assert all(r.basic_statistics is None for r in rows if r.name in ("b", "a", "raw"))


def test_not_a_number_column_falls_back_without_statistics(spark):
    row = one(spark, [1.0, math.nan, math.inf], kind="double")
    assert row.inferred_type == "STRING" and row.basic_statistics is None
    row = one(spark, [1.0] * 99 + [math.nan], kind="double")
    assert (row.parser_type, row.valid_count, row.invalid_count) == ("FLOAT", 99, 1)


def test_counts_nulls_and_long_texts(spark):
    long_text = "word " * 5000
    row = one(spark, ["A", "A", "B", None, long_text, long_text, long_text + "x"])
    assert (row.non_null_count, row.distinct_count, row.duplicate_excess_rows, row.nullable) == (6, 4, 2, True)
    assert row.basic_statistics.max_length == len(long_text) + 1
    digits = one(spark, ["1" * 90, " " + "2" * 90])
    assert (digits.parser_type, digits.valid_count) == ("INTEGER", 2)


def test_zeros_nan_and_odd_names(spark):
    frame = spark.createDataFrame([(0.0, 1), (-0.0, 1), (math.nan, 1), (math.nan, 1)], "`a.b` double, `c d` int")
    rows = {r.name: r for r in profile_counts(spark, {"t": frame}).collect()}
    assert rows["a.b"].distinct_count == 2 and rows["c d"].is_constant


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """One range for all numbers, or several, which are not put together again."""
    kept = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for key, value in kept.items():
        spark.conf.set(key, value)


def test_median_and_deviation_over_ranges(spark, ranges):
    sets = {
        "odd": [3.0, -1.5, 1e300, 2.0, 2.0], "even": [1.0, 2.0, 1024.0, -7.25], "tiny": [5e-324, 1e-310, -0.0, 1.0],
        "skewed": [5.0] * 50 + [6.0] * 49 + [1e9],
    }
    frame = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v double")
    tables = {k: frame.where(F.col("k") == k).select("v") for k in sets}
    for row in profile_columns(spark, tables).collect():
        values = sets[row.table_name]
        assert row.basic_statistics.median == pytest.approx(statistics.median(values), rel=1e-12, abs=0)
        if row.table_name != "odd":
            assert row.basic_statistics.stddev == pytest.approx(statistics.pstdev(values), rel=1e-9)


def test_median_of_many_distinct_numbers(spark, ranges):
    # Half of the cells are one number; the middle lies between ranges for some columns.
    columns = ["id * 7 % 10007 as a", "case when id % 2 = 0 then 5000 else id end as b", "cast(id as string) as c", "cast(id / 8 as decimal(20, 3)) as d", "case when id < 10007 then -id else id end as e"]
    frame = spark.range(20_014).selectExpr(*columns)
    values = list(zip(*frame.collect()))
    for row in profile_columns(spark, {"t": frame}).orderBy("position").collect():
        numbers = [float(value) for value in values[row.position]]
        stats = row.basic_statistics
        assert (stats.median, stats.minimum_number, stats.maximum_number) == (statistics.median(numbers), min(numbers), max(numbers)), row.name
        assert stats.stddev == pytest.approx(statistics.pstdev(numbers), rel=1e-9)


def test_text_numbers_keep_text_order_extremes(spark):
    stats = one(spark, ["9", "10", "+3"]).basic_statistics
    assert (stats.minimum_number, stats.maximum_number, stats.minimum_text, stats.maximum_text) == (3.0, 10.0, "+3", "9")
    assert (stats.minimum_integer, stats.maximum_integer) == (3, 10)


@pytest.mark.parametrize(
    "name, rows, nulls, repeats, expected",
    [
        ("id", 10, 0, 0, True), ("id", 9, 0, 0, False), ("order_id", 20, 1, 0, True), ("order_id", 20, 2, 0, False),
        ("opaque", 100, 1, 0, True), ("opaque", 100, 2, 0, False), ("opaque", 99, 0, 0, False), ("opaque", 1000, 0, 1, True),
        ("opaque", 1000, 0, 2, False), ("uuid", 50, 0, 1, True), ("uuid", 50, 0, 2, False), ("identity", 50, 0, 0, False),
    ],
)
def test_candidate_thresholds(spark, name, rows, nulls, repeats, expected):
    values = [None] * nulls + ["first"] * repeats + ["first"] + [f"v{i}" for i in range(rows - nulls - repeats - 1)]
    row = profile_counts(spark, {"t": column(spark, values, name)}).head()
    assert row.is_candidate_identifier is expected


def test_demo_golden(spark):
    demo = analyze(generators.demo_rows(spark.range(1, 51)), "demo")
    scores = {row.name: row.score for row in demo.quality_dimensions.collect()}
    assert scores == {"structural_completeness": 100.0, "uniqueness": 98.4, "validity": 99.67, "consistency": 96.66}
    score = demo.quality_score.head()
    assert (score.overall_score, score.observed_completeness) == (99, 98.46)
    counts = {row.source: row["count"] for row in demo.findings.groupBy("source").count().collect()}
    assert (counts["QUALITY"], counts["GOVERNANCE"], demo.recommendations.count()) == (2, 19, 8)
    assert orphans(demo.recommendations, demo.findings, demo.evidence).count() == 0


@pytest.mark.parametrize(
    "make, findings, suggestions",
    [
        (lambda s: generators.standard_rows(s.range(1000), width=10), 24, 7),
        (lambda s: generators.compact_rows(s.range(10_000)), 3, 1),
        (lambda s: generators.mixed_rows(s.range(41_000)), 33, 10),
    ],
)
def test_generated_goldens(spark, make, findings, suggestions):
    result = analyze(make(spark), "t")
    assert (result.findings.count(), result.recommendations.count()) == (findings, suggestions)


def test_empty_one_row_and_short_tables_in_one_catalogue(spark):
    tables = {
        "empty": column(spark, [], "id"),
        "one": column(spark, ["x"], "note"),
        "short": column(spark, ["true", "FALSE", "Yes", "nO"] * 2, "flag"),
    }
    result = analyze_catalog(spark, tables)
    rows = {(r.table_name, r.name): (r.applicability, r.reason) for r in result.quality_dimensions.collect()}
    assert all(rows["empty", name] == ("INSUFFICIENT_DATA", "empty_dataset") for name in ("uniqueness", "validity"))
    assert rows["one", "uniqueness"] == ("INSUFFICIENT_DATA", "fewer_than_two_rows")
    assert rows["one", "validity"] == ("NOT_APPLICABLE", "no_typed_columns")
    assert rows["short", "consistency"] == ("INSUFFICIENT_DATA", "fewer_than_10_valid_non_null_values")
    assert {r.table_name: r.overall_score for r in result.quality_score.collect()}["empty"] is None
    families = {r.name: r.format_family_counts for r in result.profile.collect()}["flag"]
    assert {item.family: item["count"] for item in families} == {
        "BOOLEAN_LOWER": 2, "BOOLEAN_UPPER": 2, "BOOLEAN_TITLE": 2, "BOOLEAN_OTHER": 2,
    }


def brute_uncovered(rows, candidates):
    seen, seen_values, count = set(), {i: set() for i in candidates}, 0
    for row in rows:
        covered = any(row[i] is not None and row[i] in seen_values[i] for i in candidates)
        count += row in seen and not covered
        seen.add(row)
        for i in candidates:
            seen_values[i].add(row[i])
    return count


def test_uncovered_repeats_match_brute_force(spark):
    rows = [(f"k{i}", "a") for i in range(200)] + [("k5", "a"), ("k7", "b")] + [(None, "a")] * 3 + [(None, "b")] * 2
    frame = spark.createDataFrame(rows, "id string, note string")
    result = analyze(frame, "t")
    uniqueness = {r.name: r for r in result.quality_dimensions.collect()}["uniqueness"]
    assert uniqueness.denominator - uniqueness.numerator == brute_uncovered(rows, [0]) == 3


def test_rows_with_separators_are_not_confused(spark):
    frame = spark.createDataFrame([("a;1:b", "c"), ("a", "1:b;c"), ("~", None), (None, "~"), ("", None), (None, None)], "x string, y string")
    assert analyze(frame, "t").duplicates.head().duplicate_excess_row_count == 0


def test_flagged_rows_with_a_dominant_group(spark):
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 5 else "y") for i in range(300)]
    frame = spark.createDataFrame(rows, "row_id int, a string, b string")
    seen, expected = set(), set()
    for row in rows:
        if row[1:] in seen:
            expected.add(row[0])
        seen.add(row[1:])
    flagged = flag_repeated_rows(frame, "row_id").where("is_excess").collect()
    assert {row.row_id for row in flagged} == expected and flag_repeated_rows(frame, "row_id").count() == 300
    values = flag_repeated_values(frame, "row_id", "b").where("is_excess").collect()
    assert {row.row_id for row in values} == {i for i in range(5, 300, 5)}


def test_governance_rules(spark):
    rows = [(f"c{i}", f"u{i}@x.test", 20 + i % 3, "Oslo", float(i), "2026-01-01", "x") for i in range(40)]
    names = ["customer_id", "email", "age", "city", "revenue", "created_at", "order state"]
    result = analyze(spark.createDataFrame(rows, names), "t")
    found = {(r.name, r.category): r.confidence for r in result.classifications.collect()}
    assert found["customer_id", "IDENTIFIER"] == "MEDIUM" and found["created_at", "TEMPORAL_FIELD"] == "MEDIUM"
    assert found["email", "CONTACT_INFORMATION"] == "LOW" and found["age", "DEMOGRAPHIC_INFORMATION"] == "MEDIUM"
    assert {n for n, c in found if c == "QUASI_IDENTIFIER"} == {"age", "city"}
    assert {n for n, c in found if c == "POTENTIAL_PERSONAL_DATA"} == {"customer_id", "email", "age"}
    assert {c for n, c in found if n == "revenue"} == {"FINANCIAL_INFORMATION", "BUSINESS_METRIC"}
    assert not [c for n, c in found if n == "order state" and c == "GEOGRAPHIC_INFORMATION"]
    ranked = [r.rule_id for r in result.recommendations.orderBy("rank").collect()]
    assert ranked == ["REC-GOV-PERSONAL-001"] * 3 + ["REC-GOV-QUASI-001"] * 2


def test_report_holds_no_cell_value_and_is_stable(spark):
    frame = spark.createDataFrame([(f"RAW-{i}", "RAW_SENTINEL", i) for i in range(30)], "id string, note string, n int")
    texts = [json_reports(analysis_report(analyze(frame, "t"))).head().report for _ in range(2)]
    assert texts[0] == texts[1] and "RAW" not in texts[0] and '"overall_score":100' in texts[0]
    checks = report_checks(spark.createDataFrame([("t", texts[0])], "table_name string, report string"), "RAW_SENTINEL").head()
    assert not checks.holds_sentinel and not checks.holds_row_shaped_key


def test_attention_list_is_cut_and_counted(spark):
    result = analyze(generators.demo_rows(spark.range(1, 51)), "t")
    rows = views.attention_list(result.findings, result.profile).orderBy("place").collect()
    assert len(rows) == 6 and rows[0].source == "QUALITY" and rows[0].remaining == 15
