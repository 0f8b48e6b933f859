"""Fingerprints, leaks, row places, sinks and observed limits."""

import datetime

import pytest
from pyspark.sql import functions as F

from gaugework import IncompleteRun, analyze, read_tables, write_tables
from gaugework.operators.duplicates import repeated_row_positions, repeated_value_positions
from gaugework.operators.integrity import cell_texts, leaked_values, table_fingerprint, text_strings
from gaugework.operators.positions import with_positions
from gaugework.plans import report
from gaugework.plans.analysis import count_repeated_rows, profile_counts
from gaugework.sources import grid
from gaugework.sources.errors import EmptyDataset, LimitExceeded, Malformed
from gaugework.sources.limits import Limits, ObservedRows

NESTED = "a array<timestamp>, m map<string,timestamp>, s struct<`x y`:timestamp,z:array<double>>, n timestamp_ntz"
AT = datetime.datetime(2026, 1, 1, 0, 0, 0, 123456)
LATER = AT.replace(microsecond=123999)


def nested(spark, *rows):
    return spark.createDataFrame([([at], {"k": at, "j": at}, (at, [zero, None]), at) for at, zero in rows], NESTED)


def test_nested_instants_are_told_apart_by_microseconds(spark):
    frame = nested(spark, (AT, 0.0), (LATER, 0.0), (AT, -0.0))
    assert [row.distinct_count for row in profile_counts(spark, {"t": frame}).collect()] == [2, 2, 2, 2]
    assert count_repeated_rows(spark, {"t": frame}).head().duplicate_excess_row_count == 1


def test_fingerprints_tell_every_difference_and_no_order(spark):
    base = [(AT, 0.0), (LATER, 1.0)]
    prints = {table_fingerprint(nested(spark, *base)).head().fingerprint, table_fingerprint(nested(spark, *base[::-1]).repartition(5)).head().fingerprint}
    assert len(prints) == 1
    others = [[(LATER, 0.0), (LATER, 1.0)], [(AT, -0.0), (LATER, 1.0)], [(AT, None), (LATER, 1.0)], base[:1], base + base[:1], base + base[1:], base * 2]
    prints |= {table_fingerprint(nested(spark, *rows)).head().fingerprint for rows in others}
    assert len(prints) == 1 + len(others)
    plain = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    same = [plain, plain.select("t", "n"), plain.orderBy("t").coalesce(1)]
    assert len({table_fingerprint(frame).head().fingerprint for frame in same}) == 1
    different = [plain, plain.withColumnRenamed("t", "u"), plain.selectExpr("cast(n as bigint) n", "t"), plain.fillna("~"), plain.fillna(""), plain.limit(0), plain.drop("t")]
    assert len({table_fingerprint(frame).head().fingerprint for frame in different}) == len(different)


def test_leaks_within_longer_strings_are_found_and_nothing_else(spark):
    frame = spark.createDataFrame(
        [(f"customer-{k:05d}", [f"tag-number-{k}"], (f"nested value {k}",), 10_000_000 + k, "short") for k in range(500)],
        "id string, tags array<string>, s struct<v:string>, n bigint, w string",
    )
    clean = ["customer-0000", "a report on customer- columns", "short", "tag-number-", "1000000", "customer-99999 and tag-number-x"]
    planted = ["seen: customer-00042!", "10000007", "the nested value 499 and tag-number-12", "tag-number-12"]
    strings = spark.createDataFrame([(text,) for text in clean + planted], "value string")
    found = {(row.value, row.string) for row in leaked_values(strings, cell_texts(frame)).collect()}
    # A number stands in a longer one, as texts do.
    assert found == {
        ("customer-00042", planted[0]), ("10000007", planted[1]), ("nested value 499", planted[2]), ("nested value 49", planted[2]), ("nested value 4", planted[2]),
        *[(f"tag-number-{k}", text) for k in (1, 12) for text in planted[2:]],
    }
    assert leaked_values(strings.limit(0), cell_texts(frame)).count() == 0 and cell_texts(frame.select()).count() == 0
    texts = {row.value for row in text_strings(frame.limit(1).select("id", "tags", "s", "n")).collect()}
    assert texts == {"customer-00000", "tag-number-0", "nested value 0"}


def test_positions_follow_files_and_need_no_key(spark, tmp_path):
    rows = [("hot", None) if k % 3 else (f"v{k % 50}", k % 4 or None) for k in range(600)]
    path = str(tmp_path / "t.parquet")
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], "a string, b int").coalesce(1).write.mode("append").parquet(path)
    frame = spark.read.parquet(path)
    placed = with_positions(frame, "at").orderBy("at").collect()
    assert [row["at"] for row in placed] == list(range(600))
    order = [(row.a, row.b) for row in placed]
    assert sorted(order, key=repr) == sorted(rows, key=repr)
    expected = [k for k, row in enumerate(order) if row in order[:k]]
    assert sorted(row[0] for row in repeated_row_positions(frame).collect()) == expected
    numbers = [row[1] for row in order]
    wanted = [k for k, value in enumerate(numbers) if value is not None and value in numbers[:k]]
    assert sorted(row[0] for row in repeated_value_positions(frame, "b").collect()) == wanted
    with pytest.raises(ValueError):
        with_positions(frame, "a")


def test_positions_of_other_frames(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("a",), ("a",)], "x string").repartitionByRange(3, "x")
    assert sorted(map(tuple, with_positions(frame).collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 3)]
    assert sorted(row[0] for row in repeated_row_positions(frame).collect()) == [1, 2]
    assert repeated_row_positions(frame.limit(0)).count() == 0


def test_table_sink_is_whole_or_absent(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    result = analyze(spark.range(30).selectExpr("id as order_id", "concat('note ', id % 3) as note"), "t")
    with pytest.raises(IncompleteRun):
        read_tables(spark, path)
    first = write_tables(result, path)
    tables = read_tables(spark, path)
    assert sorted(tables) == sorted(report.RESULTS)
    assert all(tables[name].exceptAll(getattr(result, name)).isEmpty() for name in ("quality_score", "findings"))

    # A run that stops between two tables leaves what was there.
    class Stopped(Exception):
        pass

    class Halfway:
        profile = result.profile

        def __getattr__(self, name):
            if name == "findings":
                raise Stopped
            return getattr(result, name)

    with pytest.raises(Stopped):
        write_tables(Halfway(), path)
    assert read_tables(spark, path)["findings"].inputFiles()[0].startswith(f"file:{first}") or first in read_tables(spark, path)["findings"].inputFiles()[0]
    # A run whose table was changed is refused.
    tables["quality_score"].withColumn("overall_score", F.lit(1).cast("bigint")).write.mode("append").parquet(f"{first}/quality_score")
    with pytest.raises(IncompleteRun):
        read_tables(spark, first)
    assert len(read_tables(spark, first, verify=False)) == len(report.RESULTS)


def test_limits_observed_in_the_pass_that_uses_the_table(spark):
    frame = spark.range(100).selectExpr("id", "id % 7 as b")
    for limits, good in ((Limits(max_rows=100, max_cells=200), True), (Limits(max_rows=99), False), (Limits(max_cells=199), False)):
        seen = ObservedRows(frame, limits)
        assert len(seen.frame.groupBy("b").count().collect()) == 7
        assert seen.rows == 100
        if good:
            seen.check()
        else:
            with pytest.raises(LimitExceeded):
                seen.check()
    with pytest.raises(LimitExceeded):
        ObservedRows(frame, Limits(max_columns=1))


CELLS = "file string, sheet string, sheet_index int, visible boolean, row int, col int, value string, cell_type string"


def workbook(spark, *sheets):
    """Sheets as (name, visible, rows)."""
    return spark.createDataFrame(
        [("w", name, number, visible, r, c, value, "s") for number, (name, visible, rows) in enumerate(sheets) for r, row in enumerate(rows) for c, value in enumerate(row)], CELLS
    )


def test_workbook_limits(spark):
    data = [["a", "b"], ["1", "2"], ["3", "4"]]
    book = workbook(spark, ("hidden", False, [["x"] * 9] * 9), ("empty", True, [[None] * 5]), ("data", True, data))
    verdict = lambda sheet=None, **limits: grid.grid_summary(book, sheet, Limits(**limits)).head().verdict
    assert verdict() == verdict(max_rows=2, max_columns=5, max_cells=6, max_sheets=3) == "accepted"
    over = "dataset_limit_exceeded"
    assert verdict(max_sheets=2) == verdict(max_rows=1) == verdict(max_columns=4) == verdict(max_cells=5) == over
    # Only the named sheet counts if there is one; a hidden sheet before the chosen one does not.
    assert verdict("data", max_columns=2) == "accepted" and verdict("hidden", max_columns=8) == over
    assert verdict("none", max_columns=1) == "sheet_not_found"


@pytest.mark.parametrize(
    "rows, error",
    [
        ([["a", "b"], ["1", "2", "beyond"]], Malformed), ([["a", None, "c"], ["1", "2", "3"]], Malformed), ([["a", "a"], ["1", "2"]], Malformed),
        ([["a", " "], ["1", "2"]], Malformed), ([[None, None], ["1", "2"]], EmptyDataset), ([[None], [None]], EmptyDataset),
    ],
)
def test_bad_workbooks_are_refused(spark, rows, error):
    book = workbook(spark, ("s", True, rows))
    with pytest.raises(error):
        grid.grid_table(book)
    good = workbook(spark, ("s", True, [["b", "a"], ["1", None], [None, None], [None, "2"]])).withColumn("file", F.lit("good"))
    kept = grid.grid_table(good.unionByName(book), bad="drop").orderBy("row")
    assert kept.columns == ["file", "row", "b", "a"]
    assert [(row.file, row.row, row.b, row.a) for row in kept.collect()] == [("good", 1, "1", None), ("good", 3, None, "2")]
