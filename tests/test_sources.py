"""CSV and grid rules, limits and routing."""

import pytest

from gaugework.sources import csv_files, grid
from gaugework.sources.errors import EmptyDataset, IngestError, Malformed, UnsupportedFormat
from gaugework.sources.limits import Limits, limit_verdicts
from gaugework.sources.tables import format_of, load_table


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_delimiters_quotes_and_empty_cells(spark, tmp_path):
    for number, d in enumerate(",;\t|"):
        write(tmp_path, f'id{d}name\n1{d}"a{d}""b"""\n2{d}\n', f"t{number}.csv")
    audit = csv_files.csv_audit(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r.delimiter, r.header, r.row_count, r.verdict) for r in audit] == [(d, ["id", "name"], 2, "accepted") for d in ",;\t|"]
    rows = load_table(spark, f"{tmp_path}/t2.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a\t"b"'), ("2", "")]


def test_quoted_line_breaks_and_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, '\ufeffid,name\n1,"a\nb"\n')
    assert [tuple(r) for r in load_table(spark, path).collect()] == [("1", "a\nb")]


def test_header_only(spark, tmp_path):
    frame = load_table(spark, write(tmp_path, "id,name\n"))
    assert frame.columns == ["id", "name"] and frame.count() == 0


def test_rejections(spark, tmp_path):
    texts = ["", "id,id\n1,2\n", "id, \n1,2\n", "id,name\n1\n", "id,name\n1,2,3\n", "id,name\n1,2\n\n3,4\n", "a,b;c\n1,2;3\n"]
    for number, text in enumerate(texts):
        write(tmp_path, text, f"t{number}.csv")
    audit = csv_files.csv_audit(spark, str(tmp_path)).orderBy("file").collect()
    assert [r.verdict for r in audit] == ["empty_dataset"] + ["malformed_dataset"] * 6
    for number, error in ((0, EmptyDataset), (3, Malformed)):
        with pytest.raises(error):
            load_table(spark, f"{tmp_path}/t{number}.csv")


def test_limits_pass_at_the_limit(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\n")
    assert load_table(spark, path, limits=Limits(max_file_bytes=8, max_columns=2)).count() == 1
    for limits in (Limits(max_file_bytes=7), Limits(max_columns=1)):
        with pytest.raises(IngestError):
            load_table(spark, path, limits=limits)
    tables = {"t": spark.range(10).toDF("a")}
    verdict = lambda **limit: limit_verdicts(tables, Limits(**limit)).head().verdict
    assert verdict(max_rows=10, max_cells=10) == "accepted"
    assert verdict(max_rows=9) == verdict(max_cells=9) == "dataset_limit_exceeded"


def test_audit_gives_a_verdict_per_file(spark, tmp_path):
    write(tmp_path, "a,b\n1,2\n", "good.csv")
    write(tmp_path, "a,b\n1,2\n1,2,3\n", "ragged.csv")
    write(tmp_path, "", "void.csv")
    write(tmp_path, 'a,b\n1,"x\ny"\n', "spanning.csv")
    rows = csv_files.csv_audit(spark, str(tmp_path)).collect()
    verdicts = {r.file.rsplit("/", 1)[1]: (r.verdict, r.row_count) for r in rows}
    assert verdicts["good.csv"] == ("accepted", 1) and verdicts["void.csv"][0] == "empty_dataset"
    assert verdicts["ragged.csv"][0] == "malformed_dataset"
    assert verdicts["spanning.csv"] == ("accepted", 1)


HARD = [
    ("id;text\n1;" + "x" * 200_000 + "\n2;y\n", "accepted", ";", 2),
    ('id;text\n1;"' + "x;\n" * 70_000 + '"\n', "accepted", ";", 1),
    ('a,b\n1,"a"b\n', "malformed_dataset", ",", 1),
    ('a,b\n1,"x\ny"\n\n3,4\n', "malformed_dataset", ",", 2),
    ('a,b\n1,"x\n\ny"\n3,4\n', "accepted", ",", 2),
    ('a,b\n1,"x\ny",3\n3,4\n', "malformed_dataset", ",", 2),
    ('a,b\n1,"x\ny\n', "malformed_dataset", ",", None),
    ("  \n \n", "empty_dataset", ",", None),
    ('"a,1";b\n"x";"say ""hi"""\n', "accepted", ";", 1),
    # A quote within a field is text; a header may be longer than the lines looked at first, and so may a sampled record.
    ('a,b\n5" pipe,2\n6",3\n', "accepted", ",", 2),
    ('"a;' + "\n;" * 900 + '",b\n1,2\n', "accepted", ",", 1),
    ("a;b\n" + '1;"' + "x,\n" * 5_000 + '"\n' + "2;3\n" * 30, "accepted", ";", 31),
]


def test_audit_of_hard_files(spark, tmp_path):
    for number, (text, *_) in enumerate(HARD):
        write(tmp_path, text, f"t{number:02}.csv")
    audit = csv_files.csv_audit(spark, str(tmp_path)).orderBy("file").collect()
    for row, (text, verdict, delimiter, rows) in zip(audit, HARD, strict=True):
        assert (row.verdict, row.delimiter) == (verdict, delimiter), text[:60]
        assert rows is None or row.row_count == rows, text[:60]


def test_broken_utf8_is_malformed(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,\xff\xfe\n")
    assert csv_files.csv_audit(spark, str(tmp_path)).head().verdict == "malformed_dataset"


def test_row_and_cell_limits_of_loads(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\n3,4\n5,6\n")
    assert load_table(spark, path, limits=Limits(max_rows=3, max_cells=6)).count() == 3
    for limits in (Limits(max_rows=2), Limits(max_cells=5)):
        with pytest.raises(IngestError):
            load_table(spark, path, limits=limits)
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(IngestError):
        load_table(spark, str(tmp_path / "t.parquet"), limits=Limits(max_rows=4))
    counted = limit_verdicts({"t": spark.range(1000).toDF("a")}, Limits(max_rows=10)).head()
    assert (counted.row_count, counted.cell_count, counted.verdict) == (1000, 1000, "dataset_limit_exceeded")


def test_routing():
    assert format_of("/x/a.CSV") == "csv" and format_of("/x/a.parquet/") == "parquet"
    with pytest.raises(UnsupportedFormat):
        format_of("/x/a.txt")


CELLS = "file string, sheet string, sheet_index int, visible boolean, row int, col int, value string, cell_type string"


def test_grid(spark):
    cells = spark.createDataFrame(
        [
            ("f", "hidden", 0, False, 0, 0, "no", "s"), ("f", "blank", 1, True, 0, 0, None, "s"),
            ("f", "data", 2, True, 0, 0, "id", "s"), ("f", "data", 2, True, 0, 1, "name", "s"),
            ("f", "data", 2, True, 1, 0, "1", "n"), ("f", "data", 2, True, 2, 0, None, "s"),
            ("f", "data", 2, True, 3, 0, "2", "n"), ("f", "data", 2, True, 3, 1, "=A1", "f"),
            ("f", "data", 2, True, 4, 1, None, "s"), ("g", "data", 0, True, 0, 0, "id", "s"),
            ("g", "data", 0, True, 1, 1, "beyond", "s"), ("h", "only", 0, False, 0, 0, "x", "s"),
        ],
        CELLS,
    )
    rows = {r.file: r for r in grid.grid_summary(cells).collect()}
    assert rows["f"].sheet == "data" and rows["f"].verdict == "accepted"
    assert (rows["f"].row_count, rows["f"].column_count, rows["f"].formula_count, rows["f"].blank_rows) == (2, 2, 1, 1)
    assert rows["f"].warnings == ["blank_xlsx_rows_ignored", "formulas_not_evaluated"]
    assert rows["g"].verdict == "malformed_dataset" and rows["h"].verdict == "empty_dataset"
    table = grid.grid_table(cells.where("file = 'f'"), ["id", "name"]).orderBy("row").collect()
    assert [(r.id, r.name) for r in table] == [("1", None), ("2", None)]
    mixed = spark.createDataFrame(
        [("p", "s", 0, True, 0, c, n, "s") for c, n in enumerate(["name", "id", "extra"])]
        + [("p", "s", 0, True, 1, c, v, "s") for c, v in enumerate(["Bob", "7", "x"])]
        + [("q", "s", 0, True, 0, 0, "id", "s"), ("q", "s", 0, True, 1, 0, "8", "s")],
        CELLS,
    )
    rows = grid.grid_table(mixed).orderBy("id")
    assert rows.columns[2:] == ["name", "id", "extra"] or set(rows.columns[2:]) == {"name", "id", "extra"}
    assert [(r.id, r["name"], r.extra) for r in rows.collect()] == [("7", "Bob", "x"), ("8", None, None)]
    assert [(r.id, r["name"]) for r in grid.grid_table(mixed, ["id", "name"]).orderBy("id").collect()] == [("7", "Bob"), ("8", None)]
    assert grid.choose_sheets(cells, "absent").head().verdict == "sheet_not_found"
