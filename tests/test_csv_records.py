"""Files of all kinds, read in splits of a few bytes, against Python's reader."""

import csv
import io
import random

import pytest

from gaugework.sources import csv_files

DELIMITERS = ",;\t|"


@pytest.fixture
def tiny_splits(spark):
    kept = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


def records(text, delimiter):
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))


def delimiter_of(text):
    found = []
    for delimiter in DELIMITERS:
        widths = set()
        try:
            for number, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True)):
                if number == 20:
                    break
                widths |= {len(row)} if row else set()
        except csv.Error:
            continue
        found += [(widths.pop(), delimiter)] if len(widths) == 1 else []
    found = [item for item in found if item[0] > 1]
    best = [delimiter for width, delimiter in found if width == max(found)[0]]
    return "," if not best else best[0] if len(best) == 1 else None


def expected(text):
    """Verdict, delimiter and rows."""
    if not text.strip():
        return "empty_dataset", None, None
    delimiter = delimiter_of(text)
    try:
        rows = records(text, delimiter) if delimiter else None
    except csv.Error:
        rows = None
    if text[0] in "\r\n":
        return "empty_dataset", delimiter, None
    if rows is None or any(not name.strip() for name in rows[0]) or len(set(rows[0])) < len(rows[0]) or any(len(row) != len(rows[0]) for row in rows):
        return "malformed_dataset", delimiter, None
    return "accepted", delimiter, rows


def random_text(rng):
    delimiter, width, end = rng.choice(DELIMITERS), rng.choice([1, 2, 3, 5]), rng.choice(["\n", "\r\n", "\r"])

    def cell():
        raw = "".join(rng.choices(["a", '"', delimiter, "\n", "\r\n", "\r", "é", " ", "x" * 9, ",", ";"], k=rng.choice([0, 1, 2, 4, 90])))
        if rng.random() < 0.5:
            return '"' + raw.replace('"', '""') + '"'
        return "".join(c for c in raw if c not in "\r\n" + DELIMITERS).lstrip('"')

    rows = [delimiter.join(rng.choice([f"h{j}", f'"h{j}\n{delimiter}""q"']) for j in range(width))]
    rows += [delimiter.join(cell() for _ in range(width)) for _ in range(rng.choice([0, 1, 5, 30]))]
    text = end.join(rows) + rng.choice(["", end])
    if rng.random() < 0.3:
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(['"', end, delimiter, '"x', '""']) + text[at + rng.choice([0, 1]) :]
    return text


def test_random_files_are_judged_as_by_a_sequential_reader(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    texts = ["", "\r\n \n", "a,b\r1,2\r3,4", *[random_text(rng) for _ in range(35)]]
    for number, text in enumerate(texts):
        (tmp_path / f"f{number:03}.csv").write_bytes(text.encode())
    made = csv_files.csv_audit(spark, str(tmp_path)).orderBy("file").collect()
    for row, text in zip(made, texts, strict=True):
        verdict, delimiter, rows = expected(text)
        assert row.verdict == verdict, text
        if rows is not None:
            assert (row.delimiter, list(row.header), row.row_count) == (delimiter, rows[0], len(rows) - 1), text


def test_rows_keep_their_cells_and_places_however_they_are_split(spark, tmp_path, tiny_splits):
    rng = random.Random(9)
    header, files = ["id", "text", "id.x"], []
    for number in range(3):
        # Some records lie across several splits, and some splits within one field.
        rows = [[f"{number}-{k}", "".join(rng.choices(['"', ",", "\n", "\r\n", "\r", "word "], k=rng.choice([0, 3, 20, 400]))), "x" * rng.randint(0, 30)] for k in range(40)]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([header, *rows])
        (tmp_path / f"f{number}.csv").write_bytes(out.getvalue().encode())
        files += rows
    frame = csv_files.load_csv(spark, str(tmp_path), position="row id")
    assert frame.columns == ["row id", *header]
    made = sorted(map(tuple, frame.collect()))
    assert made == [(place, *row) for place, row in enumerate(files)]
    assert sorted(map(tuple, csv_files.load_csv(spark, str(tmp_path)).collect())) == sorted(map(tuple, files))
    assert csv_files.csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_places_of_plain_files(spark, tmp_path):
    for number in range(2):
        (tmp_path / f"f{number}.csv").write_text("a\n" + "".join(f"{number}{k}\n" for k in range(5)))
    assert sorted(map(tuple, csv_files.load_csv(spark, str(tmp_path), position="p").collect())) == [(n * 5 + k, f"{n}{k}") for n in range(2) for k in range(5)]
