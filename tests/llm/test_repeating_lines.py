from gaugework.llm.fuzzy_lines import BANDS, band_keys, dedup_lines, distinct_shingles
from test_lines import expected


def test_lines_that_repeat_themselves(spark, classes):
    """Rulers and repeated phrases of different lengths have the same shingles."""
    parts = ["-", "=*", "buy now at the best price ", "| cell 1 | cell 22 ", "".join(chr(0x4E00 + n) for n in range(97))]
    lines = [part * (length // len(part)) for part in parts for length in (80, 300, 1200, 4000, 9000) if length >= 2 * len(part)]
    lines += [part * 40 + "tail" for part in parts]
    rows = list(enumerate(lines))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["text"]) for r in dedup_lines(frame).collect())
    assert found == expected(rows, classes)
    assert sum(bool(text) for _, text in found) < len(rows) / 2


def test_every_line_has_its_bands(spark):
    rows = [(n, unit * count) for n, (unit, count) in enumerate([("a", 4000), ("word ", 900), ("-", 80), ("-", 300), ("x", 1), ("0123456789", 600)])]
    frame = spark.createDataFrame(rows, "id long, line string")
    lines = frame.withColumn("size", distinct_shingles(frame["line"]))
    signed = band_keys(lines).collect()
    assert {r["id"] for r in signed} == {n for n, _ in rows} and all(len(r["keys"]) == BANDS for r in signed)
    keys = {r["id"]: r["keys"] for r in signed}
    assert keys[2] == keys[3]
