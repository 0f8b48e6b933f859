from pyspark.sql import functions as F

from gaugework.llm.fuzzy_lines import SHINGLE_CHARS, dedup_lines


def shingles(line):
    return frozenset(line[i : i + SHINGLE_CHARS] for i in range(max(1, len(line) - SHINGLE_CHARS + 1)))


def normal(line):
    return line.strip(" \t\r\f\v").lower()


def expected(rows, classes):
    """Every pair of different lines is compared."""
    sets = {normal(line): shingles(normal(line)) for _, text in rows for line in (text or "").split("\n") if normal(line)}
    lines = sorted(sets)
    groups = classes(lines)
    # A common shingle is the least that similar lines share.
    holders = {}
    for line in lines:
        for s in sets[line]:
            holders.setdefault(s, []).append(line)
    seen = set()
    for group in holders.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        groups.link(a, b)
    out, taken = [], set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            key = groups.find(normal(line)) if normal(line) else None
            if key is None or key not in taken:
                kept.append(line)
            taken.add(key)
        out.append((doc, None if text is None else "\n".join(kept)))
    return out


def test_whole_table_against_all_pairs(spark, documents, classes):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = dedup_lines(documents)
    assert found.columns == [*documents.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == expected(rows, classes)


def test_odd_rows(spark, classes):
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [
        (1, base + "\n\nshort\nabc"), (2, base.upper() + "  \nabc\nabc"), (3, base.replace("lazy", "lasy") + "\nown line of text"),
        (4, None), (5, ""), (6, "\n\n"), (7, "x" * 60_000 + "\n" + "words " * 20_000), (8, base), (9, "été\r\nété"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("clash")).withColumn("line", F.lit(0))
    for clash in ("__gone", "__own", "gone", "row", "drop_doc", "with.dot"):
        frame = frame.withColumn(clash, F.lit("own"))
    found = dedup_lines(frame).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in found] == expected(rows, classes)
    by_id = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in found}
    assert {r["__gone"] + r["gone"] + r["row"] + r["with.dot"] for r in found} == {"own" * 4}
    assert by_id[1] == (4, 0) and by_id[2] == (3, 3) and by_id[4] == (0, 0) and by_id[6] == (3, 0) and by_id[8] == (1, 1)


def test_repeated_rows_are_one_document_and_null_ids_come_first(spark):
    line = "a line that is long enough to be told apart"
    frame = spark.createDataFrame([(2, line), (2, line), (None, line)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(frame).collect()) == [("2", ""), ("2", ""), ("None", line)]
    assert dedup_lines(frame.limit(0)).collect() == []


def test_near_copies_in_one_hot_bucket(spark):
    """Hundreds of lines that differ in one word leave one."""
    rows = [(n, f"the common part of this line is long and stays the same every time number {n:04d} in the very same words") for n in range(300)]
    kept = [r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"]]
    assert [r["doc_id"] for r in kept] == [0]
