import xxhash
from pyspark.sql import functions as F

from gaugework.llm.near_simhash import drop_near_duplicates, simhash_components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def expected_rows(rows, classes):
    prints = {(i, t): fingerprint(t) for i, t in rows}
    values = sorted(set(prints.values()))
    groups = classes(values)
    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if (a ^ b).bit_count() <= 2:
                groups.link(a, b)
    smallest = {}
    for (i, _), p in prints.items():
        root = groups.find(p)
        smallest[root] = min(smallest.get(root, i), i)
    return sorted((i, f"{prints[i, t]:016x}", smallest[groups.find(prints[i, t])]) for i, t in rows)


def test_whole_table_against_all_pairs(spark, documents, classes):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = simhash_components(documents)
    assert sorted(tuple(r) for r in found.collect()) == expected_rows(rows, classes)
    kept = {r["doc_id"] for r in drop_near_duplicates(documents).collect()}
    assert kept == {c for _, _, c in expected_rows(rows, classes)}


def test_odd_rows(spark, classes):
    long_text = " ".join(f"w{n % 977}" for n in range(30_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "ÀB c d"), (7, long_text), (8, long_text), (8, long_text), (9, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("id", F.lit(1))
    assert sorted(tuple(r) for r in simhash_components(frame).collect()) == expected_rows(rows, classes)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7, 9]


def test_unknown_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "q r s t")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_components(frame).collect()) == [(-1, -1), (-1, 7), (7, 7)]
    assert simhash_components(frame.limit(0)).collect() == []
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(frame).collect()) == ["7", "None", "None"]
