import math
import random
import re
import time

from pyspark.sql import functions as F

from gaugework.llm.sanitise import sanitise

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def expected(texts, generalise=0.85, remove=0.95, min_texts=3):
    """Per text its terms beyond the thresholds with their kind; both ways of counting, e-mail addresses only."""
    words = [{w.lower() for w in re.findall(r"[^\W_]+", re.sub(EMAIL, " ", t))} for t in texts]
    values = [{m[0].lower() for m in re.finditer(EMAIL, t)} for t in texts]
    shares = {}
    for value in set().union(*values):
        at = [n for n, found in enumerate(values) if value in found]
        for term in set().union(*(words[n] for n in at)):
            both = [n for n in at if term in words[n]]
            different, among, seen = len({texts[n] for n in both}), sum(term in w for w in words), len(both)
            if different < min_texts:
                seen, among = different, among - len(both) + different + 1
            shares[value, term] = math.log2(len(texts) * seen / (among * len(at))) / math.log2(len(texts) / len(at))
    out = []
    for n in range(len(texts)):
        best = {t: max(shares[v, t] for v in values[n] if (v, t) in shares) for t in words[n] if values[n] and any((v, t) in shares for v in values[n])}
        out.append({(t, "removed" if s >= remove else "generalised") for t, s in best.items() if s >= generalise})
    return out


def test_terms_of_random_texts(spark):
    pick = random.Random(7)
    common, rare = [f"c{n}" for n in range(12)], [f"r{n}" for n in range(150)]
    texts = []
    for n in range(600):
        words = pick.choices(common, k=6) + pick.choices(rare, k=2)
        if n % 5 == 0:
            person = pick.randrange(30)
            words += [f"person{person}@x.org", f"name{person}", *([f"person{person + 1}@x.org"] if n % 3 == 0 else [])]
        pick.shuffle(words)
        texts += [" ".join(words)] * (3 if n % 50 == 0 else 1)
    rows = sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: {(s["value"].lower(), s["kind"]) for s in r["term_spans"]} for r in rows}
    wanted = expected(texts)
    assert sum(map(len, wanted)) > 100 and {kind for terms in wanted for _, kind in terms} == {"removed", "generalised"}
    assert [found[n] for n in range(len(texts))] == wanted


def test_thousands_of_addresses_in_one_text(spark):
    text = " ".join(f"user{n}@list.org," for n in range(8_000))
    begun = time.monotonic()
    row = sanitise(spark.createDataFrame([(0, text), (1, "a note")], "doc_id long, text string")).where("doc_id = 0").first()
    assert time.monotonic() - begun < 60
    assert [(s["start"], s["end"]) for s in row["base_spans"]] == [m.span() for m in re.finditer(EMAIL, text)]
    assert row["sanitised"] == " ".join(["[EMAIL],"] * 8_000)


def test_columns_of_the_caller_stay(spark):
    frame = spark.createDataFrame([(0, "a@b.cc"), (1, None)], "doc_id long, text string")
    names = ["__row", "__text", "__digest", "__base", "__term", "__blank", "a.b"]
    rows = sanitise(frame.select("*", *[F.lit(n).alias(n) for n in names], F.lit(1).alias("base_spans"))).orderBy("doc_id").collect()
    assert [[r[n] for n in names] for r in rows] == [names, names]
    assert [r["sanitised"] for r in rows] == ["[EMAIL]", None]
