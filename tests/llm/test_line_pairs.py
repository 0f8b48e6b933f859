import random

from gaugework.llm import components, fuzzy_lines
from gaugework.llm.fuzzy_lines import band_keys
from gaugework.llm.parity import FINE_WORDS, WORDS
from gaugework.llm.scratch import Scratch
from pyspark.sql import functions as F


def _words(rng, count):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(count)]


def test_lines_with_a_few_common_phrases_seldom_meet(spark):
    """Jaccard 0.2, as of long lines of one language: under three rows a band one pair of sixteen met."""
    rng = random.Random(4)
    common = " ".join(_words(rng, 14))
    lines = spark.createDataFrame([(n, common + " " + " ".join(_words(rng, 26))) for n in range(200)], "id long, line string")
    keys = band_keys(lines).select("id", F.explode("keys").alias("key"))
    met = keys.join(keys.withColumnRenamed("id", "other"), "key").where("id < other").select("id", "other").distinct().count()
    assert met < 200 * 199 / 2 / 40


def test_variants_of_one_template_are_ruled_out_by_the_finer_test(spark):
    """Long lines that vary one template all pass 512 places, and mostly not 2,048; similar ones pass both."""
    rng = random.Random(5)
    base = _words(rng, 80)
    rows = []
    for n in range(60):
        changed = set(rng.sample(range(80), 4 if n < 50 else 1))
        rows.append((n, " ".join(word if at not in changed else _words(rng, 1)[0] for at, word in enumerate(base))))
    lines = spark.createDataFrame(rows, "id long, line string")
    sets = {n: {line[i : i + 7] for i in range(len(line) - 6)} for n, line in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    passed = []
    for words in (WORDS, FINE_WORDS):
        facts = fuzzy_lines._facts(lines, words).join(band_keys(lines).select("id", *fuzzy_lines.PRINT), "id")
        left, right = (facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns]) for side in "ab")
        passed.append({(r[0], r[1]) for r in left.join(right, F.expr("id_a < id_b")).where(fuzzy_lines._is_near(words)("a", "b")).select("id_a", "id_b").collect()})
        assert similar <= passed[-1]
    others = 60 * 59 / 2 - len(similar)
    assert len(passed[0] - similar) > others / 2 and len(passed[1] - similar) < others / 3


def test_a_finer_test_takes_over_from_the_second_round(spark):
    entries = spark.range(60).selectExpr("1L as key", "id")
    facts, asked = spark.range(60).selectExpr("id", "id as own"), []

    def finer(ids):
        asked.append(ids.count())
        return spark.range(60).selectExpr("id", "id div 30 as half")

    found = components.link_buckets(
        entries, lambda pairs: pairs.where("abs(a - b) = 1"), Scratch(spark, "test"), facts, lambda a, b: F.col(f"own_{a}") >= 0,
        (finer, lambda a, b: F.col(f"half_{a}") == F.col(f"half_{b}")),
    )
    # The first round compares all with one member.
    classes = {r["id"]: r["component"] for r in found.collect()}
    assert asked and set(classes) == set(range(60))
    assert len({classes[n] for n in range(30)}) == 1 == len({classes[n] for n in range(30, 60)})
