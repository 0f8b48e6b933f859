import random

from gaugework.llm import fuzzy_lines
from gaugework.llm.fuzzy_lines import BANDS, BLOCK, band_keys, line_components
from gaugework.llm.parity import FINE_WORDS, marks, near
from gaugework.llm.scratch import Scratch
from pyspark.sql import functions as F


def test_no_similar_pair_fails_the_test_though_elements_repeat(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    bags = {}
    for n in range(100):
        size = rng.choice([3, 9, 50, 300])
        changed = rng.randrange(0, 1 + size // 3)
        kept = base[:size][changed:] + [rng.getrandbits(64) - (1 << 63) for _ in range(changed)]
        bags[n] = kept + [rng.choice(kept) for _ in range(rng.choice([0, 1, size, 5 * size]))]
    elements = spark.createDataFrame([(n, h) for n, bag in bags.items() for h in bag], "id long, h long")
    sets = {n: set(bag) for n, bag in bags.items()}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    passed = []
    for words in (8, FINE_WORDS):
        facts = marks(elements, words)
        left, right = (facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns]) for side in "ab")
        passed.append({(r[0], r[1]) for r in left.join(right, F.expr("id_a < id_b")).where(near(0.8, words)("a", "b")).select("id_a", "id_b").collect()})
        assert similar and similar <= passed[-1]
    assert len(passed[1]) <= len(passed[0]) < len(sets) ** 2 / 4


def test_minima_over_blocks_are_those_over_all_shingles(spark):
    """Lines whose shingles end anywhere within a block."""
    lines = spark.createDataFrame([(n, "the quick brown fox"[: 7 + n]) for n in range(2 * BLOCK + 1)] + [(90, "abc"), (91, "x")], "id long, line string")
    found = {r["id"]: r["keys"] for r in band_keys(lines).collect()}
    rng = random.Random(fuzzy_lines.SEED)
    masks = [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS * fuzzy_lines.BAND_ROWS)]
    hashes = lines.select("id", F.explode(fuzzy_lines.shingles(F.col("line"))).alias("h")).collect()
    minima = {n: tuple(min(r["h"] ^ mask for r in hashes if r["id"] == n) for mask in masks) for n in found}
    for band in range(BANDS):
        rows = slice(band * fuzzy_lines.BAND_ROWS, (band + 1) * fuzzy_lines.BAND_ROWS)
        for a in found:
            for b in found:
                assert (found[a][band] == found[b][band]) == (minima[a][rows] == minima[b][rows])


def test_pairs_that_share_places_only_by_being_near_are_never_decided_by_their_lines(spark, monkeypatch):
    """Templates of Jaccard 0.5 and below meet in buckets; the marks rule them out from the first round on."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common = " ".join(word() for _ in range(24))
    rows = [(n, common + " " + " ".join(word() for _ in range(16))) for n in range(150)] + [(900, common + " tail"), (901, common + " tails")]
    decided = []
    jaccard = fuzzy_lines.jaccard

    def counted(left, right):
        decided.append(1)
        return F.when(F.abs(F.length(left) - F.length(right)) < 2, jaccard(left, right)).otherwise(F.raise_error(F.lit("decided")).cast("double"))

    monkeypatch.setattr(fuzzy_lines, "jaccard", counted)
    found = line_components(spark.createDataFrame(rows, "id long, line string"), Scratch(spark, "test")).collect()
    assert {r["id"]: r["component"] for r in found} == {900: 900, 901: 900} and decided
