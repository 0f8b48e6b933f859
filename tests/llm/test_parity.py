import random

from pyspark.sql import functions as F

from gaugework.llm.parity import near, parities


def test_no_similar_pair_fails_the_test_and_most_others_do(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
    sets = {}
    for n in range(120):
        size = rng.choice([3, 5, 40, 400])
        changed = rng.randrange(0, 1 + size // 2)
        sets[n] = set(base[:size][changed:]) | {rng.getrandbits(64) - (1 << 63) for _ in range(changed)}
    rows = [(n, len(s), h) for n, s in sets.items() for h in s]
    facts = parities(spark.createDataFrame(rows, "id long, size int, h long"))
    left, right = (facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns]) for side in "ab")
    kept = {(r[0], r[1]) for r in left.join(right, F.expr("id_a < id_b")).where(near(0.8)("a", "b")).select("id_a", "id_b").collect()}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    assert similar and similar <= kept
    assert len(kept) < len(similar) + 0.2 * len(sets) ** 2 / 2
