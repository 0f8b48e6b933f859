import random

import numpy as np
from pyspark.sql import functions as F

from gaugework.llm import near_simhash
from gaugework.llm.near_simhash import MIN_EQUAL, PARTS, WORDS, sampled_print


def _similar_sets(rng, size, shared):
    hashes = [rng.getrandbits(64) for _ in range(2 * size - shared)]
    return [np.unique(np.array(part, dtype="<u8")) for part in (hashes[:size], hashes[size - shared :])]


def test_each_bit_is_the_majority_of_the_first_shingles_of_a_permutation():
    rng = random.Random(1)
    factors, inverses, summands = permutations = near_simhash._permutations()
    for size in (0, 1, 2, 3, 4, 5000, 9000):
        hashes = [rng.getrandbits(64) for _ in range(size)]
        expected = []
        for n in range(PARTS):
            factor, summand = int(factors[n, 0]), int(summands[n, 0])
            first = sorted(hashes, key=lambda h: (h * factor + summand) % 2**64)[:3]
            parts = [h >> 8 * (n % 8) & 255 for h in first]
            expected.append(sum(1 << bit for bit in range(8) if 2 * sum(part >> bit & 1 for part in parts) > len(parts)))
        assert sampled_print(np.array(hashes, dtype="<u8"), permutations).tolist() == expected
        assert (factors * inverses == 1).all()


def test_pairs_at_the_similarity_meet_in_the_index_and_pass_the_tally(spark):
    """The pipeline's candidates come from fingerprints: 300 pairs of sets of Jaccard 0.8, small and large ones."""
    rng = random.Random(2)
    permutations, rows = near_simhash._permutations(), []
    for n in range(300):
        for side, hashes in enumerate(_similar_sets(rng, *((9, 8), (90, 80), (450, 400))[n % 3])):
            rows.append((2 * n + side, len(hashes), *sampled_print(hashes, permutations).view("<i8").tolist()))
    words = [f"x{n}" for n in range(WORDS)]
    prints = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("id", "size", *words)))
    keys = near_simhash._part_postings(prints)
    left, right = (keys.join(prints, "id").select("key", *[F.col(c).alias(f"{c}_{s}") for c in prints.columns]) for s in "ab")
    met = left.join(right, "key").where("id_a < id_b").where(near_simhash._parts_near("a", "b")).select("id_a", "id_b").distinct()
    assert sorted((r[0], r[1]) for r in met.collect()) == [(2 * n, 2 * n + 1) for n in range(300)]


def test_the_tally_counts_equal_bytes(spark):
    """Bytes that differ in any one bit count as different; the sixteenth equal byte decides."""
    rng = random.Random(3)
    words = [f"x{n}" for n in range(WORDS)]
    rows = []
    for equal in (MIN_EQUAL - 1, MIN_EQUAL, MIN_EQUAL + 1, 64):
        for case in range(10):
            a = [rng.randrange(256) for _ in range(PARTS)]
            b = [v ^ (1 << rng.randrange(8)) for v in a]
            for place in rng.sample(range(PARTS), equal):
                b[place] = a[place]
            both = [np.array(v, dtype=np.uint8).view("<i8").tolist() for v in (a, b)]
            rows.append((equal >= MIN_EQUAL, 100, 100 if case else 80, *both[0], *both[1]))
    rows.append((False, 100, 79, *([0] * 16)))
    names = ["near", "size_a", "size_b", *[f"{w}_a" for w in words], *[f"{w}_b" for w in words]]
    frame = spark.createDataFrame(rows, "near boolean, " + ", ".join(f"{c} long" for c in names[1:]))
    assert frame.where(near_simhash._parts_near("a", "b") != F.col("near")).count() == 0
