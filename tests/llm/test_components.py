import random

from pyspark.sql import functions as F

from gaugework.llm.components import connected_components, link_buckets
from gaugework.llm.scratch import Scratch


def _found(frame):
    return {row["id"]: row["component"] for row in frame.collect()}


def test_random_graph_a_path_and_a_hub(spark, classes):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    expected = classes({n for e in edges for n in e})
    for a, b in edges:
        expected.link(a, b)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    found = _found(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")))
    assert found == {n: expected.find(n) for n in touched}


def test_links_that_are_stars_are_final(spark):
    """Two hubs with leaves need no step; a leaf of both does."""
    stars = [(1, n) for n in range(10, 15)] + [(2, n) for n in range(20, 25)]
    for edges, hubs, most in ((stars, {1: 1, 2: 2}, 1), (stars + [(2, 14)], {1: 1, 2: 1}, 4)):
        scratch = Scratch(spark, "test")
        found = _found(connected_components(spark.createDataFrame(edges, "a long, b long"), scratch))
        assert found == {n: hubs[hub] for hub, leaf in edges if leaf != 14 or hub == 1 for n in (hub, leaf)}
        assert scratch._count <= most


def test_no_links_and_null_ends(spark):
    frame = spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")
    assert _found(connected_components(frame, Scratch(spark, "test"))) == {}


def test_buckets_find_every_link_without_listing_all_pairs(spark, classes):
    """Chains, a large bucket of copies with an outsider, and buckets in which nothing links."""
    rng = random.Random(8)
    entries = [(1, n) for n in range(300)] + [(2, n) for n in (295, 500, 503, 506, 900)] + [(3, n) for n in range(1000, 1400, 10)]
    entries += [(rng.randrange(10, 20), rng.randrange(2000, 2200)) for _ in range(150)] + [(None, 1), (4, None)]
    members = {}
    for key, item in entries:
        if key is not None and item is not None:
            members.setdefault(key, set()).add(item)
    expected = classes({n for m in members.values() for n in m})
    linked = set()
    for group in members.values():
        for a in group:
            for b in group:
                if 0 < b - a <= 3:
                    expected.link(a, b)
                    linked |= {a, b}

    def verify(pairs):
        return pairs.where(F.abs(F.col("a") - F.col("b")) <= 3)

    found = _found(link_buckets(spark.createDataFrame(entries, "key long, id long"), verify, Scratch(spark, "test")))
    assert found == {n: expected.find(n) for n in linked}


def test_a_bucket_of_copies_costs_as_much_as_it_has_members(spark):
    entries = spark.range(400).selectExpr("1L as key", "id").union(spark.sql("select 1L, 999999L"))
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.where("abs(a - b) < 1000")

    found = _found(link_buckets(entries, verify, Scratch(spark, "test")))
    assert found == dict.fromkeys(range(400), 0)
    assert sum(compared) < 2 * 401


def test_a_bucket_of_members_that_are_all_alike_is_no_square_of_pairs(spark):
    """Small enough that all pairs would be listed in a round, by a test within the join."""
    entries = spark.range(30).selectExpr("1L as key", "id").union(spark.range(30).selectExpr("2L", "id"))
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs

    facts = spark.range(30).selectExpr("id", "1L as size")
    for given in (facts, lambda ids: facts.join(ids, "id", "left_semi")):
        compared.clear()
        found = _found(link_buckets(entries, verify, Scratch(spark, "test"), given, lambda a, b: F.col(f"size_{a}") == F.col(f"size_{b}")))
        assert found == dict.fromkeys(range(30), 0)
        assert sum(compared) < 30


def test_members_that_only_the_second_choice_links(spark):
    """3 shares more keys with 1, which fails; 2, with which it shares one, holds."""
    entries = spark.createDataFrame([(k, n) for k in (1, 2) for n in (1, 3)] + [(3, n) for n in (2, 3)] + [(4, n) for n in (2, 4, 5)], "key long, id long")

    def verify(pairs):
        return pairs.where("least(a, b) in (2, 4) and abs(a - b) = 1 and greatest(a, b) <> 4")

    assert _found(link_buckets(entries, verify, Scratch(spark, "test"))) == {2: 2, 3: 2, 4: 4, 5: 4}
