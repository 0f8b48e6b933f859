"""Distributed connected components, and links between rows that share bucket keys.

Nothing here collects rows: the driver only sees counts and checksums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.scratch import Scratch, small

#: Cross-class pairs per bucket entry up to which the last round goes through them all: without, and with a test within the join.
PAIRS_PER_ENTRY, TESTED_PER_ENTRY = 0.25, 16.0


def _are_stars(links: DataFrame) -> bool:
    """Whether each id of ``links`` (hi, lo) points at one other id and is pointed at by none, or the reverse."""
    ends = links.select(F.explode(F.array(F.struct(F.col("hi").alias("id"), F.lit(1).alias("points")), F.struct(F.col("lo").alias("id"), F.lit(0).alias("points")))).alias("e"))
    per_id = ends.groupBy("e.id").agg(F.sum("e.points").alias("out"), F.count(F.lit(1)).alias("n"))
    return per_id.where((F.col("out") > 1) | (F.col("out") == 1) & (F.col("n") > 1)).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) of bigint to (id, component), the smallest id reachable; ids without a link are left out.

    Large-star and small-star steps in turn: each step points a node's neighbours at the smallest one, so
    the number of rounds follows the logarithm of the longest path. A hub's links are reduced by ``min`` on the map side
    and joined back on the hub, a join that adaptive execution may split. Null ends and loops are ignored; no edges give
    no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = scratch.put(links)
    while not _are_stars(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        after = scratch.put(small.select("e.*").where("hi <> lo").distinct())
        scratch.drop(links)
        links = after
    members = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)


def _merged(classes: DataFrame | None, held: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` (id, component) joined up by links between them, ``held`` (ca, cb); an id without a class is its own."""
    joined = connected_components(held.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    if classes is None:
        return scratch.put(joined)
    moved = classes.withColumnRenamed("component", "was").join(joined.select(F.col("id").alias("was"), F.col("component").alias("now")), "was", "left")
    added = joined.join(classes.select("id"), "id", "left_anti").select("id", "component")
    return scratch.put(moved.select("id", F.coalesce("now", "was").alias("component")).unionByName(added))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are in different classes, with these as ca and cb."""
    for end in "ab":
        own = classes.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.drop(f"c{end}").join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb")


def link_buckets(
    entries: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    facts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    near: Callable[[str, str], Column] | None = None,
    finer: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """Components over all verified links between ids that share a key.

    ``entries`` (key, id bigint) may repeat; ``verify`` keeps those of the rows (a, b, ...) that hold. Returns (id, component) of
    linked ids. ``near("a", "b")`` is a cheap test that every pair that holds passes, over the columns of ``facts`` (id, ...) with
    the suffixes _a and _b, or over a and b themselves; it is part of the join, so that pairs that fail it are never written. Facts
    that are dear are given as a function of the ids (id) they are wanted for, and not used in the first round. ``finer``, such a
    function and its test, takes the place of both from the second round on, in which many members are compared with many.

    A bucket is not expanded into its pairs. In a round, one member each of its smallest classes is compared with all members
    of other classes and then leaves the bucket; members of one class need no comparison among themselves. The number of such
    members grows fourfold with each round, so the rounds follow the logarithm of the bucket. They end when the pairs between different
    classes are in proportion to the entries, and those are compared outright. So no link between two classes is
    lost, and a bucket of copies costs as much as it has members.

    Within a round each member is first compared with the one it shares most keys with, and with the others only if that left them
    in different classes. Only links between classes are kept, so that their number stays below that of the ids. A pair that
    shares several buckets may be verified again in a later round; no record of compared pairs is kept.
    """
    rest = scratch.put(entries.where("key is not null and id is not null").distinct())
    entry_count = rest.count()
    # A member that shares large buckets is central to them, and soonest found like the others.
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = scratch.put(rest.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("weight")))
    listed = PAIRS_PER_ENTRY if near is None else TESTED_PER_ENTRY
    classes, compared_at_once = None, 1
    while True:
        labelled = rest if classes is None else rest.join(classes, "id", "left")
        own = F.col("id") if classes is None else F.coalesce("component", "id")
        labelled = scratch.put(labelled.select("key", "id", own.alias("component")).join(weights, "id"))
        # One row per bucket and class first, so that a hot bucket of copies meets as few rows.
        per_class = labelled.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.max_by("id", F.struct("weight", -F.col("id"))).alias("first")
        )
        per_key = per_class.groupBy("key").agg(
            F.count(F.lit(1)).alias("classes"), ((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.pow("n", F.lit(2)))) / 2).alias("pairs")
        )
        open_keys = scratch.put(per_key.where("classes > 1"))
        totals = open_keys.agg(F.count(F.lit(1)).alias("keys"), F.sum("pairs").alias("pairs")).first()
        if not totals["keys"]:
            scratch.drop(open_keys, labelled)
            break
        few = small(open_keys.select("key"), totals["keys"])
        todo = labelled.join(few, "key", "left_semi")
        # Members alike to one member each make links in proportion to the entries, which all pairs do not.
        last = totals["pairs"] <= (listed if compared_at_once > 1 else PAIRS_PER_ENTRY) * entry_count
        if last:
            reps = todo.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
        else:
            # The others of a small class soonest agree, so it is compared first.
            order = Window.partitionBy("key").orderBy("n", F.desc("weight"), "first")
            ranked = per_class.join(few, "key", "left_semi").withColumn("rank", F.row_number().over(order))
            reps = scratch.put(ranked.where(F.col("rank") <= compared_at_once).select("key", F.col("first").alias("a"), F.col("component").alias("ca")))
        others = todo.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
        met = F.expr("ca < cb" if last else "ca <> cb")
        left, right, known = reps, others, None
        if compared_at_once > 1 and finer is not None:
            facts, near = finer
        # One member a bucket makes no more pairs than entries, for which dear facts do not pay.
        if near is not None and (compared_at_once > 1 or not callable(facts)):
            if callable(facts):
                known = scratch.put(facts(todo.select("id").distinct()))
            elif facts is not None:
                known = facts
            if known is not None:
                left, right = with_facts(left, known, "a"), with_facts(right, known, "b")
            met = met & near("a", "b")
        pairs = left.join(right, "key").where(met).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))
        nearest = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
        compared = scratch.put(pairs.withColumn("turn", F.row_number().over(nearest)))
        held = scratch.put(verify(compared.where("turn = 1")).select("ca", "cb").distinct())
        classes = _merged(classes, held, scratch)
        # The same two may have met as each other's b.
        others = _apart(compared.where("turn > 1"), classes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        others = scratch.put(others.distinct())
        if not others.isEmpty():
            held = scratch.put(verify(others).select("ca", "cb").distinct())
            classes = _merged(classes, held, scratch)
        scratch.drop(compared, others)
        if callable(facts) and known is not None:
            scratch.drop(known)
        if last:
            break
        left = todo.join(reps.select("key", F.col("a").alias("id")), ["key", "id"], "left_anti")
        smaller = scratch.put(left.select("key", "id"))
        scratch.drop(rest, open_keys, labelled, reps)
        rest, compared_at_once = smaller, compared_at_once * 4
    return classes if classes is not None else rest.select("id", F.col("id").alias("component")).limit(0)


def with_facts(side: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """``side`` with the columns of ``facts`` (id, ...) for its column ``name``, which is their suffix."""
    # Facts are numbers and never null; that they are not said to be keeps the code of a test over many of them short enough to be compiled.
    renamed = facts.select(*[F.col(c).alias(name) if c == "id" else F.coalesce(c, F.lit(0)).alias(f"{c}_{name}") for c in facts.columns])
    return side.join(renamed, name)
