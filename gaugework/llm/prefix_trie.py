"""The prefix trie of conversations, from whole sequences.

Equal conversations collapse to one weighted sequence with a list of those that end there. Sequences that are proper prefixes of others are
found by an anti-join; the rest are the leaves. All figures of a node are then sums over the weighted prefixes of the distinct sequences,
so a turn shared by a third of all conversations is a sum with map-side partial results, never a group in one task.

Texts are read once: from then on a turn is a digest and a length, and a prefix is its depth with two 64-bit sums (exclusive or of a hash of
each turn with its place), which a running window gives without holding a conversation. Two different prefixes of one depth count as
equal if both sums agree, once in some 10^38 pairs.

A node belongs to its smallest member. What a sequence owns is the end of its path, from depth ``own`` on, because its deeper nodes have
fewer members; so each node is counted once in sums over the distinct nodes of a subtree, without a second look at the tree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.scratch import Scratch

#: Conversations whose first turns may come from the same one, and the least number of turns that is never shared.
GROUP, NOT_SHARED = 100, 6
#: Ids of one piece of a list of ends at most.
PIECE_IDS = 512
KEY = ["depth", "key1", "key2"]


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node; ``ends``: (depth, key1, key2, conv_id) of the node each conversation ends at."""

    nodes: DataFrame
    ends: DataFrame

    def with_ends(self) -> DataFrame:
        """The nodes with ``ends_sha256``, the digest of the ids that end there: ascending, joined by commas."""
        digests = end_digests(self.ends)
        nothing = hashlib.sha256(b"").hexdigest()
        return self.nodes.join(digests, KEY, "left").fillna(nothing, ["ends_sha256"])

    def with_turns(self, turns: DataFrame) -> DataFrame:
        """The nodes with role and text of their last turn, from the turns they were made of."""
        known = _measured(turns, keep=True).groupBy("turn_key").agg(F.min(F.struct("role", "text")).alias("last"))
        return self.nodes.join(known, "turn_key", "left").select("*", "last.role", "last.text").drop("last")


def _measured(turns: DataFrame, keep: bool = False) -> DataFrame:
    """Turns without their texts: null roles and texts are empty ones, and rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    kept = [role.alias("role"), text.alias("text")] if keep else []
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", key.alias("turn_key"), F.length(text).cast("bigint").alias("chars"), *kept)


def rebuilt_turns(turns: DataFrame, group: int = GROUP, not_shared: int = NOT_SHARED) -> DataFrame:
    """(conv_id, part, pos, turn_key, chars): the turns of every conversation, its first ones taken from the first of its group.

    Conversation c begins with the first h turns of conversation c - c % group, h = crc32 of c in decimal modulo ``not_shared``; its own turns
    after its first h follow. A row of part 0 stands for the conversation itself. Turns are ordered by ``turn``, null first; those
    of equal ``turn`` by their digest. Repeated rows are turns each.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    own = _measured(turns).withColumn("pos", F.row_number().over(order).cast("bigint")).drop("turn")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % not_shared).alias("shared")
    convs = own.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("first"), shared)
    # A group has at most `group` conversations below zero and as many above, so the join makes a bounded number of rows of each turn.
    heads = own.where((F.col("conv_id") % group == 0) & (F.col("pos") < not_shared)).withColumnRenamed("conv_id", "first")
    taken = convs.join(heads, "first").where("pos <= shared")
    start = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("chars"))
    return start.unionByName(taken.select("conv_id", F.lit(1).alias("part"), "pos", "turn_key", "chars")).unionByName(
        own.where(F.col("pos") > shared).select("conv_id", F.lit(2).alias("part"), "pos", "turn_key", "chars")
    )


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its key, its last turn, and the characters of the texts before that."""
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rebuilt.withColumn("depth", (F.row_number().over(order) - 1).cast("bigint"))
    lanes = [F.xxhash64("depth", "turn_key"), F.xxhash64("turn_key", F.lit("turn"), "depth")]
    keys = [F.bit_xor(F.when(F.col("depth") > 0, lane).otherwise(F.lit(0).cast("bigint"))).over(so_far).alias(name) for lane, name in zip(lanes, KEY[1:])]
    before = (F.sum("chars").over(so_far) - F.col("chars")).alias("before")
    return numbered.select("conv_id", "depth", *keys, before, "chars", "turn_key")


def conversation_trie(rebuilt: DataFrame) -> Trie:
    """The trie over conversations given as :func:`rebuilt_turns` returns them.

    ``nodes`` has depth, key1, key2, turn_key (of the last turn, null for the root), conv_id (smallest member), parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes of the subtree) and saved_tokens (over the subtree, n_convs - 1 times the
    code points of the last text). No conversations give no nodes.
    """
    scratch = Scratch(rebuilt.sparkSession, "trie")
    prefixes = scratch.put(_prefixes(rebuilt))
    last = F.max(F.struct("depth", "key1", "key2", (F.col("before") + F.col("chars")).alias("total")))
    whole = prefixes.groupBy("conv_id").agg(last.alias("last")).select("conv_id", "last.*")
    ends = scratch.put(whole)
    sequences = ends.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.max("total").alias("total"))
    sequences = scratch.put(sequences)

    # The prefixes of one conversation of each sequence, and the nodes they are.
    facts = sequences.select("conv_id", F.col("depth").alias("size"), "weight", "total")
    paths = prefixes.join(facts, "conv_id")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max(F.col("depth") < F.col("size")).alias("goes_on"))
    nodes = scratch.put(nodes)
    leaves = sequences.join(nodes.where("goes_on").select(*KEY), KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # Where a sequence's own nodes begin, and the node they hang on.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("own"))
    placed = facts.join(owned, "conv_id", "left").withColumn("own", F.coalesce("own", F.col("size") + 1))
    branch = prefixes.join(placed.select("conv_id", "own"), "conv_id").where(F.col("depth") == F.col("own") - 1)
    branch = branch.select("conv_id", *KEY, (F.col("before") + F.col("chars")).alias("shared_chars"))
    hung = branch.join(nodes.select(*KEY, F.col("owner").alias("hangs_on")), KEY).select("conv_id", "shared_chars", "hangs_on")
    known = scratch.put(placed.join(hung, "conv_id", "left").join(leaves, "conv_id", "left").fillna(0, ["leaf"]))

    depth, own, size, total, before = (F.col(name) for name in ("depth", "own", "size", "total", "before"))
    parent = F.when(own < depth, F.col("conv_id")).when(own == depth, F.col("hangs_on"))
    child = F.when((own == depth + 1) & (own <= size) | (own <= depth) & (size > depth), 1).otherwise(0)
    once = F.when(own <= depth, before).otherwise(F.col("shared_chars"))
    summed = prefixes.join(known, "conv_id").groupBy(*KEY).agg(
        F.max("turn_key").alias("turn_key"),
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(child).cast("bigint").alias("n_children"),
        F.sum("leaf").cast("bigint").alias("n_leaves"),
        (F.sum(F.col("weight") * (total - before)) - F.sum(total - once)).alias("saved_tokens"),
    )
    return Trie(summed, ends.select(*KEY, "conv_id"))


def end_digests(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(depth, key1, key2, ends_sha256) of the nodes where conversations end.

    A list is written in pieces of neighbouring ids, bounded in size and made wherever they fall; the digest then takes a node's
    pieces in order, holding one at a time, as a digest cannot be made from parts.
    """
    place = F.floor(F.col("conv_id") / F.lit(piece_ids)).cast("bigint") if piece_ids == 1 else F.expr(f"(conv_id - pmod(conv_id, {piece_ids})) div {piece_ids}")
    text = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ends.groupBy(*KEY, place.alias("piece")).agg(text.alias("ids"))
    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")

    def run(batches):
        current, digest = None, None

        def finished(keys, digests):
            columns = [pa.array([key[i] for key in keys], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            keys, digests = [], []
            for *key, ids in zip(*[column.to_pylist() for column in batch.columns]):
                if key != current:
                    if current is not None:
                        keys.append(current)
                        digests.append(digest.hexdigest())
                    current, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield finished(keys, digests)
        if current is not None:
            yield finished([current], [digest.hexdigest()])

    return dealt.mapInArrow(run, "depth bigint, key1 bigint, key2 bigint, ends_sha256 string")
