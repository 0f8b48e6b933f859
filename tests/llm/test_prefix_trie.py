import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences

from gaugework.llm import registry
from gaugework.llm.prefix_trie import conversation_trie, end_digests, rebuilt_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    role, text = role.encode(), text.encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def rebuilt(rows):
    """Conversations as lists of (role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    convs = {conv: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for conv, turns in convs.items()}
    made = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        made[conv] = convs.get(base, [])[:h] + own[h:]
    return made


def brute(rows):
    members = defaultdict(list)
    for conv, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((conv, len(turns)))
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    wanted = []
    for node, who in members.items():
        below = [v for v in members if v[: len(node)] == node]
        ends = sorted(conv for conv, size in who if size == len(node))
        wanted.append((
            min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who), len(children[node]), sum(not children[v] for v in below),
            sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(wanted, key=repr)


def trie(spark, rows):
    return conversation_trie(rebuilt_turns(spark.createDataFrame(rows, SCHEMA)))


def test_small_tables_equal_brute_force(spark):
    rng = random.Random(11)
    for size, words in ((300, "ab"), (150, "abc"), (40, "abcdefgh")):
        rows = []
        for conv in rng.sample(range(1_000), size):
            turns = list(range(rng.randint(1, 9)))
            rng.shuffle(turns)
            rows += [(conv, turn, "user" if turn % 2 else "assistant", rng.choice(words) * rng.randint(0, 2)) for turn in turns]
        assert sorted(map(tuple, trie(spark, rows).with_ends().select(*FIELDS).collect()), key=repr) == brute(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, None, "user", "x"), (0, 3, "user", ""), (0, 3, "user", "y"), (0, 3, "user", "y"),
        (7, 0, None, "x"), (7, 0, None, "x"), (7, 1, "a", "😀é\n"), (150, 0, "u", "z"), (-5, 0, "u", "q"), (-105, 2, "u", "q"), (-100, 2, "u", "q" * 5),
        *[(c, 0, "u", "same") for c in range(200, 290)], *[(c, 0, "u", "only one") for c in range(301, 320)], (12, 1, "", ""), (13, 0, None, None),
    ]
    made = sorted(map(tuple, trie(spark, rows).with_ends().select(*FIELDS).collect()), key=repr)
    assert made == brute(rows)
    turnless = [conv for conv, turns in rebuilt(rows).items() if not turns]
    assert turnless, "some conversation should be left without turns"


def test_very_long_conversations_and_hot_sequences(spark):
    rows = [(c, t, "u", "w" * (t % 7)) for c in (100, 101) for t in range(3_000)] + [(c, t, "u", f"turn {t}") for c in range(1_000, 4_000) for t in range(2)]
    table = trie(spark, rows)
    made = {(row["depth"], row["conv_id"]): row for row in table.with_ends().collect()}
    assert max(depth for depth, _ in made) == 3_000
    ends = defaultdict(list)
    for conv, turns in rebuilt(rows).items():
        ends[tuple(turns)].append(conv)
    for turns, convs in ends.items():
        if len(convs) > 1_000:
            wanted = hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()
            assert wanted in {row["ends_sha256"] for row in made.values() if row["depth"] == len(turns)}
    assert made[0, 100]["n_convs"] == 3_002 and made[0, 100]["parent_conv_id"] is None
    assert end_digests(table.ends).exceptAll(end_digests(table.ends, 7)).count() == 0
    assert end_digests(table.ends, 1).exceptAll(end_digests(table.ends, 7)).count() == 0


def test_turns_come_back_and_other_columns_do_no_harm(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "s", "b"), (2, 0, "u", "a"), (3, 0, "u", None)]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as pos", "'x' as part", "4 as first")
    table = conversation_trie(rebuilt_turns(turns, group=1, not_shared=1))
    last = {(row["depth"], row["conv_id"]): (row["role"], row["text"]) for row in table.with_turns(turns).collect()}
    assert last == {(0, 1): (None, None), (1, 1): ("u", "a"), (2, 1): ("s", "b"), (1, 3): ("u", "")}


def test_an_empty_table_has_no_nodes(spark):
    assert trie(spark, []).with_ends().count() == 0
    assert trie(spark, [(None, 1, "a", "b")]).with_ends().count() == 0


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    query, sql = registry.REGISTRY["op13_trie"]
    frame = query(spark, sf_dir)
    assert differences(frame, connect(sf_dir), sql) is None
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, frame.select(*FIELDS).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("name", ["op11_", "op12_", "op13_"])
def test_new_operators_are_registered_once(name):
    assert sum(query.startswith(name) for query in registry.queries()) == 1
