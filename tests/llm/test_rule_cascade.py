import random
import re
from collections import Counter

import pytest
from compare import connect, differences

from gaugework.llm import registry
from gaugework.llm.rule_cascade import BASE, RULES, Measures, Rule, estimate_rules, expected_seconds, order_rules, quality_cascade

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    """The base figures by the plainest counting."""
    text = text or ""
    words = _WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, window in enumerate(windows) if times[window] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(_WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def some_texts():
    rng = random.Random(5)
    words = ["the", "a", "é", "x#", " ", "\x1f", " ", "😀", "|", "of"]
    made = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", "\r\n", "\x0c"]) for _ in range(rng.choice([1, 3, 5, 60, 300]))) for _ in range(200)]
    return [None, "", " \n\t", "one", "a a a", "a a a a", "x " * 100_000, "\x1c", *made]


def test_base_figures_equal_plain_counting(spark):
    texts = list(enumerate(some_texts()))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    made = {row[0]: tuple(row)[1:] for row in quality_cascade(docs, order=RULES).select("doc_id", *BASE, "base_failed").collect()}
    for i, text in texts:
        wanted = figures(text)
        assert made[i] == (*wanted, wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0]), repr(text)[:80]


def page(*lines):
    return "\n".join(lines)


_RNG = random.Random(3)
CLEAN = page(*[f"Line {a} " + " ".join("".join(_RNG.choices("aeioumnrst", k=_RNG.randint(2, 7))) for _ in range(9)) + " mill." for a in "abcdefghij"])


@pytest.mark.parametrize(
    "name, text",
    [
        ("symbols", re.sub(r"(\w+) (\w+) ", r"\1# \2$ ", CLEAN)),
        ("word_length", " ".join(f"{'abcdefgh'[k % 8]}{'ijklmnop'[k // 8]}" * 9 for k in range(60))),
        ("repeated_lines", page(*[f"{w}{v} {w}x {v}y {w}z{v}" for w in "abcd" for v in "efgh"], *["end."] * 40)),
        ("letters", " ".join(f"{n * 37 % 1009}.{n * 91 % 997}" for n in range(80))),
        ("shouting", CLEAN.upper()),
        ("hard_ends", re.sub(r"(\w+) ", r"\1!! ", CLEAN)),
        ("ellipses", CLEAN.replace("mill.", "mill...")),
        ("bullets", re.sub(r"(?m)^", "- ", CLEAN)),
    ],
)
def test_each_rule_rejects_its_kind_and_leaves_the_clean_page(name, text):
    assert not Measures(text).base_failed
    assert [rule.name for rule in RULES if rule.rejects(Measures(text))] == [name]
    assert not any(rule.rejects(Measures(CLEAN)) for rule in RULES)


def test_the_order_changes_the_work_but_not_the_verdict(spark, documents):
    ways = [quality_cascade(documents, order=order) for order in (RULES, RULES[::-1])] + [quality_cascade(documents)]
    verdicts = [sorted(map(tuple, way.select("doc_id", *BASE, "base_failed", "kept").collect())) for way in ways]
    assert verdicts[0] == verdicts[1] == verdicts[2] and len(verdicts[0]) == documents.count()
    for row in ways[0].where("rules_run > 0").select("kept", "failed_rule", "rules_run").collect():
        assert row["kept"] == (row["failed_rule"] is None)
        assert row["rules_run"] == (len(RULES) if row["kept"] else [r.name for r in RULES].index(row["failed_rule"]) + 1)


def test_order_is_by_rejections_of_what_is_left_per_second():
    rules = [Rule(name, lambda m: False) for name in "abc"]
    # a and b reject the same 60 texts, c 20 others; b is the cheapest of the two.
    masks = {0b011: 60, 0b100: 20, 0: 20}
    order = order_rules(rules, masks, [2.0, 1.0, 1.0])
    assert [e.rule.name for e in order] == ["b", "c", "a"]
    assert [(e.rejected, e.rejected_here) for e in order] == [(60, 60), (20, 20), (60, 0)]
    cheapest = min(expected_seconds([order[i] for i in p], masks, rules) for p in [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)])
    assert expected_seconds(order, masks, rules) == pytest.approx(cheapest)


def test_the_sample_is_bounded_and_measured(spark, documents):
    rules = [Rule("never", lambda m: False), Rule("always", lambda m: True), Rule("dear", lambda m: sum(range(200_000)) < 0)]
    found = estimate_rules(documents.repartition(2), rules, sample_rows=5)
    assert [e.rule.name for e in found][0] == "always" and [e.rule.name for e in found][-1] == "dear"
    assert {e.rule.name: e.rejected for e in found} == {"always": 10, "never": 0, "dear": 0}
    assert estimate_rules(documents, []) == [] and len(estimate_rules(documents.limit(0))) == len(RULES)
    with pytest.raises(ValueError):
        estimate_rules(documents, [rules[0], rules[0]])


def test_nulls_repeats_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, CLEAN, 1, "x"), (5, None, 2, "y"), (5, CLEAN, 3, "z"), (5, CLEAN, 3, "z")], "doc_id bigint, text string, n_words int, kept string")
    made = quality_cascade(docs)
    assert sorted((row["doc_id"] or -1, row["base_failed"], row["kept"]) for row in made.collect()) == [(-1, False, True), (5, False, True), (5, False, True), (5, True, False)]
    assert quality_cascade(docs.limit(0)).count() == 0


def test_labelled_documents(spark, documents, sf_dir):
    """Documents labelled poor go, good ones that pass the base limits stay."""
    judged = quality_cascade(documents).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert judged.where("quality = 0 and kept").count() == 0
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0


def test_query_matches_sql(spark, sf_dir):
    query, sql = registry.REGISTRY["op12_rules"]
    assert differences(query(spark, sf_dir), connect(sf_dir), sql) is None
