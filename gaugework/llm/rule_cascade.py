"""Quality rules as a short-circuit cascade, ordered by what was measured on a sample.

Every text is measured once for the base figures. Further rules run one after another and stop at the first that rejects, so their order
decides the cost, never the verdict. The order comes from a sample: each rule is timed on each sampled text and its
verdict noted; then the rule with the most rejections per second among the texts that the rules before it leave over is put next.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled rows of each partition at most: a task takes its first ones and reads no further.
SAMPLE_ROWS = 64
#: The characters that separate words, those counted as symbols, and the base limits.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Measures:
    """The figures of one text, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # Splitting bytes takes the six ASCII separators only, as wanted.
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def lines(self) -> list[str]:
        """The lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a window of three words found at least twice."""
        if self.n_words < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(word, len(number)) for word in self.words], np.int64)
        # Pairs are numbered before the third word is added, so that no product grows beyond 64 bits.
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        found = times[window] > 1
        covered = np.zeros(len(ids), bool)
        for shift in range(3):
            covered[shift : len(ids) - 2 + shift] |= found
        return int(covered.sum())

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words


@dataclass(frozen=True)
class Rule:
    """A rule rejects texts; it may look at any figure."""

    name: str
    rejects: Callable[[Measures], bool]


_SHOUTED = re.compile(rb"[A-Z]|\xc3[\x80-\x96\x98-\x9e]")
_SPOKEN = re.compile(rb"[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]")
_HARD_END = re.compile(rb"[!?]{2}\Z")


def _is_shouted(word: bytes) -> bool:
    return not _SPOKEN.search(word) and len(_SHOUTED.findall(word)) > 1


#: What pages written for readers keep to in any language that separates words; limits leave room for lists, code and tables.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("letters", lambda m: 10 * sum(any(map(str.isalpha, word.decode("utf-8", "replace"))) for word in m.words) < 6 * m.n_words),
    Rule("shouting", lambda m: 2 * sum(map(_is_shouted, m.words)) > m.n_words),
    Rule("hard_ends", lambda m: 10 * sum(_HARD_END.search(word) is not None for word in m.words) > 3 * m.n_words),
    Rule("ellipses", lambda m: 10 * sum(line.rstrip(SPACES).endswith(("...", "…")) for line in m.lines) > 3 * len(m.lines)),
    Rule("bullets", lambda m: 10 * sum(line.lstrip(SPACES)[0] in "-*•" for line in m.lines) > 9 * len(m.lines)),
)


@dataclass(frozen=True)
class Estimate:
    """A rule with its seconds a text, and the texts of the sample that it, and that it first in its place, rejects."""

    rule: Rule
    seconds: float
    rejected: int
    rejected_here: int


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """One text at a time, as a batch may hold many long ones."""
    return (value.as_py() for value in batch.column("text"))


def estimate_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of a cascade, with what was measured on the sample.

    Every partition adds its first ``sample_rows`` rows that pass the base limits. What reaches the driver is one row for each set of rules
    that rejects a sampled text. Counts are smoothed by half a text, so that among rules that reject nothing the cheap ones come first.
    """
    if len(rules) > 62 or len({rule.name for rule in rules}) < len(rules):
        raise ValueError("at most 62 rules of different names")

    def run(batches):
        left = sample_rows
        for batch in batches:
            masks, seconds = [], []
            for text in _texts(batch):
                if left <= 0:
                    break
                m = Measures(text)
                if m.base_failed:
                    continue
                _ = [getattr(m, name) for name in BASE]
                left -= 1
                mask, took = 0, []
                for number, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(m)) << number
                    took.append(time.perf_counter() - began)
                masks.append(mask)
                seconds.append(took)
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(seconds, pa.list_(pa.float64()))], ["mask", "seconds"])
            if left <= 0:
                return

    if not rules:
        return []
    measured = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "mask bigint, seconds array<double>")
    sums = [F.sum(F.col("seconds")[number]).alias(f"s{number}") for number in range(len(rules))]
    found = measured.groupBy("mask").agg(F.count(F.lit(1)).alias("texts"), *sums).collect()
    return order_rules(rules, {row["mask"]: row["texts"] for row in found}, [sum(row[f"s{n}"] for row in found) for n in range(len(rules))])


def order_rules(rules: Sequence[Rule], masks: dict[int, int], seconds: Sequence[float]) -> list[Estimate]:
    """The cascade's order from the texts by the set of rules that rejects them (bit n: rule n) and each rule's seconds over all texts."""
    texts = max(1, sum(masks.values()))
    left, order = dict(masks), []
    waiting = list(range(len(rules)))
    while waiting:
        hits = {n: sum(count for mask, count in left.items() if mask >> n & 1) for n in waiting}
        best = max(waiting, key=lambda n: ((hits[n] + 0.5) / max(seconds[n], 1e-9), -n))
        waiting.remove(best)
        whole = sum(count for mask, count in masks.items() if mask >> best & 1)
        order.append(Estimate(rules[best], seconds[best] / texts, whole, hits[best]))
        left = {mask: count for mask, count in left.items() if not mask >> best & 1}
    return order


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """(doc_id, the base figures, base_failed, kept, failed_rule, rules_run) for each row of ``docs`` (doc_id, text).

    ``kept`` is false where the base limits or any rule fails. ``failed_rule`` is the first to reject and ``rules_run`` the number of rules
    tried; both depend on the order, which is measured by :func:`estimate_rules` unless ``order`` gives it. A null or empty text has no
    words and fails the base limits. Repeated rows are judged alike, an empty table gives no rows, and other columns are ignored.
    """
    cascade = list(order) if order is not None else [estimate.rule for estimate in estimate_rules(docs, rules)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} bigint" for name in BASE)

    def run(batches):
        for batch in batches:
            base, failed, kept, by, tried = [], [], [], [], []
            for text in _texts(batch):
                m = Measures(text)
                base.append([getattr(m, name) for name in BASE])
                failed.append(m.base_failed)
                at = next((n for n, rule in enumerate(cascade) if rule.rejects(m)), None) if not failed[-1] else None
                kept.append(not failed[-1] and at is None)
                by.append(None if at is None else cascade[at].name)
                tried.append(0 if failed[-1] else len(cascade) if at is None else at + 1)
            figures = [pa.array([row[n] for row in base], pa.int64()) for n in range(len(BASE))]
            columns = [batch.column("doc_id"), *figures, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(by, pa.string()), pa.array(tried, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "failed_rule", "rules_run"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, {fields}, base_failed boolean, kept boolean, failed_rule string, rules_run int")


def expected_seconds(order: Sequence[Estimate], masks: dict[int, int], rules: Sequence[Rule]) -> float:
    """The cost of a text in a cascade, by the sample: each rule is paid for by the texts that reach it."""
    number = {rule.name: n for n, rule in enumerate(rules)}
    texts = max(1, sum(masks.values()))
    reach = [reduce(lambda left, e: {m: c for m, c in left.items() if not m >> number[e.rule.name] & 1}, order[:k], masks) for k in range(len(order))]
    return sum(e.seconds * sum(left.values()) / texts for e, left in zip(order, reach))
