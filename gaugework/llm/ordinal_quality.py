"""Quality grades by ordinal regression: one weight vector over hashed text features, ordered thresholds for the grades.

P(grade <= k) = sigmoid(threshold_k - score), so one score gives the probability of every grade, the expected grade, and the
tail probability by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.llm.scratch import Scratch

#: Rated rows the model is fitted on, expected number at most; which ones is decided by a hash of the doc_id.
TRAINING_ROWS = 12_000
DIMENSIONS = 1 << 22
#: Features in fewer of the training rows keep a weight of zero.
MIN_ROWS = 4
RIDGE = 1.0
ITERATIONS, HISTORY = 30, 8
#: Documents are selected if they reach the top grade with at least this probability.
KEEP = 0.5
#: Remembered tokens per task; the memory is emptied when full.
CACHED = 300_000
SHARE_SCALE = 5.0
_WORD = re.compile(r"\w+")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


def _shape(token: str) -> str:
    """Letters by case, digits as 0, other characters as they are; runs count once."""
    out = ""
    for char in token:
        kind = "0" if char.isdigit() else ("A" if char.isupper() else "a") if char.isalpha() else char
        if not out.endswith(kind):
            out += kind
    return out


class _Hashed(dict):
    def __init__(self, prefix: str, name=lambda token: token):
        self.prefix, self.name = prefix, name

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[token] = value = _hash(self.prefix + self.name(token))
        return value


class Featurizer:
    """Features of whole texts: which words occur, and what share of the tokens has which shape or repeats the one before."""

    def __init__(self):
        self.words, self.shapes = _Hashed("w"), _Hashed("s", _shape)
        self.repeat, self.again = _hash("r"), _hash("d")

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values), each index once; no text gives no features."""
        tokens = (text or "").split()
        if not tokens:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        words = {self.words[word] for word in _WORD.findall(text.lower())}
        shares: Counter = Counter()
        distinct = Counter(tokens)
        for token, count in distinct.items():
            shares[self.shapes[token]] += count
        shares[self.repeat] += sum(map(str.__eq__, tokens, tokens[1:]))
        shares[self.again] += len(tokens) - len(distinct)
        words -= shares.keys()
        scale = SHARE_SCALE / len(tokens)
        indices = np.fromiter([*words, *shares], np.int32, len(words) + len(shares))
        values = np.fromiter([1.0] * len(words) + [count * scale for count in shares.values()], np.float32, len(indices))
        return indices, values


@dataclass(frozen=True)
class OrdinalModel:
    """Sparse weights by feature, and the ascending thresholds between the grades 0, 1, ..."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[self.features] = self.weights
        return weights


def tails(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... in columns."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -60, 60)))


def _featurize(batches):
    make = Featurizer()
    for batch in batches:
        found = [make(text) for text in batch.column("text").to_pylist()]
        columns = [batch.column("grade"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["grade", "indices", "values"])


def _compact(features: np.ndarray):
    def run(batches):
        for batch in batches:
            column = batch.column("indices")
            counts, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            values = batch.column("values").flatten().to_numpy()
            at = np.minimum(np.searchsorted(features, flat), len(features) - 1)
            known = features[at] == flat
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), known, len(counts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(a)) for a in (at[known].astype(np.int32), values[known])]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), *lists], ["grade", "indices", "values"])

    return run


def _loss_rows(params, width: int):
    """The loss and gradient over the rows of a task."""
    def run(batches):
        parameters = params.value
        weights, thresholds = parameters[:width], parameters[width:]
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        loss, gradient, slope = 0.0, np.zeros(width), np.zeros(len(edges))
        for batch in batches:
            column = batch.column("indices")
            counts, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            values, grade = batch.column("values").flatten().to_numpy(), batch.column("grade").to_numpy()
            row = np.repeat(np.arange(len(counts)), counts)
            score = np.bincount(row, weights[flat] * values, len(counts))
            up, down = (1 / (1 + np.exp(-np.clip(edges[g] - score, -60, 60))) for g in (grade + 1, grade))
            chance = np.maximum(up - down, 1e-12)
            loss -= float(np.log(chance).sum())
            d_up, d_down = up * (1 - up) / chance, down * (1 - down) / chance
            gradient += np.bincount(flat, values * (d_up - d_down)[row], width)
            slope += np.bincount(grade, d_down, len(edges)) - np.bincount(grade + 1, d_up, len(edges))
        out = np.concatenate([[loss], gradient, slope[1:-1]])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return run


def _lbfgs(evaluate, start: np.ndarray) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    x, (value, slope) = start, evaluate(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ITERATIONS):
        direction, kept = -slope, []
        for s, y in reversed(past):
            a = s @ direction / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            direction = direction * (s @ y) / (y @ y)
        else:
            direction = direction / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(past, reversed(kept)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        step = 1.0
        while step > 1e-4:
            candidate = x + step * direction
            found, new_slope = evaluate(candidate)
            if found <= value + 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            break
        s, y = candidate - x, new_slope - slope
        if s @ y > 1e-10:
            past = [*past[1 - HISTORY :], (s, y)]
        done = value - found < 1e-4 * max(1.0, abs(value))
        x, value, slope = candidate, found, new_slope
        if done:
            break
    return x


def fit(rated: DataFrame, grades: int, training_rows: int = TRAINING_ROWS) -> OrdinalModel:
    """A model from ``rated`` (doc_id, text, grade from 0 to grades - 1), on a sample of about ``training_rows``.

    Rows without a grade or with one out of range are left out; repeated rows count as often as they occur. Without rated rows all
    weights are zero and the thresholds lie so that every document reaches the top grade.
    """
    spark = rated.sparkSession
    scratch = Scratch(spark, "quality")
    rows = rated.where(F.col("grade").between(0, grades - 1)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("grade").cast("int").alias("grade"))
    total = rated.where(F.col("grade").between(0, grades - 1)).count()
    if not total:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.linspace(-2.0, -1.0, grades - 1))
    bound = 1 << 40
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(bound)) < F.lit(int(min(1.0, training_rows / total) * bound)))
    kind = "grade int, indices array<int>, values array<float>"
    made = scratch.put(rows.select("text", "grade").mapInArrow(_featurize, kind))
    common = made.select(F.explode("indices").alias("feature")).groupBy("feature").count().where(F.col("count") >= MIN_ROWS)
    features = np.sort(np.array([row["feature"] for row in common.select("feature").collect()], np.int64))
    if not len(features):
        features = np.zeros(1, np.int64)
    parts = max(1, min(16, spark.sparkContext.defaultParallelism))
    train = scratch.put(made.mapInArrow(_compact(features), kind).coalesce(parts))
    width = len(features)
    counts = {row["grade"]: row["count"] for row in made.groupBy("grade").count().collect()}
    # The free numbers are the first threshold and the logarithms of the gaps, which keeps the order.
    below = np.clip(np.cumsum([counts.get(g, 0) for g in range(grades - 1)]) / max(1, sum(counts.values())), 1e-3, 1 - 1e-3)
    cuts = np.log(below / (1 - below))
    free = np.concatenate([np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])

    def evaluate(x: np.ndarray):
        gaps = np.exp(np.clip(x[width + 1 :], -20, 20))
        thresholds = x[width] + np.concatenate([[0], np.cumsum(gaps)])
        params = spark.sparkContext.broadcast(np.concatenate([x[:width], thresholds]))
        sums = sum(np.frombuffer(row["sums"]) for row in train.mapInArrow(_loss_rows(params, width), "sums binary").collect())
        params.destroy()
        slope = sums[1 + width :]
        free_slope = np.concatenate([[slope.sum()], np.cumsum(slope[::-1])[::-1][1:] * gaps])
        return sums[0] + RIDGE / 2 * float(x[:width] @ x[:width]), np.concatenate([sums[1 : 1 + width] + RIDGE * x[:width], free_slope])

    best = _lbfgs(evaluate, free)
    scratch.drop(made, train)
    thresholds = best[width] + np.concatenate([[0], np.cumsum(np.exp(np.clip(best[width + 1 :], -20, 20)))])
    return OrdinalModel(features, best[:width], thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels`` (doc_id, quality, toxic): 0 poor, 1 fair but toxic, 2 clean. Of contradicting labels the
    lowest grade counts; labels without a doc_id or quality are left out, an unknown toxicity is none."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def score(docs: DataFrame, model: OrdinalModel, keep: float = KEEP) -> DataFrame:
    """All rows and columns of ``docs`` (text) plus ``quality_score``, ``expected_grade``, ``top_probability`` and ``selected``.

    Null and empty texts have score 0. Columns of these names are replaced.
    """
    names = ["quality_score", "expected_grade", "top_probability", "selected"]
    docs = docs.drop(*names)
    weights, thresholds = docs.sparkSession.sparkContext.broadcast(model.dense()), model.thresholds
    held = "text"

    def run(batches):
        make = Featurizer()
        for batch in batches:
            column = batch.column(batch.schema.names.index(held)).cast(pa.string())
            found = (make(text) for text in column.to_pylist())
            scores = np.array([float(weights.value[i] @ v) for i, v in found], float).reshape(-1)
            above = tails(scores, thresholds)
            added = [pa.array(scores), pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    kinds = [T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]]))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on the labelled ones of ``docs`` (doc_id, text) and scores all of them."""
    rated = docs.select("doc_id", "text").join(graded(labels), "doc_id")
    return score(docs, fit(rated, 3, **options))
