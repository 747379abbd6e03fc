"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed word pieces learns from confirmed toxic
texts (P) and from unlabelled text (U, any training text, its label unread).
With the class prior pi the risk is
``pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)])``; when the second part
turns negative the step goes against it, so that the fit of U cannot go below
what the prior allows.

Only training is bounded (MAX_POSITIVE and MAX_UNLABELLED doc_ids, those whose
hash is least, each with one of its texts); ``fit(max_unlabelled=None)`` reads all
unlabelled texts, in one pass over their features per step.  Every text is
scored, whole, without a shuffle.

Defined results: null and empty texts get the score of the bias alone; without a
confirmed toxic training text every score is 0; labels that are
null or belong to no document are ignored; a doc_id with several labels is toxic
if one of them says so; repeated rows are scored separately; an empty table
gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialize, named, one_operator, one_text_each, scored_texts, text_bytes

#: Bounds of the training sample (documents) and the size of the hashed feature space.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 8000
BUCKETS = 1 << 18
THRESHOLD = 0.7
#: Words whose weight a scoring task remembers, of at most MAX_WORD bytes each.
REMEMBERED, MAX_WORD = 100_000, 64
EPOCHS, RATE, DECAY = 200, 0.05, 1e-5
STRIP = b".,;:!?\"'()[]{}<>|*_-"


def word_features(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a word: itself and its first four and five bytes (stems of inflected words)."""
    core = word.strip(STRIP)
    if not core:
        return ()
    parts = {b"w" + core} | {b"p" + core[:n] for n in (4, 5) if len(core) >= n}
    return tuple(sorted({xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts}))


def text_features(raw: bytes) -> np.ndarray:
    """Buckets of all distinct words of a whole text."""
    return np.array([f for w in set(raw.lower().split()) for f in word_features(w)], np.int32)


def telling_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 4.0) -> np.ndarray:
    """Buckets that confirmed toxic texts hold more often than unlabelled text explains (``least`` standard errors)."""
    times = lambda rows: np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=BUCKETS)
    in_p, rate = times(positive), times(unlabelled) / len(unlabelled)
    expected = len(positive) * rate
    return np.flatnonzero((in_p - expected) / np.sqrt(expected + 1) > least)


class SparseRows:
    """Rows of bucket lists, for sums over each row and their gradient."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows])
        self.flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], len(self.sizes)) + bias

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, per_row[self.owner], BUCKETS)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss (Adam, full batches)."""
    chosen = np.zeros(BUCKETS, bool)
    chosen[telling_features(positive, unlabelled)] = True
    p, u = (SparseRows([r[chosen[r]] for r in rows]) for rows in (positive, unlabelled))
    theta, bias = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(BUCKETS + 1)
    for step in range(1, epochs + 1):
        zp, zu = p.scores(theta, bias), u.scores(theta, bias)
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = sigmoid(zp) / len(positive), sigmoid(zu) / len(unlabelled)
        if as_negative >= 0:  # d/dz of pi*l(zp) + l(-zu) - pi*l(-zp)
            row_p, row_u = prior * ((sigmoid(zp) - 1) / len(positive) - gp), gu
        else:
            row_p, row_u = prior * gp, -gu
        g = np.append(p.gradient(row_p) + u.gradient(row_u) + DECAY * theta, row_p.sum() + row_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - float(move[-1])
    return theta, bias


class Model:
    """Weights by word, summed over the distinct words of a text."""

    def __init__(self, theta: np.ndarray, bias: float):
        self.at = np.flatnonzero(theta)
        self.values, self.bias = theta[self.at], bias

    def word_weights(self) -> dict:
        return dict(zip(self.at.tolist(), self.values.tolist()))


def _sums(table: DataFrame, run) -> dict[int, float]:
    """Numbers by key that tasks emit, added up; combined before they are shuffled."""
    rows = table.mapInArrow(run, "key int, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    return {r.key: r.value for r in rows}


def _keyed(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.float64())], ["key", "value"])


def _count_features(batches):
    counts, n = np.zeros(BUCKETS), 0
    for batch in batches:
        counts += np.bincount(np.concatenate([batch.column("features").flatten().to_numpy(), [0]]), minlength=BUCKETS)
        counts[0] -= 1
        n += len(batch)
    at = np.flatnonzero(counts)
    yield _keyed(np.append(at, -1), np.append(counts[at], n))


def train_on_all(positive: list[np.ndarray], unlabelled: DataFrame, prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """:func:`train_nnpu` with every row of ``unlabelled(features array<int>)``, a written table.

    A risk step is one pass over the table: tasks add up losses and gradients over
    the features that tell, which is all that reaches the driver.
    """
    spark = unlabelled.sparkSession
    found = _sums(unlabelled, _count_features)
    n = int(found.pop(-1, 0))
    rate = np.zeros(BUCKETS)
    rate[list(found)] = np.array(list(found.values())) / max(n, 1)
    in_p = np.bincount(np.concatenate([np.unique(r) for r in positive]), minlength=BUCKETS)
    expected = len(positive) * rate
    chosen = (in_p - expected) / np.sqrt(expected + 1) > 4.0
    sent = spark.sparkContext.broadcast(chosen)

    def narrow(batches):
        for batch in batches:
            rows = [r[sent.value[r]] for r in (np.asarray(x, np.int32) for x in batch.column("features").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["features"])

    table = materialize(unlabelled.select("features").mapInArrow(narrow, "features array<int>"), "telling-features")
    p = SparseRows([r[chosen[r]] for r in positive])

    def of_unlabelled(theta: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        now = spark.sparkContext.broadcast((np.flatnonzero(theta), theta[np.flatnonzero(theta)], bias))

        def run(batches):
            at, values, b = now.value
            weights, grad, loss, total = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
            weights[at] = values
            for batch in batches:
                lists = batch.column("features")
                owner, flat = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                z = np.bincount(owner, weights[flat], len(batch)) + b
                g = sigmoid(z)
                loss, total = loss + np.logaddexp(0, z).sum(), total + g.sum()
                grad += np.bincount(flat, g[owner], BUCKETS)
            some = np.flatnonzero(grad)
            yield _keyed(np.append(some, [-1, -2]), np.append(grad[some], [loss, total]))

        got = _sums(table, run)
        loss, total = got.pop(-1, 0.0), got.pop(-2, 0.0)
        grad = np.zeros(BUCKETS)
        grad[list(got)] = list(got.values())
        return loss / n, grad / n, total / n

    theta, bias = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(BUCKETS + 1)
    for step in range(1, epochs + 1):
        zp = p.scores(theta, bias)
        loss_u, grad_u, sum_u = of_unlabelled(theta, bias)
        gp = sigmoid(zp) / len(positive)
        if loss_u - prior * np.logaddexp(0, zp).mean() >= 0:
            row_p, sign = prior * ((sigmoid(zp) - 1) / len(positive) - gp), 1
        else:
            row_p, sign = prior * gp, -1
        g = np.append(p.gradient(row_p) + sign * grad_u + DECAY * theta, row_p.sum() + sign * sum_u)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - float(move[-1])
    return theta, bias


def fit(
    train_docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_unlabelled: int | None = MAX_UNLABELLED, epochs: int = EPOCHS
) -> Model | None:
    """Fit on ``train_docs``; None without a confirmed toxic text among them.

    ``max_unlabelled`` bounds the unlabelled texts; with None all of them count, in
    one pass over their features per step.
    """
    known = labels.where(named(label).isin(0, 1)).groupBy(named(doc_id).alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    ids = train_docs.select(named(doc_id).alias("label_id"))
    usable = materialize(ids.join(known, "label_id").distinct(), "toxic-labels")
    n = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return None
    order = [F.xxhash64("label_id"), F.col("label_id")]
    positive = usable.where("label = 1").orderBy(*order).limit(MAX_POSITIVE).select("label_id", F.lit(1).alias("part"))
    if max_unlabelled is None:
        texts = train_docs.select(named(doc_id).alias("label_id"), text_bytes(text).alias("raw")).where("label_id IS NOT NULL")
        every = materialize(bounded_batches(one_text_each(texts, "label_id")).select("raw", "label_id").mapInArrow(_feature_batches, f"features array<int>, label_id {ids.schema['label_id'].dataType.simpleString()}"), "toxic-features")
        mine = every.join(F.broadcast(positive), "label_id").toArrow().sort_by("label_id").column("features").to_pylist()
        prior = min(max(n[1] / sum(n.values()), 1e-4), 0.9)
        return Model(*train_on_all([np.asarray(x, np.int32) for x in mine], every, prior, epochs))
    unlabelled = ids.where("label_id IS NOT NULL").distinct().orderBy(*order).limit(max_unlabelled).select("label_id", F.lit(0).alias("part"))
    sample = materialize(positive.union(unlabelled), "toxic-sample")
    rows = train_docs.select(named(doc_id).alias("label_id"), text_bytes(text).alias("raw")).join(F.broadcast(sample), "label_id")
    table = one_text_each(rows, "part", "label_id").select("raw", "part", "label_id")
    schema = f"features array<int>, part int, label_id {ids.schema['label_id'].dataType.simpleString()}"
    got = bounded_batches(table).mapInArrow(_feature_batches, schema).toArrow().sort_by([("part", "ascending"), ("label_id", "ascending")])
    part = got.column("part").to_numpy()
    rows = [np.asarray(x, np.int32) for x in got.column("features").to_numpy()]
    positive, unlabelled = ([r for r, p in zip(rows, part) if p == k] for k in (1, 0))
    prior = min(max(n[1] / sum(n.values()), 1e-4), 0.9)
    model = Model(*train_nnpu(positive, unlabelled, prior, epochs))
    del got, rows, positive, unlabelled
    give_back()
    return model


def _feature_batches(batches):
    one_operator("toxicity")
    for batch in batches:
        rows = [text_features(raw.as_py()) for raw in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *batch.columns[1:]], ["features", *batch.schema.names[1:]])


def score_documents(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The ``keep`` columns of every row, and score and predicted under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        one_operator("toxicity")
        got = shared.value
        if got is None:
            return lambda texts: np.zeros(len(texts))
        weights, of_word = got.word_weights(), {}

        def score(texts: pa.Array) -> np.ndarray:
            out = np.empty(len(texts))
            for i, raw in enumerate(texts):
                words = set(raw.as_py().lower().split())
                if len(of_word) > REMEMBERED:
                    of_word.clear()
                fresh = words.difference(of_word)
                for w in fresh:
                    of_word[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                out[i] = got.bias + math.fsum(map(of_word.__getitem__, words))
                for w in fresh:
                    if len(w) > MAX_WORD:
                        del of_word[w]
            return sigmoid(out)

        return score

    scored = scored_texts(docs, keep, text, names[0], scorer)
    return scored.withColumn(names[1], (named(names[0]) >= THRESHOLD).cast("int"))
