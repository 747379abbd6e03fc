"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

Texts are counts over hashed terms: words, word shapes (the pattern of letter
cases, digits and marks), and repeats of the preceding word.  A truncated
singular value decomposition of a bounded labelled sample gives the latent space;
its labelled vectors are broadcast, and every text's exact cosine with all of
them is computed in blocks.  The NEIGHBOURS most similar vote for their label
with the weight of their similarity.

Only the fit is bounded (MAX_PER_LABEL labelled doc_ids of each label, those
whose hash is least, each with one of its texts); every text is scored, whole,
without a shuffle.  The vote is corrected for the labels' shares in the training
labels.

Defined results: null and empty texts have one vector of their own and vote like
any other; without labelled training texts, or with one label only, every score
is the share of label 1 (0.5 with no labels); null labels are ignored; a doc_id
with several labels counts with the largest; repeated rows are scored
separately; an empty table gives an empty table; extra columns don't matter; of labelled
vectors that are equally similar to nine places, those with smaller doc_ids vote.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialize, named, one_operator, one_text_each, scored_texts, text_bytes, worker_state

MAX_PER_LABEL = 2000
WORD_TERMS, SHAPE_TERMS = 1024, 512
TERMS = WORD_TERMS + SHAPE_TERMS + 2  # and: repeats, the empty text
DIMENSIONS, NEIGHBOURS = 48, 15
THRESHOLD = 0.5
BLOCK = 256
#: Words whose terms a Python worker remembers, of at most MAX_WORD bytes each.
REMEMBERED, MAX_WORD = 100_000, 64
_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+"), regex.compile(r"\p{N}+")
_RUN = regex.compile(r"(.)\1+")


MARKS = ".,;:!?|*#%$&()[]{}'\"-"


def shape(word: str) -> str:
    """Runs of upper case, other letters and digits become A, a and 0; repeated marks collapse to two."""
    core = word.rstrip(MARKS)
    if core.isalpha():  # by far the most frequent kinds, without patterns
        case = "a" if core.islower() else "A" if core.isupper() else "Aa" if core[0].isupper() and core[1:].islower() else ""
        if case:
            return case + _RUN.sub(r"\1\1", word[len(core) :])
    word = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))
    return _RUN.sub(r"\1\1", word)


def word_term(word: bytes) -> int:
    """Word bucket and shape bucket in one number."""
    text = word.decode("utf-8", "replace")
    return xxhash.xxh3_64_intdigest(word.lower()) % WORD_TERMS * SHAPE_TERMS + xxhash.xxh3_64_intdigest(shape(text).encode()) % SHAPE_TERMS


def term_counts(raw: bytes) -> np.ndarray:
    """Counts of all terms of a whole text."""
    known = worker_state("quality-terms", dict)
    if len(known) > REMEMBERED:
        known.clear()
    words = raw.split()
    out = np.zeros(TERMS, np.float32)
    if not words:
        out[-1] = 1
        return out
    fresh = set(words).difference(known)
    for w in fresh:
        known[w] = word_term(w)
    word, form = np.divmod(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), SHAPE_TERMS)
    for w in fresh:
        if len(w) > MAX_WORD:
            del known[w]
    out[:WORD_TERMS] = np.bincount(word, minlength=WORD_TERMS)
    out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(form, minlength=SHAPE_TERMS)
    out[-2] = sum(map(eq, words, words[1:]))
    return out


def weighted(counts: np.ndarray, word_share: float = 0.3) -> np.ndarray:
    """Square roots of shares (Hellinger scaling); words weigh less than shapes."""
    n = np.maximum(counts[:, :WORD_TERMS].sum(1, keepdims=True), 1)
    x = np.sqrt(counts / n)
    x[:, :WORD_TERMS] *= word_share
    return x


class LatentVotes:
    """Latent space and labelled vectors; ``scores`` gives the corrected vote for label 1."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, share: float, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.share, self.neighbours = share, min(neighbours, len(labels))
        self.labels = np.asarray(labels, float)
        self.single = len(set(self.labels)) < 2
        if self.single:
            return
        x = weighted(counts)
        self.centre = x.mean(0)
        # right singular vectors from the small Gram matrix of the terms
        values, vectors = np.linalg.eigh((x - self.centre).T @ (x - self.centre))
        self.axes = vectors[:, ::-1][:, : min(dimensions, int((values > 1e-9).sum()) or 1)]
        self.vectors = self.latent(counts)
        ones = self.labels.mean()
        self.weights = np.where(self.labels == 1, share / ones, (1 - share) / (1 - ones))

    def latent(self, counts: np.ndarray) -> np.ndarray:
        y = (weighted(counts) - self.centre) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.single:
            return np.full(len(counts), self.share)
        out = []
        for at in range(0, len(counts), BLOCK):
            near = np.round(self.latent(counts[at : at + BLOCK]) @ self.vectors.T, 9)
            rank = np.arange(near.shape[1]) - np.rint(near * 1e9).astype(np.int64) * near.shape[1]  # no two are equal
            top = np.sort(np.argpartition(rank, self.neighbours - 1, axis=1)[:, : self.neighbours], axis=1)
            vote = np.maximum(np.take_along_axis(near, top, 1), 1e-6) * self.weights[top]
            out.append((vote * self.labels[top]).sum(1) / vote.sum(1))
        return np.concatenate(out) if out else np.empty(0)


def _count_batches(batches):
    one_operator("quality")
    for batch in batches:
        rows = [term_counts(raw.as_py()).tolist() for raw in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), *batch.columns[1:]], ["terms", *batch.schema.names[1:]])


def fit(train_docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> LatentVotes:
    """Fit on a bounded sample; ``train_docs`` are the rows that may be learned from."""
    known = labels.where(named(label).isin(0, 1)).groupBy(named(doc_id).alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    ids = train_docs.select(named(doc_id).alias("label_id"))
    usable = materialize(ids.join(known, "label_id", "left_semi").join(known, "label_id").distinct(), "quality-labels")
    n = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [usable.where(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_PER_LABEL) for k in (0, 1)]
    sample = materialize(picks[0].union(picks[1]), "quality-sample")
    rows = train_docs.select(named(doc_id).alias("label_id"), text_bytes(text).alias("raw")).join(F.broadcast(sample), "label_id")
    table = one_text_each(rows, "label", "label_id").select("raw", "label", "label_id")
    schema = f"terms array<float>, label int, label_id {ids.schema['label_id'].dataType.simpleString()}"
    got = bounded_batches(table).mapInArrow(_count_batches, schema).toArrow().sort_by("label_id")
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    counts = got.column("terms").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, TERMS) if got.num_rows else np.zeros((0, TERMS))
    model = LatentVotes(counts, got.column("label").to_numpy(), share)
    del got, counts
    give_back()
    return model


def score_documents(docs: DataFrame, model: LatentVotes, keep: list[str], text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The ``keep`` columns of every row, and score and predicted under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        one_operator("quality")
        votes = shared.value

        def score(texts: pa.Array) -> np.ndarray:
            out = [votes.scores(np.array([term_counts(x.as_py()) for x in texts[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)]
            return np.concatenate([*out, np.empty(0)])

        return score

    scored = scored_texts(docs, keep, text, names[0], scorer)
    return scored.withColumn(names[1], (named(names[0]) >= THRESHOLD).cast("int"))
