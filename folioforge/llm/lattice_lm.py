"""LM scoring with a subword lattice.

The vocabulary and its scores are those of an existing unigram-scored tokenizer
file; neither is trained.  Scores are ranks, so a piece's weight is a Zipf law of
its score.  A word's lattice probability is the sum over all its segmentations,
by a forward recursion in log space.

What the training texts add: a word seen there has one more arc in its lattice,
the whole word with its smoothed frequency, discounted.  The discount is fitted to
the training texts by their leave-one-out likelihood (``fitted_discount``), and what
it takes from all word arcs of a class is the weight of the segmentations there, so
every class's word probabilities sum to one over words and segmentations.  The
segmentations are in every word's sum and are all that an unseen word has.
Frequencies are kept per text class (the most frequent values of a class column, here ``lang``; used
in training only), and a document's marginal probability is the product over its
words and an end symbol, mixed over the classes:
``P(text) = sum_k pi_k * P_k(end) * prod_w (1 - P_k(end)) * P_k(w)``.

Work is by distinct word: counts and lattice values live in tables keyed by word,
which grow with the corpus.  Only the HEAD_WORDS most frequent words are
broadcast (a fixed bound); rarer words meet their documents in a shuffle join,
where a key has at most one row per document and, but for words of over
MAX_HEAD_BYTES, less than 1/HEAD_WORDS of all tokens.

Defined results: null text is empty; an empty text has the end token only; a
null class value is a class like any other; an empty table gives an empty table;
without training tokens only the segmentations count; words of any length are
scored exactly in bounded memory; repeated rows of a doc_id and null doc_ids are
scored as separate rows; ties in the choice of classes and head words go to the
smaller value; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, named, one_operator, text_bytes, words_of

#: Only the HEAD_WORDS most frequent training words, of at most MAX_HEAD_BYTES each, are broadcast: under 50 MB for any corpus.
HEAD_WORDS, MAX_HEAD_BYTES = 400_000, 64
MAX_CLASSES = 5
#: Pseudo-counts that pull a class's word frequencies towards those of all classes.
PRIOR = 2000.0
#: Words of more characters are summed one by one, in memory that doesn't grow with them.
LONG = 256
MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def piece_table(path: str) -> tuple[dict, int, np.ndarray]:
    """(piece → id, longest piece, log weights); byte pieces keep their ids 0..255."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:]:
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in piece)
        if low not in pieces:
            pieces[low] = 256 + len(pieces)
            ranks[pieces[low]] = max(0.0, -model.get_score(i))
    # ranks as a Zipf law; bytes get a small equal share
    weight = np.empty(256 + len(pieces))
    weight[:256] = 1e-6
    weight[256:] = [1.0 / (min(ranks[i], 1e6) + 2.7) for i in range(256, len(weight))]
    return pieces, max(map(len, pieces)), np.log(weight / weight.sum())


def char_arcs(c: str, pieces: dict) -> tuple[int, ...]:
    """Piece ids that spell one character for certain: itself, or its UTF-8 bytes."""
    got = pieces.get(c)
    return (got,) if got is not None else tuple(c.encode("utf-8", "surrogatepass"))


class Lattice:
    """All segmentations of a batch of words, as arcs sorted by end position."""

    def __init__(self, words: list[str], pieces: dict, longest: int):
        # per arc: word, start, end, first piece; spelled arcs add the other bytes
        w_, s_, e_, p_, extra = [], [], [], [], []
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        get = pieces.get
        for k, word in enumerate(words):
            text = MARK + word
            n = len(text)
            for s in range(n):
                one = get(text[s])
                if one is None:
                    spelled = text[s].encode("utf-8", "surrogatepass")
                    extra += [(len(w_), b) for b in spelled[1:]]
                    one = spelled[0]
                w_.append(k)
                s_.append(s)
                e_.append(s + 1)
                p_.append(one)
                for e in range(s + 2, min(n, s + longest) + 1):
                    got = get(text[s:e])
                    if got is not None:
                        w_.append(k)
                        s_.append(s)
                        e_.append(e)
                        p_.append(got)
        self.w, self.s, self.e, self.p = (np.array(x, np.int64) for x in (w_, s_, e_, p_))
        self.extra = np.array(extra, np.int64).reshape(-1, 2)
        self.offset = np.concatenate([[0], np.cumsum(self.lengths + 1)])

    def arc_weights(self, logp: np.ndarray) -> np.ndarray:
        """(arcs, classes) log weights."""
        out = logp[self.p]
        if len(self.extra):
            np.add.at(out, self.extra[:, 0], logp[self.extra[:, 1]])
        return out

    def _sweep(self, weights: np.ndarray, key: np.ndarray, frm: np.ndarray, to: np.ndarray, value: np.ndarray) -> None:
        """value[to] = logsumexp(value[from] + weight) for groups of equal ``to``, in order of key."""
        order = np.lexsort((to, key))
        steps = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1)) if len(order) else []
        for a, b in zip(steps, [*steps[1:], len(order)]):
            arcs = order[a:b]
            target = to[arcs]
            heads = np.flatnonzero(np.diff(target, prepend=-1))
            x = value[frm[arcs]] + weights[arcs]
            top = np.maximum.reduceat(x, heads, axis=0)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff([*heads, len(arcs)]), axis=0)), heads, axis=0)
            value[target[heads]] = top + np.log(total)

    def forward(self, weights: np.ndarray) -> np.ndarray:
        value = np.full((self.offset[-1], weights.shape[1]), -np.inf)
        value[self.offset[:-1]] = 0.0
        if len(self.w):
            base = self.offset[self.w]
            self._sweep(weights, self.e, base + self.s, base + self.e, value)
        return value

    def totals(self, logp: np.ndarray) -> np.ndarray:
        """(words, classes) log marginal probabilities."""
        return self.forward(self.arc_weights(logp))[self.offset[1:] - 1]


def long_total(word: str, pieces: dict, longest: int, logp: np.ndarray) -> np.ndarray:
    """Exact forward value of one very long word; keeps only the last ``longest`` positions."""
    text = MARK + word
    ring = np.full((longest + 1, logp.shape[1]), -np.inf)
    ring[0] = 0.0
    for e in range(1, len(text) + 1):
        terms = []
        for s in range(max(0, e - longest), e):
            if e - s == 1:
                terms.append(ring[s % (longest + 1)] + logp[list(char_arcs(text[s], pieces))].sum(0))
            elif (got := pieces.get(text[s:e])) is not None:
                terms.append(ring[s % (longest + 1)] + logp[got])
        x = np.array(terms)
        top = x.max(0)
        ring[e % (longest + 1)] = top + np.log(np.exp(x - top).sum(0))
    return ring[len(text) % (longest + 1)].copy()


def decoded(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape").encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def class_names(docs: DataFrame, column: str | None, most: int = MAX_CLASSES) -> list:
    """The values of the class column with the most rows (ties by value); the rest share the last class."""
    if column is None or column not in docs.columns:
        return []
    rows = docs.groupBy(named(column).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(most - 1)
    return [r.c for r in rows.collect()]


def _count_batches(n_classes: int, flush: int = 400_000):
    """Partial counts (word, class, n) from (class, raw) rows; class ``n_classes`` marks held-out texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_operator("lattice")
        seen: list[dict] = [{} for _ in range(n_classes + 1)]

        def out():
            for k, table in enumerate(seen):
                if table:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(table), pa.binary()), pa.array([k] * len(table), pa.int32()), pa.array(list(table.values()), pa.int64())], ["word", "k", "n"]
                    )
                    table.clear()

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = seen[k]
                for w in words_of(raw.as_py()):
                    table[w] = table.get(w, 0) + 1
                if len(table) > flush:
                    yield from out()
        yield from out()

    return run


def word_counts(train: DataFrame, n_classes: int) -> DataFrame:
    """(word, c array<long>): occurrences in training texts per class."""
    parts = train.select("k", "raw").mapInArrow(_count_batches(n_classes), "word binary, k int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(n_classes)]
    return parts.groupBy("word").agg(*sums).select("word", F.array(*[f"c{i}" for i in range(n_classes)]).alias("c"))


def _score_words(path: str, totals: np.ndarray, base_denominator: float, discount: float, rest: np.ndarray):
    """(word, n, base, v): base log10 and log10 probabilities per class of each word."""
    grand = totals.sum()

    def run(batches):
        one_operator("lattice")
        pieces, longest, logp = piece_table(path)
        for batch in batches:
            words = [decoded(x) for x in batch.column(0).to_pylist()]
            counts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(words), -1)
            lattice = np.empty((len(words), 1))
            short = [i for i, w in enumerate(words) if len(w) <= LONG]
            for at in range(0, len(short), 4096):
                pick = short[at : at + 4096]
                lattice[pick] = Lattice([words[i] for i in pick], pieces, longest).totals(logp[:, None])
            for i in set(range(len(words))).difference(short):
                lattice[i] = long_total(words[i], pieces, longest, logp[:, None])
            values = word_values(lattice, counts, totals, grand, discount, rest)
            n = counts.sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(np.log10((n + 0.1) / base_denominator)), pa.array(values.tolist(), pa.list_(pa.float64()))], ["word", "n", "base", "v"]
            )

    return run


def fitted_discount(once: int, twice: int) -> float:
    """What each seen word gives of its count to the segmentations, from the numbers of words seen once and twice.

    The maximum of a bound on the leave-one-out likelihood of the training texts:
    once / (once + 2 * twice), kept inside 0..1 where one of them is 0.
    """
    return (once + 0.5) / (once + 2 * twice + 1)


def segmentation_weights(totals: np.ndarray, per_count: np.ndarray, types: int, discount: float) -> np.ndarray:
    """Per class what ``discount`` takes from its word arcs; ``per_count``: sum over words of class count by count.

    Without training tokens the segmentations have it all.
    """
    grand = totals.sum()
    return discount * (per_count + PRIOR * types / grand) / (totals + PRIOR) if grand else np.ones_like(totals)


def word_values(lattice: np.ndarray, counts: np.ndarray, totals: np.ndarray, grand: float, discount: float, rest: np.ndarray) -> np.ndarray:
    """(words, classes) log10 probabilities from the lattice (natural logs, one column) and the word arc together."""
    n = counts.sum(1, keepdims=True)
    arc = (counts + PRIOR * n / max(grand, 1.0)) / (totals + PRIOR) * (1 - discount / np.maximum(n, 1.0))
    segmented = np.log(rest) + lattice
    with np.errstate(divide="ignore"):
        seen = np.logaddexp(segmented, np.log(arc))
    return np.where(n > 0, seen, segmented) / math.log(10)


def _score_docs(head):
    """Per document one row of sums over head words (word null) and one row per rarer distinct word."""
    names = ["row", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", "v"]

    def run(batches):
        one_operator("lattice")
        index, matrix, uses = head.value
        nowhere = len(uses)
        matrix, uses = np.vstack([matrix, np.zeros(matrix.shape[1])]), np.append(uses, 0)
        width = matrix.shape[1] - 1
        for batch in batches:
            heads, tail = ([], []), ([], [], [])
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(3)):
                words = words_of(raw.as_py())
                hits = np.fromiter(map(index.get, words, repeat(nowhere)), np.int64, len(words))
                got = matrix[hits].sum(0)
                heads[0].append((len(words) + 1, int(uses[hits].sum()), got[0]))
                heads[1].append(got[1:])
                rare: dict = {}
                for i in np.flatnonzero(hits == nowhere).tolist():
                    rare[words[i]] = rare.get(words[i], 0) + 1
                tail[0].extend([row] * len(rare))
                tail[1].extend(rare)
                tail[2].extend(rare.values())
            n, m = batch.num_rows, len(tail[0])
            none = pa.nulls
            values = pa.array(np.array(heads[1], float).reshape(n, width).tolist(), pa.list_(pa.float64()))
            tokens, known, base = zip(*heads[0]) if n else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), none(n, pa.binary()), none(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), values], names
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(tail[0], pa.int64()), none(m, pa.int64()), none(m, pa.bool_()), pa.array(tail[1], pa.binary()), pa.array(tail[2], pa.int64()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, values.type)], names
            )

    return run


def score_documents(
    docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", class_column: str | None = "lang", pieces: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column expression; texts where it is false train the model.
    """
    spark, path = bounded_batches(docs).sparkSession, pieces or default_pieces()
    names = class_names(docs.where(~held_out), class_column)
    n_classes = len(names) + 1
    k = F.lit(len(names))
    for i, name in enumerate(names):
        k = F.when(named(class_column).cast("string").eqNullSafe(F.lit(name)), F.lit(i)).otherwise(k)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), named(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), k.cast("int").alias("class"), text_bytes(text).alias("raw")
    )

    # 1. counts of all words; held-out texts add their words with no count
    counting = rows.select(F.when(F.col("held_out"), F.lit(n_classes)).otherwise(F.col("class")).alias("k"), "raw")
    counts = materialize(word_counts(counting, n_classes), "word-counts")
    per_class = {r.k: r.n for r in counting.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = np.array([per_class.get(i, 0) for i in range(n_classes)], float)
    n_any = sum(F.col("c")[i] for i in range(n_classes))
    got = counts.where(n_any > 0).agg(F.count(F.lit(1)).alias("v"), F.count_if(n_any == 1).alias("once"), F.count_if(n_any == 2).alias("twice"),
        *[F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(f"t{i}") for i in range(n_classes)], *[F.coalesce(F.sum(F.col("c")[i] / n_any), F.lit(0.0)).alias(f"p{i}") for i in range(n_classes)]).first()
    totals, per_count = np.array(got[3 : 3 + n_classes], float), np.array(got[3 + n_classes :], float)
    discount = fitted_discount(got.once, got.twice)
    rest = segmentation_weights(totals, per_count, got.v, discount)
    n_train = int(totals.sum() + texts.sum())
    n_types = got.v + (1 if texts.sum() else 0)
    denominator = n_train + 0.1 * (n_types + 1)

    # 2. every word's value
    values = materialize(counts.mapInArrow(_score_words(path, totals, denominator, discount, rest), "word binary, n long, base double, v array<double>"), "word-values")
    top = values.where((F.col("n") > 0) & (F.octet_length("word") <= MAX_HEAD_BYTES)).orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    top = top.select("word", "n", "base", *[F.col("v")[i].alias(f"v{i}") for i in range(n_classes)]).toArrow()
    matrix = np.array([top.column(i).to_numpy() for i in range(2, 3 + n_classes)], float).T.reshape(-1, n_classes + 1)
    index = {w: i for i, w in enumerate(top.column(0).to_pylist())}
    head = spark.sparkContext.broadcast((index, matrix, (top.column(1).to_numpy() > 0).astype(np.int64)))

    # 3. documents: head sums on the spot, rarer words by a join on the word
    schema = "row long, doc_id long, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, v array<double>"
    parts = materialize(rows.select("row", "doc_id", "held_out", "raw").mapInArrow(_score_docs(head), schema), "doc-parts")
    cols = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", *[f"s{i}" for i in range(n_classes)]]
    sums = parts.where("word IS NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", *[F.col("v")[i].alias(f"s{i}") for i in range(n_classes)])
    known = values.select("word", F.col("n").alias("uses"), F.col("base").alias("b"), F.col("v").alias("w"))
    rare = parts.where("word IS NOT NULL").select("row", "word", "n").join(known, "word")
    rare = rare.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("uses") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"), (F.col("n") * F.col("b")).alias("base"),
        *[(F.col("n") * F.col("w")[i]).alias(f"s{i}") for i in range(n_classes)],
    )
    total = (
        sums.union(rare.select(cols)).groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in cols[3:]])
    )

    # 4. the end symbol, and the mixture over classes
    p_end = (texts + 1.0) / (totals + texts + 2.0)
    pi = (texts + 0.5) / (texts + 0.5).sum()
    log_end, log_go, log_pi = np.log10(p_end), np.log10(1 - p_end), np.log10(pi)
    whole = F.array(*[F.col(f"s{i}") + (F.col("n_tokens") - 1) * F.lit(float(log_go[i])) + F.lit(float(log_end[i] + log_pi[i])) for i in range(n_classes)])
    best = F.array_max("whole")
    spread = F.aggregate("whole", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.array_max("whole")))
    end_seen = int(texts.sum() > 0)
    end_base = float(np.log10((texts.sum() + 0.1) / denominator))
    return total.withColumn("whole", whole).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(end_seen)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end_base)).alias("base_score"), (best + F.log10(spread)).alias("score"),
    )
