"""Alignment of two tokenizers by union-find over the bipartite graph of overlapping tokens.

A: byte-level BPE of space + text, B: SentencePiece BPE of the text, both over the
same bytes.  A token of A and one of B are joined by an edge when their byte
ranges overlap; the connected components are the minimal groups that both
tokenizers end together, and a group's links are all its A-B pairs.  Both
tokenizers end a token before a space that follows a character and precedes a
visible one, so components never cross such a place: each distinct chunk between
them is aligned once per batch or taken from a bounded cache.

Every document's links are kept as (pair, occurrences) in a table in the shared
folder.  How many documents hold a pair is counted by map-side combined sums over
it.  The most frequent pairs, at most ``HEAD``, are broadcast; occurrences of rarer
pairs meet their counts in a shuffle join, where no key is frequent.

Defined results: texts that are null or empty, or whose joined token bytes differ
from space + text (U+2581 is a space for B), have no tokens: zeros and '' as
groups_sha256; ties for an A id's highest count are all best; rows stay separate
whatever their doc_id, null ids included, and each counts as a document; empty
tables give empty tables; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import VISIBLE, WIDE_RE2, as_texts, default_vocabulary, library_engine, lists_offsets, vocabulary
from .common import BATCH_BYTES, bounded_batches, materialize, one_operator, text_bytes, worker_state
from .lexical_search import pack, unpack
from .piece_bpe import default_pieces, piece_vocabulary, prefix_table

#: Most frequent pairs whose counts are broadcast (17 bytes each).
HEAD = 1 << 20
#: Chunks kept from one batch to the next.
CACHED = 100_000
#: Groups of at most so many pairs are multiplied out token by token.
PLAIN = 4096
SPACES = " \u2581"  # both are a space for B
CUT = regex.compile(r"(?<=[^ ])(?= \P{White_Space})")


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component number of every token of A and of B, from the bytes where tokens end; both end at the same byte.

    Union-find over the edges of overlapping tokens: roots hook on the least root
    across an edge, and paths are halved, until no edge joins two roots.
    """
    n = len(ends_a)
    borders = np.union1d(ends_a, ends_b)  # each stretch between borders lies in one token of each side: an edge
    a, b = np.searchsorted(ends_a, borders), n + np.searchsorted(ends_b, borders)
    up = np.arange(n + len(ends_b))
    while True:
        one, two = up[a], up[b]
        if (one == two).all():
            break
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while (up[up] != up).any():
            up = up[up]
    _, number = np.unique(up, return_inverse=True)
    return number[:n], number[n:]


class Values:
    """What many chunks have: facts (faithful, tokens of A, tokens of B, groups), text of the groups, and pairs with occurrences."""

    def __init__(self, facts: np.ndarray, said: pa.Array, sizes: np.ndarray, pairs: np.ndarray, uses: np.ndarray):
        self.facts, self.said, self.sizes, self.pairs, self.uses = facts, said, sizes, pairs, uses

    @staticmethod
    def none() -> Values:
        return Values(np.array([[1, 0, 0, 0]]), pa.array([b""], pa.large_binary()), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def take(self, some: np.ndarray) -> Values:
        at = _ranges(np.cumsum(self.sizes)[some] - self.sizes[some], self.sizes[some])
        return Values(self.facts[some], self.said.take(pa.array(some)), self.sizes[some], self.pairs[at], self.uses[at])

    def followed_by(self, other: Values) -> Values:
        join = lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return Values(join("facts"), pa.concat_arrays([self.said, other.said]), *map(join, ("sizes", "pairs", "uses")))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … for every range, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Aligner:
    """Chunks (space + characters) to their groups and links."""

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece

        a, b = vocabulary(tokenizer), piece_vocabulary(pieces)
        self.encode_a, self.encode_b, self.width = library_engine(tokenizer, plain=True), prefix_table(pieces), len(b.raw)
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        raw_a = [a.token_bytes.get(i, b"") for i in range(max(a.token_bytes) + 1)]
        self.raw = [pa.array(raw, pa.large_binary()) for raw in (raw_a, b.raw)]
        self.count_a = len(raw_a)
        # an id and what follows it: within a side, after the last of A, after the last of B
        self.words = pa.array([b"%d%s" % (i, end) for size, ends in ((self.count_a, b",|"), (self.width, b",;")) for end in (ends[:1], ends[1:]) for i in range(size)], pa.large_binary())
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.kept = Values.none()

    def _encoded(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each chunk) of both sides."""
        n = len(chunks)
        # chunks of a space and a visible character are pre-tokenised alike behind one another
        joint = np.fromiter((c[0] == " " and VISIBLE(c, 1) is not None for c in chunks), bool, n)
        single = np.fromiter((c[0] == " " and len(c) > 1 and c[1] not in SPACES for c in chunks), bool, n)  # B's library puts the space before
        sides: list = []
        for mask, one, two in ((joint, lambda x: self.encode_a(x, True), lambda x: self.encode_a(x, False)), (single, self._by_library, self.encode_b)):
            counts, parts, order = np.zeros(n, np.int64), [], []
            for which, encode in ((mask, one), (~mask, two)):
                at = np.flatnonzero(which)
                if len(at):
                    data, sizes = encode([chunks[i] for i in at.tolist()])
                    counts[at] = np.asarray(sizes) // 4
                    parts.append(np.frombuffer(data, "<u4").astype(np.int64))
                    order.append(at)
            ids, at = np.concatenate([*parts, np.empty(0, np.int64)]), np.concatenate([*order, np.empty(0, np.int64)]).astype(np.int64)
            starts = np.zeros(n, np.int64)
            starts[at] = np.cumsum(counts[at]) - counts[at]
            sides.append((ids[_ranges(starts, counts)], counts))
        return sides

    def _by_library(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        coded = self.library_b.encode([c[1:] for c in chunks], num_threads=1)
        return np.fromiter((i for x in coded for i in x), "<u4").tobytes(), np.fromiter((4 * len(x) for x in coded), np.int64, len(coded))

    def align(self, chunks: list[str]) -> Values:
        n = len(chunks)
        if not n:
            return Values.none().take(np.empty(0, np.int64))
        raws = pa.array([c.encode() for c in chunks], pa.large_binary())
        sides, faithful = self._encoded(chunks), np.ones(n, bool)
        for (ids, counts), table in zip(sides, self.raw):
            got = table.take(pa.array(ids))
            offsets = lists_offsets(got)[np.append(0, np.cumsum(counts))]
            joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), got.buffers()[2]])
            faithful &= pc.equal(joined, raws).to_numpy(zero_copy_only=False)
        facts = np.zeros((n, 4), np.int64)
        facts[:, 0] = faithful
        (a, n_a), (b, n_b) = ((ids[np.repeat(faithful, counts)], np.where(faithful, counts, 0)) for ids, counts in sides)
        facts[:, 1], facts[:, 2] = n_a, n_b
        # chunks end where both sides end a token, so all of them are one string of bytes
        lengths = [pc.binary_length(table.take(pa.array(ids))).to_numpy().astype(np.int64) for ids, table in zip((a, b), self.raw)]
        in_a, in_b = groups_of(*map(np.cumsum, lengths))
        total = int(in_a.max(initial=-1)) + 1
        size_a, size_b = np.bincount(in_a, minlength=total), np.bincount(in_b, minlength=total)
        chunk_of = np.empty(total, np.int64)
        chunk_of[in_a] = np.repeat(np.arange(n), n_a)
        facts[:, 3] = np.bincount(chunk_of, minlength=n)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # the groups' text: of each group the tokens of A, then those of B
        place_a = np.arange(len(a)) + first_b[in_a]
        place_b = np.arange(len(b)) + (first_a + size_a)[in_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a] = a + np.where(np.arange(len(a)) == (first_a + size_a - 1)[in_a], self.count_a, 0)
        code[place_b] = 2 * self.count_a + b + np.where(np.arange(len(b)) == (first_b + size_b - 1)[in_b], self.width, 0)
        words = self.words.take(pa.array(code))
        offsets = lists_offsets(words)[np.append(0, np.cumsum(n_a + n_b))] if len(code) else np.zeros(n + 1, np.int64)
        said = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), words.buffers()[2] or pa.py_buffer(b"")])
        # links: all pairs of a group; of a large one its distinct ids are multiplied out
        small = size_a * size_b <= PLAIN
        rows = size_a * small
        left = _ranges(first_a, rows)
        wide = size_b[in_a[left]]
        pair = np.repeat(a[left], wide) * self.width + b[_ranges(first_b[in_a[left]], wide)]
        owner, use = np.repeat(chunk_of[in_a[left]], wide), np.ones(len(pair), np.int64)
        for g in np.flatnonzero(~small).tolist():
            x, times_x = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            y, times_y = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            pair = np.append(pair, (x[:, None] * self.width + y).ravel())
            use = np.append(use, (times_x[:, None] * times_y).ravel())
            owner = np.append(owner, np.full(len(x) * len(y), chunk_of[g]))
        order = np.argsort(owner, kind="stable")
        return Values(facts, said, np.bincount(owner, minlength=n), pair[order], use[order])

    def values(self, chunks: list[str], uses: np.ndarray) -> tuple[Values, np.ndarray]:
        """Values, and where each chunk's are; number 0 is the empty chunk."""
        at = np.array(list(map(self.place.get, chunks, repeat(-1))), np.int64)
        fresh = np.flatnonzero(at < 0)
        new = self.align([chunks[i] for i in fresh.tolist()])
        every = self.kept.followed_by(new)
        at[fresh] = len(self.kept.facts) + np.arange(len(fresh))
        often = np.array([k for k, i in enumerate(fresh.tolist()) if uses[i] > 1 and len(chunks[i]) <= 64], np.int64)
        if len(self.place) + len(often) > CACHED:
            self._forget()
        first = len(self.kept.facts)
        self.place.update((chunks[fresh[k]], first + j) for j, k in enumerate(often.tolist()))
        self.kept = self.kept.followed_by(new.take(often))
        return every, at

    def __call__(self, raws: pa.Array) -> pa.RecordBatch:
        texts = as_texts(raws)
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
        slow = pc.match_substring_regex(texts, WIDE_RE2).to_numpy(zero_copy_only=False)
        if slow.any():  # cut one by one
            lists = [CUT.split(t) if t else [] for t in texts.to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            seen: dict[str, int] = {}
            number = np.array([seen.setdefault(c, len(seen)) for x in lists for c in x], np.int64)
            chunks = list(seen)
        else:
            pieces = pc.split_pattern(texts, " ")
            starts = pieces.offsets.to_numpy().astype(np.int64)
            flat = pieces.values.slice(starts[0], starts[-1] - starts[0])
            starts = starts - starts[0]
            kept = np.ones(len(flat), bool)
            kept[starts[:-1]] = False  # nothing stands before the first space
            starts = np.concatenate([[0], np.cumsum(np.diff(starts) - 1)])
            coded = flat.filter(pa.array(kept)).dictionary_encode()
            number = coded.indices.to_numpy().astype(np.int64)
            chunks = list(map(" ".__add__, coded.dictionary.to_pylist()))
        values, at = self.values(chunks, np.bincount(number, minlength=len(chunks)))
        return _documents(at[number] if len(number) else number, starts, values)


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, links binary"


def packed_links(owner: np.ndarray, pair: np.ndarray, use: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """Pairs of each document and their links in few bytes: distances of its ascending pairs, each before its occurrences."""
    borders = np.searchsorted(owner, np.arange(n_docs + 1))
    gaps = np.diff(pair, prepend=0)
    first = borders[:-1][np.diff(borders) > 0]
    gaps[first] = pair[first]
    data, sizes = pack(np.column_stack([gaps, use]).ravel())
    ends = np.append(0, np.cumsum(sizes))[2 * borders].astype(np.int32)
    return np.diff(borders), pa.BinaryArray.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def unpacked_links(n_pairs: pa.Array, links: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the batch, pair, occurrences)."""
    counts = n_pairs.to_numpy().astype(np.int64)
    ends = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1]
    found = unpack(memoryview(links.buffers()[2] or b"")[ends[0] : ends[-1]]).reshape(-1, 2)
    total = np.cumsum(found[:, 0])
    starts = (np.cumsum(counts) - counts)[counts > 0]
    before = total[starts] - found[starts, 0]
    return np.repeat(np.arange(len(counts)), counts), total - np.repeat(before, counts[counts > 0]), found[:, 1]


def _documents(number: np.ndarray, starts: np.ndarray, values: Values) -> pa.RecordBatch:
    """Per document the sums over its chunks, the hash of its groups, and its distinct pairs with their occurrences."""
    n_docs, n = len(starts) - 1, len(values.facts)
    doc_of = np.repeat(np.arange(n_docs), np.diff(starts))
    bad = np.bincount(doc_of, 1 - values.facts[number, 0], n_docs) > 0
    sums = [np.where(bad, 0, np.bincount(doc_of, values.facts[number, k], n_docs).astype(np.int64)) for k in (1, 2, 3)]
    # every document ends with the empty chunk, so that the array is never without values
    said = values.said.take(pa.array(np.insert(number, starts[1:], 0)))
    ends, data = lists_offsets(said)[starts + np.arange(n_docs + 1)].tolist(), memoryview(said.buffers()[2] or b"")
    hashes = [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a and not wrong else "" for a, b, wrong in zip(ends, ends[1:], bad)]
    good = ~bad[doc_of]
    # a chunk's occurrences in a document count once, multiplied
    once, times = np.unique(doc_of[good] * n + number[good], return_counts=True)
    doc_of, number = np.divmod(once, n)
    spread = values.sizes[number]
    at = _ranges((np.cumsum(values.sizes) - values.sizes)[number], spread)
    owner, pair, use = np.repeat(doc_of, spread), values.pairs[at], values.uses[at] * np.repeat(times, spread)
    order = np.lexsort((pair, owner))
    owner, pair, use = owner[order], pair[order], use[order]
    new = np.ones(len(pair), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])
    heads = np.flatnonzero(new)
    owner, pair, use = owner[heads], pair[heads], np.add.reduceat(use, heads) if len(heads) else use
    links = np.zeros(n_docs, np.int64)
    np.add.at(links, owner, use)
    counts, packed = packed_links(owner, pair, use, n_docs)
    columns = [*map(pa.array, sums), pa.array(links), pa.array(hashes, pa.string()), pa.array(counts, pa.int32()), packed]
    return pa.RecordBatch.from_arrays(columns, ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "links"])


def aligner(tokenizer: str, pieces: str) -> Aligner:
    return worker_state(f"aligner {tokenizer} {pieces}", lambda: Aligner(tokenizer, pieces))


def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs with their occurrences, packed; no shuffle.

    A pair is A id * (ids of B) + B id; :func:`unpacked_links` reads them.
    """
    one, two = tokenizer or default_vocabulary(), pieces or default_pieces()

    def run(batches):
        one_operator("alignment")
        align = aligner(one, two)
        for batch in batches:
            got = align(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.columns], ["doc_id", *got.schema.names])

    rows = bounded_batches(docs, BATCH_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(run, "doc_id long, " + FIELDS)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, a_id, b_id, n, best): documents that hold a pair linked, and whether its A id has no pair of more."""

    def run(batches):
        for batch in batches:
            pair, n = np.unique(unpacked_links(*batch.columns)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    sums = bounded_batches(aligned, BATCH_BYTES).select("n_pairs", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = sums.select("pair", F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), "n")
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a_id")))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, pieces: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark, two = docs.sparkSession, pieces or default_pieces()
    aligned = materialize(align_documents(docs, doc_id, text, tokenizer, two), "aligned")
    counts = materialize(pair_counts(aligned, len(piece_vocabulary(two).raw)), "pair-counts")
    # the least power of two that at most ``head`` counts reach
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    total, bits = 0, 65
    for row in sizes:
        total += row["count"]
        if total <= head:
            bits = row.bits
    every = total <= head
    some = counts.where(F.length(F.bin("n")) >= bits).select("pair", "n", "best").toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(some.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = (np.append(x, np.zeros(1, x.dtype)) for x in sent.value)  # so that there is one
        size = len(pair) - 1
        for batch in batches:
            owner, flat, uses = unpacked_links(batch.column("n_pairs"), batch.column("links"))
            at = np.searchsorted(pair[:size], flat)
            found = (pair[at] == flat) & (at < size)
            weight, top = np.where(found, n[at], 0) * uses, np.where(found & best[at], uses, 0)
            sums = []
            for x in (top, weight):
                total = np.zeros(len(batch), np.int64)
                np.add.at(total, owner, x)
                sums.append(pa.array(total))
            plain = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            columns, names = [*plain, *sums, batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if not every:
                rest = ~found
                ends = pa.array(np.searchsorted(owner[rest], np.arange(len(batch) + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(ends, pa.array(x[rest])) for x in (flat, uses)]
                names += ["pairs", "uses"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", pairs array<long>, uses array<long>" * (not every)
    result = bounded_batches(aligned, BATCH_BYTES).mapInArrow(run, schema)
    if every:  # all pairs were broadcast
        return result
    result = materialize(result.withColumn("row", F.monotonically_increasing_id()), "linked")
    rare = result.select("row", F.explode(F.arrays_zip("pairs", "uses")).alias("p")).select("row", "p.pairs", "p.uses")
    facts = counts.select(F.col("pair").alias("pairs"), "n", F.col("best").cast("long").alias("best"))
    more = rare.join(facts, "pairs").groupBy("row").agg(F.sum(F.col("best") * F.col("uses")).alias("b"), F.sum(F.col("n") * F.col("uses")).alias("c"))
    zero = F.lit(0).cast("long")
    joined = result.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", zero), "count_sum": F.col("count_sum") + F.coalesce("c", zero)})
    return joined.drop("row", "pairs", "uses", "b", "c")
