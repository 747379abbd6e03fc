"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Lengths are integers of at most CAPACITY, so the whole packing is decided on the
number of pieces per length: equal lengths are placed in runs of bins, and the
segment tree over remaining capacities finds the tightest open run in
logarithmic time.  The outcome is exactly that of best-fit decreasing over all
pieces at once, yet the driver only holds CAPACITY counts and a plan of the same
order, and each piece finds its place from its length and its rank in it.

Defined results: null text is empty (one piece, the end id); documents longer
than CAPACITY are cut into full pieces with the shorter rest first; repeated rows
of a doc_id are packed as separate documents; an empty table gives an empty
table; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import default_vocabulary, shared_library_encoder
from .common import BATCH_BYTES, bounded_batches, materialize, one_operator, text_bytes

CAPACITY, END_ID = 1024, 2


class CapacityTree:
    """Open bins by remaining capacity; ``tightest(n)``: the least capacity of at least n with an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.most = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, capacity: int) -> None:
        i = capacity + self.size
        self.most[i] = int(bool(self.runs[capacity]))
        while i > 1:
            i //= 2
            self.most[i] = self.most[2 * i] or self.most[2 * i + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity > 0 and count > 0:
            self.runs[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.most[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.most[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.most[2 * i] else 2 * i + 1
        return i - self.size


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Plan per length: rows (first rank, first bin, offset), by rank; and the number of bins.

    A piece of rank r in a row's range sits in bin ``first bin + r - first rank``.
    """
    tree, bins, plan = CapacityTree(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        left, rank, rows = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                opened = -(-left // (capacity // length))
                tree.put(capacity, bins, opened)
                bins += opened
                continue
            first, open_bins = tree.take(room)
            each = room // length  # a bin just used is the tightest again until it is full
            full = min(open_bins, left // each)
            for layer in range(each if full else 0):
                rows.append((rank, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            tree.put(room - each * length, first, full)
            if full < open_bins:
                rest = left  # fewer than one bin takes
                for layer in range(rest):
                    rows.append((rank, first + full, capacity - room + layer * length))
                    rank += 1
                left = 0
                tree.put(room - rest * length, first + full, 1)
                tree.put(room, first + full + 1, open_bins - full - 1)
        plan[length] = np.array(rows, np.int64).reshape(-1, 3)
    return plan, bins


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _piece_batches(path: str, capacity: int, end_id: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext

        one_operator("bpe")
        encoder, part = shared_library_encoder(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), defaultdict(int)
        for batch in batches:
            out: list = [[] for _ in names]
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                got += end
                for i, (s, n) in enumerate(pieces_of(len(got) // 4, capacity)):
                    row = (doc_id, i, s, n, zlib.crc32(got[4 * s : 4 * (s + n)]), part, seen[n])
                    seen[n] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _place_batches(plan: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), plan[int(n)]
                i = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                bins[at] = rows[i, 1] + rank[at] - rows[i, 0]
                offsets[at] = rows[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bins), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``batch_bytes``: bytes of text encoded together; more of them hold fewer distinct chunks, and take more memory.
    """
    rows = bounded_batches(docs, batch_bytes).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"
    pieces = materialize(rows.mapInArrow(_piece_batches(tokenizer or default_vocabulary(), capacity, end_id), schema), "pieces")
    # rank of a piece among those of its length: how many the earlier parts hold, plus its place in its own part
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-bases")
    totals = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = pack_counts(totals, capacity)
    ranked = pieces.join(bases.select("length", "part", "base"), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place_batches(plan), out)
