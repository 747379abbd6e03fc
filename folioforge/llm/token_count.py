"""Token counts by heap-and-linked-list byte-pair merging.

A word's bytes form a doubly linked list and its adjacent pairs a heap by merge
rank; the lowest pair is popped and merged until none is left.  The count is the
number of initial symbols minus the number of merges; no ids are produced.

Defined results: null text is empty and has 0 tokens; a special string inside a
text counts one token, as the library does by default; rows stay separate
whatever their doc_id; empty tables give empty tables; extra columns don't matter.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ENCODE_BYTES, Encoder, Vocabulary, by_pretokens, default_vocabulary, vocabulary
from .common import bounded_batches, one_operator, text_bytes, worker_state

LIMIT = 1024


def merge_count(raw: bytes, vocab: Vocabulary) -> int:
    """Tokens of one pre-token."""
    n = len(raw)
    if n < 2:
        return n
    merges, symbols = vocab.merges, [vocab.byte_ids[b] for b in raw]
    left, right = [*range(-1, n - 1)], [*range(1, n), -1]
    heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
    heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # a neighbour was merged meanwhile
        symbols[i], symbols[j] = merges[a, b][1], -1
        right[i] = k = right[j]
        done += 1
        if k >= 0:
            left[k] = i
            if (p := (symbols[i], symbols[k])) in merges:
                heappush(heap, (merges[p][0], i, *p))
        if (h := left[i]) >= 0 and (p := (symbols[h], symbols[i])) in merges:
            heappush(heap, (merges[p][0], h, *p))
    return n - done


def counter(path: str) -> Encoder:
    def make():
        vocab = vocabulary(path)
        # a count travels as so many bytes: joined values then add up, and no identifiers are made
        return Encoder(vocab, by_pretokens(lambda words: [bytes(merge_count(w.encode(), vocab)) for w in words]), lambda s: b"\0")

    return worker_state(f"counter {path}", make)


def _count_batches(path: str, limit: int):
    def run(batches):
        one_operator("bpe-count")
        count = counter(path)
        for batch in batches:
            n = np.array([len(x) for x in count.encode(batch.column(1))], np.int64)
            columns = [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle."""
    rows = bounded_batches(docs, ENCODE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(_count_batches(tokenizer or default_vocabulary(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
