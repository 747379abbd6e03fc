"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct new words of a batch go into a trie; the depth-first walk keeps, for
every prefix on the path, the last token of that prefix's encoding.  A prefix
shared by many words is thus encoded once.  The last token of a prefix is the
one token that ends there and is compatible with the last token of what precedes
it; two tokens are compatible when merging their joined bytes gives just them.

Defined results: null text is empty and has no ids; special strings inside a
text become their single ids, as the library does by default; whole texts of any
length are encoded; rows stay separate whatever their doc_id (null included);
empty tables give empty tables; extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ENCODE_BYTES, Encoder, Vocabulary, by_pretokens, default_vocabulary, lists_offsets, vocabulary
from .common import bounded_batches, one_operator, text_bytes, worker_state


class TrieEncoder:
    """Encodes lists of distinct words; ``__call__`` is an engine for distinct pre-tokens.

    Words are inserted in byte order, so the trie's nodes come up depth-first and
    only the path to the present node is held: per node its prefix's last token
    and its tail, the longest suffix of the prefix that begins some token.
    """

    def __init__(self, vocab: Vocabulary, limit: int = 500_000):
        self.vocab, self.limit = vocab, limit
        self.beginnings = {t[:n] for t in vocab.ids for n in range(len(t) + 1)}
        #: tail → (tail, tokens that may end there with their sizes, longest first)
        self.tails: dict[bytes, tuple[bytes, list[tuple[int, int]]]] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging of a short byte string: lowest rank first, leftmost among equals."""
        ids, merges = [self.vocab.byte_ids[b] for b in raw], self.vocab.merges
        while len(ids) > 1:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
        return ids

    def tail(self, text: bytes) -> tuple[bytes, list[tuple[int, int]]]:
        """Entry of the longest suffix of ``text`` that begins a token; tokens that merging never gives are left out."""
        while text not in self.beginnings:
            text = text[1:]
        got = self.tails.get(text)
        if got is None:
            ends = [(self.vocab.ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.vocab.ids]
            got = self.tails[text] = text, [(t, n) for t, n in ends if self.merged(self.vocab.token_bytes[t]) == [t]]
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just them."""
        if len(self.fits) > self.limit:
            self.fits.clear()
        bytes_of = self.vocab.token_bytes
        got = (left, right) not in self.vocab.merges and self.merged(bytes_of[left] + bytes_of[right]) == [left, right]
        self.fits[left << 32 | right] = got
        return got

    def __call__(self, words: list[str]) -> list[bytes]:
        raws = [w.encode() for w in words]
        out: list = [b""] * len(words)
        sizes, tails, fits = {t: len(b) for t, b in self.vocab.token_bytes.items()}, self.tails, self.fits
        path, lasts, states = b"", [-1], [b""]
        for i in sorted(range(len(raws)), key=raws.__getitem__):
            raw, depth = raws[i], 0
            for a, b in zip(raw, path):
                if a != b:
                    break
                depth += 1
            del lasts[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for n in range(depth + 1, len(raw) + 1):
                state += raw[n - 1 : n]
                state, ends = tails.get(state) or self.tail(state)
                for token, size in ends:
                    if size == n:
                        break
                    left = lasts[n - size]
                    fit = fits.get(left << 32 | token)
                    if fit is None:
                        fit = self.compatible(left, token)
                    if fit:
                        break
                lasts.append(token)
                states.append(state)
            path, at, ids = raw, len(raw), []
            while at:
                ids.append(lasts[at])
                at -= sizes[lasts[at]]
            out[i] = np.array(ids[::-1], "<u4").tobytes()
        return out


def trie_encoder(path: str) -> Encoder:
    def make():
        vocab = vocabulary(path)
        return Encoder(vocab, by_pretokens(TrieEncoder(vocab)), lambda s: vocab.special[s].to_bytes(4, "little"))

    return worker_state(f"trie-encoder {path}", make)


class Decoder:
    """Texts of ids, special tokens included; byte sequences that are not UTF-8 become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.table = pa.array([vocab.token_bytes.get(i, b"") for i in range(max(vocab.token_bytes) + 1)], pa.large_binary())

    def __call__(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """UTF-8 texts; text i has the ids from starts[i] to starts[i + 1]."""
        got = self.table.take(pa.array(ids))
        ends, data = lists_offsets(got)[starts].tolist(), got.buffers()[2]
        data = memoryview(data) if data else memoryview(b"")
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


def decoder(path: str) -> Decoder:
    return worker_state(f"decoder {path}", lambda: Decoder(vocabulary(path)))


def _encode_batches(path: str, with_ids: bool):
    def run(batches):
        one_operator("bpe")
        encoder, decode = trie_encoder(path), decoder(path)
        for batch in batches:
            coded = encoder.encode(batch.column(1))
            counts = np.array([len(x) // 4 for x in coded], np.int64)
            numbers = np.frombuffer(b"".join(coded), "<u4")
            texts = decode(numbers, np.concatenate([[0], np.cumsum(counts)]))
            columns = [batch.column(0), pa.array(counts), *(pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (coded, texts))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids) of every row; no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = bounded_batches(docs, ENCODE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(_encode_batches(tokenizer or default_vocabulary(), with_ids), schema)


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give an empty text."""
    path = tokenizer or default_vocabulary()

    def run(batches):
        one_operator("bpe")
        decode = decoder(path)
        for batch in batches:
            ids = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            texts = decode(np.concatenate([*ids, np.empty(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
