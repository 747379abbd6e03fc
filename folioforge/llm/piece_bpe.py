"""SentencePiece BPE by a merge-type prefix table, and its decoding.

For every prefix of a word the last token of its encoding is unique.  An
automaton finds the pieces that end at a place; the one that is the last token is
the piece that is compatible with the last token before it, which means that
merging the two of them alone gives just these two tokens.  (Merges are local:
the first one across a border in the whole word would also be the first one
across it in the pair.)  So one pass stores a last token per place, and the ids
are recovered backwards.  Distinct words only are encoded, and kept in a bounded
cache.

Defined results: null text is empty; an empty text has the begin and the end id
only; U+2581 in a text is a space, as for the library; characters without a piece
are spelled in bytes; strings of control pieces inside a text are plain text;
pieces of equal score merge from the left; rows stay separate whatever their
doc_id, null ids included; empty tables give empty tables; extra columns don't
matter; a word of any length takes time in proportion to it.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ENCODE_BYTES, Encoder, as_texts, lists_offsets
from .common import bounded_batches, one_operator, text_bytes, worker_state

MARK = "▁"  # fixed value: the space inside pieces
UNIT = re.compile(" +[^ ]*")
#: Pairs of tokens whose compatibility is remembered.
PAIRS = 500_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceVocabulary:
    """Pieces, scores and special ids of a SentencePiece BPE file with byte fallback."""

    special: dict[str, int] = {}  # no string inside a text is special

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if not plain or spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE with byte fallback, a space before the text and no other normalisation is supported")
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        #: bytes that an id stands for; pieces that start with the mark; ids of single bytes; ids of no text
        self.raw, self.marked, self.is_byte, self.control = [], [], [], []
        for i, p in enumerate(spec.pieces):
            if p.type == kind.NORMAL:
                self.score[p.piece], self.ids[p.piece] = p.score, i
                self.raw.append(p.piece.replace(MARK, " ").encode())
            elif p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kind.CONTROL, kind.UNKNOWN):
                self.raw.append(spec.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else b"")
            else:
                raise ValueError("user-defined and unused pieces are not supported")
            self.marked.append(p.type == kind.NORMAL and p.piece.startswith(MARK))
            self.is_byte.append(p.type == kind.BYTE)
            self.control.append(p.type == kind.CONTROL)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that hold a space after a character are not supported")


class PrefixTable:
    """Ids of words (space + characters) by last tokens of all their prefixes."""

    def __init__(self, vocab: PieceVocabulary):
        self.vocab, self.count = vocab, len(vocab.raw)
        self.pieces, self.sizes = [""] * self.count, [0] * self.count
        self.spelled = {p for p in vocab.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocab.ids.items():
            self.pieces[i], self.sizes[i] = piece, len(piece)
            if self._merged(piece) == [piece]:  # no other piece is ever a token
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The tokens of a short string, by merging its best adjacent pair again and again."""
        parts, score = list(text), self.vocab.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _text(self, token: int) -> str:
        """Characters without a piece are tokens numbered after all ids."""
        return self.pieces[token] if token < self.count else chr(token - self.count)

    def _compatible(self, pair: int, before: int, token: int) -> bool:
        a, b = self._text(before) if before >= 0 else "", self._text(token)
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        got = self.fits[pair] = not a or self._merged(a + b) == [a, b]
        return got

    def lasts(self, word: str) -> list[int]:
        """The last token of every prefix: of the first k + 1 characters at k; -1 of the empty prefix at the end."""
        fits, none = self.fits, [-1]
        lasts = none * (len(word) + 1)
        if not self.spelled.issuperset(word):
            return self._lasts_with_bytes(word, lasts)
        for end, (size, token) in self.automaton.iter(word):
            if lasts[end] < 0:
                pair = lasts[end - size] << 21 | token
                fit = fits.get(pair)
                if fit or fit is None and self._compatible(pair, pair >> 21, token):
                    lasts[end] = token
        return lasts

    def _lasts_with_bytes(self, word: str, lasts: list[int]) -> list[int]:
        """The same where a character may have no piece: it is the last token where no piece is."""
        done = 0  # characters before this have their last token
        for end, (size, token) in self.automaton.iter(word):
            for k in range(done, end):
                if lasts[k] < 0:
                    lasts[k] = self.count + ord(word[k])
            done = end
            if lasts[end] < 0:
                pair = lasts[end - size] << 21 | token
                if self.fits.get(pair) or pair not in self.fits and self._compatible(pair, pair >> 21, token):
                    lasts[end] = token
        for k in range(done, len(word)):
            if lasts[k] < 0:
                lasts[k] = self.count + ord(word[k])
        return lasts

    def ids(self, word: str) -> list[int]:
        lasts, at, sizes, out = self.lasts(word), len(word) - 1, self.sizes, []
        while at >= 0:
            token = lasts[at]
            if token < self.count:
                out.append(token)
                at -= sizes[token]
            else:
                out += [self.vocab.byte_ids[b] for b in reversed(word[at].encode())]
                at -= 1
        out.reverse()
        return out

    def __call__(self, words: list[str], joint: bool = False) -> tuple[bytes, np.ndarray]:
        """Little-endian ids of many words, joined, and the bytes of each."""
        coded = [self.ids(w.replace(" ", MARK)) for w in words]
        return np.array([i for c in coded for i in c], "<u4").tobytes(), np.array([4 * len(c) for c in coded], np.int64)


class PieceEncoder(Encoder):
    """Whole texts by their distinct words: a run of spaces and the characters up to the next space."""

    def _spread_slowly(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        numbers, starts, seen = [], [0], {}
        for text in texts:
            numbers += [seen.setdefault(unit, len(seen)) for unit in UNIT.findall(text)]
            starts.append(len(numbers))
        number = np.array(numbers, np.int64)
        return self._table(list(seen), np.bincount(number, minlength=len(seen)), False).take(pa.array(number)), np.array(starts, np.int64)

    def encode(self, raws: pa.Array) -> list[bytes]:
        """Ids of every text without begin and end."""
        texts = pc.replace_substring(as_texts(raws), MARK, " ")
        spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
        return super().encode(pc.if_else(pc.equal(texts, ""), texts, spaced).cast(pa.large_binary()))


def piece_vocabulary(path: str) -> PieceVocabulary:
    return worker_state(f"pieces {path}", lambda: PieceVocabulary(path))


def prefix_table(path: str) -> PrefixTable:
    return worker_state(f"prefix-table {path}", lambda: PrefixTable(piece_vocabulary(path)))


def piece_encoder(path: str) -> PieceEncoder:
    return worker_state(f"piece-encoder {path}", lambda: PieceEncoder(piece_vocabulary(path), prefix_table(path), None))


class PieceDecoder:
    """Texts of ids: the first mark goes, others are spaces, spelled bytes that are not UTF-8 become U+FFFD each."""

    def __init__(self, vocab: PieceVocabulary):
        self.vocab, self.table = vocab, pa.array(vocab.raw, pa.large_binary())

    def _slowly(self, ids: list[int]) -> bytes:
        out, run, vocab = [], b"", self.vocab
        for i in [*ids, None]:
            if i is not None and vocab.is_byte[i]:
                run += vocab.raw[i]
                continue
            while run:
                size = next((n for n in range(1, 5) if _is_character(run[:n])), 0)
                out.append(run[:size] if size else "�".encode())
                run = run[size or 1 :]
            out.append(b"" if i is None else vocab.raw[i])
        return b"".join(out)

    def __call__(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """UTF-8 texts; text i has the ids from starts[i] to starts[i + 1]."""
        got = self.table.take(pa.array(ids.astype(np.int64)))
        ends, data = lists_offsets(got)[starts].tolist(), memoryview(got.buffers()[2] or b"")
        out, control, marked = [], self.vocab.control, self.vocab.marked
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            text = bytes(data[a:b])
            if not text.isascii():
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._slowly(ids[starts[k] : starts[k + 1]].tolist())
            first = next((i for i in ids[starts[k] : starts[k + 1]] if not control[i]), None)
            out.append(text[1:] if first is not None and marked[first] else text)
        return out


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def piece_decoder(path: str) -> PieceDecoder:
    return worker_state(f"piece-decoder {path}", lambda: PieceDecoder(piece_vocabulary(path)))


def _encode_batches(path: str, with_ids: bool):
    def run(batches):
        one_operator("piece-bpe")
        encoder, decode = piece_encoder(path), piece_decoder(path)
        begin, end = (i.to_bytes(4, "little") for i in (encoder.vocab.begin, encoder.vocab.end))
        for batch in batches:
            coded = [begin + x + end for x in encoder.encode(batch.column(1))]
            counts = np.array([len(x) // 4 for x in coded], np.int64)
            texts = decode(np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(counts)]))
            columns = [batch.column(0), pa.array(counts), *(pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (coded, texts))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pieces: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids) of every row, with begin and end ids; no shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = bounded_batches(docs, ENCODE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(_encode_batches(pieces or default_pieces(), with_ids), schema)


def decode_documents(encoded: DataFrame, pieces: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give an empty text."""
    path = pieces or default_pieces()

    def run(batches):
        one_operator("piece-bpe")
        decode = piece_decoder(path)
        for batch in batches:
            ids = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            texts = decode(np.concatenate([*ids, np.empty(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
