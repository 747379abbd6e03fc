"""Byte-level BPE vocabulary tables and pre-tokenisation shared by operators 3, 5, 6 and 7."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import worker_state

#: Bytes of text that are encoded together: many enough for distinct chunks to be few.
ENCODE_BYTES = 8 << 20
#: Texts that the tokenizers library encodes in one call.
AT_ONCE = 32
# The published pre-tokenisation pattern of byte-level BPE, with
# the white-space class written as the Unicode property.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A space before a visible character always starts a new pre-token, so cutting
# there first is safe and lets whole "word with punctuation" chunks be cached.
CUT = regex.compile(r" (?=\P{White_Space})")
WIDE = re.compile(r" (?:\s|$)")  # \s covers all white space
WIDE_RE2 = r" (?:[\s\v\x1c-\x1f\x{85}\pZ]|$)"  # the same where \s is ASCII only
VISIBLE = regex.compile(r"\P{White_Space}").match


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in characters of byte-level BPE → byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merge ranks and special strings of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens with strip or word rules are not supported")
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.path = path
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.token_bytes = {i: b for b, i in self.ids.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left id, right id) → (rank, merged id)
        self.merges = {}
        for rank, (left, right) in enumerate(merges):
            a, b = raw(left), raw(right)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes.update({i: s.encode() for s, i in self.special.items()})
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def parts(self, text: str) -> list[str]:
        """Alternating ordinary text and special strings (odd places)."""
        if self.special_re is None or not any(s in text for s in self.special):
            return [text]
        return self.special_re.split(text)


def vocabulary(path: str) -> Vocabulary:
    return worker_state(f"vocabulary {path}", lambda: Vocabulary(path))


def chunks_of(text: str) -> list[str]:
    """Cut at every space that a visible character follows; each later chunk keeps its space."""
    if not text:
        return []
    if WIDE.search(text):
        pieces = CUT.split(text)
        rest = [" " + p for p in pieces[1:]]
    else:  # every space has a visible character after it
        pieces = text.split(" ")
        rest = list(map(" ".__add__, pieces[1:]))
    return [pieces[0], *rest] if pieces[0] else rest


def pretokens(chunk: str) -> list[str]:
    """Pre-tokens of a chunk; one of letters after an optional space is a single one."""
    return [chunk] if chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " " else PRETOKEN.findall(chunk)


class Encoder:
    """Whole texts through an engine that sees each distinct chunk only while it is not cached.

    Arrow cuts all texts of a batch at their spaces and numbers the distinct
    chunks; ``engine(chunks, joint)`` gives the values of those not cached, and
    the values are dealt back by number.  Values are bytes (of ids), kept end to
    end in one array.  Texts where a space precedes white space, or that hold
    special strings, are cut one by one.

    Chunks that occur twice in a batch enter the cache; when it exceeds ``limit``
    bytes, the half met first (mostly the frequent ones) stays.
    """

    #: Rough size in memory of a cached chunk besides its characters and value.
    ENTRY = 160

    def __init__(self, vocab: Vocabulary, engine, special, limit: int = 64 << 20):
        self.vocab, self.engine, self.special, self.limit = vocab, engine, special, limit
        self.place: dict[str, int] = {}
        self.data, self.sizes, self.bytes = b"", np.empty(0, np.int64), 0

    def _keep(self, chunks: list[str], values: list[bytes]) -> None:
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks))))
        self.data += b"".join(values)
        self.sizes = np.append(self.sizes, np.fromiter(map(len, values), np.int64, len(values)))
        self.bytes += self.ENTRY * len(chunks) + sum(map(len, chunks)) + sum(map(len, values))
        if self.bytes > self.limit:
            half = len(self.place) // 2
            self.place = dict(islice(self.place.items(), half))
            self.sizes = self.sizes[:half]
            self.data = self.data[: int(self.sizes.sum())]
            self.bytes //= 2

    def _table(self, chunks: list[str], uses: np.ndarray, joint: bool) -> pa.Array:
        """Values of distinct chunks as a large binary array."""
        at = np.array(list(map(self.place.get, chunks, repeat(-1))), np.int64)
        fresh = np.flatnonzero(at < 0)
        new = [chunks[i] for i in fresh.tolist()]
        data, sizes = self.engine(new, joint)
        offsets = np.concatenate([[0], np.cumsum(self.sizes), len(self.data) + np.cumsum(sizes)]).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.data + data)])
        at[fresh] = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
        out = every.take(pa.array(at))
        often = [k for k, i in enumerate(fresh.tolist()) if uses[i] > 1 and len(chunks[i]) <= 256]
        if often:
            ends = np.cumsum(sizes)
            self._keep([new[k] for k in often], [data[ends[k] - sizes[k] : ends[k]] for k in often])
        return out

    def _spread(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(values of all chunks in order, first chunk of each text) of texts that spaces cut safely."""
        pieces = pc.split_pattern(texts, " ")
        starts = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        coded = flat.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        uses = np.bincount(number, minlength=len(coded.dictionary))
        first = flat.take(pa.array(starts[:-1])).dictionary_encode()  # no space stands before these
        number[starts[:-1]] = first.indices.to_numpy().astype(np.int64) + len(coded.dictionary)
        spaced = self._table(list(map(" ".__add__, coded.dictionary.to_pylist())), uses, True)
        table = pa.concat_arrays([spaced, self._table(first.dictionary.to_pylist(), np.zeros(len(first.dictionary)), False)])
        return table.take(pa.array(number)), starts

    def _spread_slowly(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        numbers, starts, seen, special = [], [0], {}, self.vocab.special
        for text in texts:
            for i, part in enumerate(self.vocab.parts(text)):
                for c in [part] if i % 2 else chunks_of(part):
                    numbers.append(seen.setdefault(c, len(seen)))
            starts.append(len(numbers))
        number = np.array(numbers, np.int64)
        uses = np.bincount(number, minlength=len(seen))
        ordinary = [c not in special for c in seen]
        rest = iter(self._table([c for c in seen if c not in special], uses[ordinary], False).to_pylist())
        table = pa.array([next(rest) if o else self.special(c) for c, o in zip(seen, ordinary)], pa.large_binary())
        return table.take(pa.array(number)), np.array(starts, np.int64)

    def encode(self, raws: pa.Array) -> list[bytes]:
        """The values of every text's chunks, joined."""
        out: list = [b""] * len(raws)
        texts = as_texts(raws)
        slow = pc.match_substring_regex(texts, WIDE_RE2)
        for s in self.vocab.special:
            slow = pc.or_(slow, pc.match_substring(texts, s))
        slow = slow.to_numpy(zero_copy_only=False)
        for which in (~slow, slow):
            if not which.any():
                continue
            some = texts if which.all() else texts.filter(pa.array(which))
            values, starts = self._spread_slowly(some.to_pylist()) if slow[which][0] else self._spread(some)
            ends = lists_offsets(values)[starts].tolist()
            data = memoryview(values.buffers()[2] or b"")
            for i, a, b in zip(np.flatnonzero(which).tolist(), ends, ends[1:]):
                out[i] = bytes(data[a:b])
        return out


def lists_offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a large binary array's values."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def as_texts(raws: pa.Array) -> pa.Array:
    """Binary UTF-8 as large strings; what is not UTF-8 gets U+FFFD."""
    try:
        return raws.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in raws.to_pylist()], pa.large_string())


def by_pretokens(engine, limit: int = 200_000):
    """An engine for chunks from one for distinct pre-tokens (a bytes value each); pre-tokens of several chunks are cached."""
    known: dict[str, bytes] = {}

    def run(chunks: list[str], joint: bool) -> tuple[bytes, np.ndarray]:
        nonlocal known
        parts = list(map(pretokens, chunks))
        need = list({w for p in parts for w in p if w not in known})
        value = dict(zip(need, engine(need), strict=True))
        out = []
        for p in parts:
            if len(p) == 1:
                out.append(value.get(p[0]) or known[p[0]])
            else:
                got = [value.get(w) or known[w] for w in p]
                out.append(b"".join(got))
                known.update((w, v) for w, v in zip(p, got) if len(w) <= 64)
        if len(known) > limit:
            known = dict(islice(known.items(), limit // 2))
        return b"".join(out), np.fromiter(map(len, out), np.int64, len(out))

    return run


def library_engine(path: str, together: int = 1000, plain: bool = False):
    """Ids of chunks (little-endian uint32 bytes) from the tokenizers library itself; ``plain``: special strings are ordinary text.

    ``joint`` chunks start with a space and a visible character, so they are
    pre-tokenised alike behind one another, and many are encoded as one text; the
    tokens' byte lengths tell where each chunk ends.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = plain
    vocab = vocabulary(path)
    size = np.zeros(max(vocab.token_bytes) + 1, np.int64)
    size[list(vocab.token_bytes)] = [len(b) for b in vocab.token_bytes.values()]

    def encode(chunks: list[str], joint: bool) -> tuple[bytes, np.ndarray]:
        texts = ["".join(chunks[at : at + together]) for at in range(0, len(chunks), together)] if joint else chunks
        got = []
        for at in range(0, len(texts), AT_ONCE):  # the library's encodings take far more memory than ids
            got += [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        ids = np.concatenate([*got, np.empty(0, "<u4")])
        if not joint:
            return ids.tobytes(), np.array([4 * len(x) for x in got], np.int64)
        borders = np.cumsum(pc.binary_length(pa.array(chunks, pa.large_string())).to_numpy().astype(np.int64))
        cuts = np.searchsorted(np.cumsum(size[ids]), borders) + 1
        return ids.tobytes(), 4 * np.diff(cuts, prepend=0)

    return encode


def library_encoder(path: str) -> Encoder:
    vocab = vocabulary(path)
    return Encoder(vocab, library_engine(path), lambda s: vocab.special[s].to_bytes(4, "little"))


def shared_library_encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that its caches serve all its tasks."""
    return worker_state(f"library-encoder {path}", lambda: library_encoder(path))
