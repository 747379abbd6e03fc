"""MinHash near-dedup with HyperMinHash registers.

Each text becomes a set of 64-bit five-word shingle hashes and a HyperMinHash
sketch: REGISTERS buckets, each holding the leading-zero count and the mantissa
bits of its least hash.  Bands of registers give candidates, a
collision-corrected Jaccard estimate drops the hopeless ones, and every link is
confirmed on the full sets (100 * intersection >= 75 * union).

Texts with equal sets are one class; its node is a number taken from the set's
print, never from a doc_id.  No pair list of a group is ever made.  In each band
bucket every class first meets only the bucket's leader; what remains possible
is verified.  Buckets of three or more that then still hold several components
are compared, those outside the largest component against all, by small
signatures first and by sketches where these leave a pair possible.  That gives
a spanning forest of the possible pairs; its trees are families, whose members
are verified in the same way.  Buckets with equal members are compared once.  A sketch or text moves only for classes in pairs
that passed the size and signature tests.

Defined results: null or empty text, and text without words, has an empty set
and no links; under five words the whole word sequence is the one shingle; rows
with equal doc_id and different texts are different documents that share an id;
``drop_near_copies`` keeps one row of each component, repeated rows included; a
null doc_id links with nothing (component null) and stays; there are no ties, as
components have one smallest doc_id; empty tables give empty tables; extra
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounded_batches, connected_components, discard, join_by_key, materialize, named, once_each, one_operator, rows_marked, text_bytes

SHINGLE, LEAST_PERCENT = 5, 75
#: A pair at Jaccard 0.75 misses all 60 bands of 5 with probability (1 - 0.75**5)**60 < 1e-7.
BANDS, ROWS = 60, 5
REGISTERS = BANDS * ROWS
#: Sets up to this many shingles are banded by their full buckets alone; those above 3/4 of it, too, by registers without empty ones.
SPARSE = 64
MANTISSA = 10
#: Bits of the signatures that are compared before sketches: one of each of so many registers, and whether it is full.
SIGNATURE = 256
WORDS64 = SIGNATURE // 64
#: Members verified against one copy of their leader in one task.
STAR = 512
#: Rows of a block of a bucket; of a family, rows and shingles (8 bytes each) of a block.
BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 2048, 256, 1_000_000
#: Wanted nodes that may be broadcast against the texts, 24 bytes each; more of them meet the texts in a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Bytes of a word that the byte table covers; words hashed at once.
MAX_WORD, WORDS_AT_ONCE = 64, 100_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _byte_table() -> np.ndarray:
    """A random 64-bit number for every place in a word and byte; A-Z count as a-z."""
    with np.errstate(over="ignore"):
        table = _mix(_mix(np.arange(1, MAX_WORD * 256 + 1, dtype=np.uint64) * _MULT[4])).reshape(MAX_WORD, 256)
    table[:, 65:91] = table[:, 97:123]
    return table.ravel()


_BYTES = _byte_table()
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a whole text; tabulation hashing, and xxhash for words over MAX_WORD bytes."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(starts), WORDS_AT_ONCE):
            start = starts[k : k + WORDS_AT_ONCE]
            long = np.minimum(ends[k : k + WORDS_AT_ONCE] - start, MAX_WORD)
            first = np.cumsum(long) - long
            place = np.arange(int(long.sum())) - np.repeat(first, long)
            values = _BYTES[(place << 8) | data[place + np.repeat(start, long)]]
            out[k : k + WORDS_AT_ONCE] = _mix(np.add.reduceat(values, first) + long.astype(np.uint64))
    for k in np.flatnonzero(ends - starts > MAX_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].lower())
    return starts, out


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each whole text."""
    starts, h = word_hashes(b" ".join(raws))
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    at = np.searchsorted(starts, begins).tolist()
    n, sets = max(0, len(h) - SHINGLE + 1), []
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            rolled = _mix(rolled + h[i : i + n] * _MULT[i])
        for lo, hi in zip(at, at[1:]):
            if hi - lo >= SHINGLE:
                mine = np.sort(rolled[lo : hi - SHINGLE + 1])
                fresh = np.ones(len(mine), bool)
                np.not_equal(mine[1:], mine[:-1], out=fresh[1:])
                sets.append(mine[fresh])
            elif hi == lo:
                sets.append(np.empty(0, np.uint64))
            else:  # the length keeps short sequences apart from longer ones
                mixed = np.uint64(hi - lo)
                for i, x in enumerate(h[lo:hi]):
                    mixed = _mix(mixed + x * _MULT[i])
                sets.append(np.array([mixed], np.uint64))
    return sets


def shingle_set(raw: bytes) -> np.ndarray:
    return shingle_sets([raw])[0]


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """(n, REGISTERS) HyperMinHash: per bucket, leading zeros (6 bits) and MANTISSA bits of the least hash, packed; 0: empty bucket."""
    shingles = np.concatenate([*sets, np.empty(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)) * REGISTERS, [len(s) for s in sets])
    with np.errstate(over="ignore"):
        spread = _mix(shingles * np.uint64(0x9FB21C651E98DF25))
    bucket = row + (spread % np.uint64(REGISTERS)).astype(np.int64)
    value = _mix(spread) >> np.uint64(11)  # 53 bits: exact as a float
    least = np.full(len(sets) * REGISTERS, np.uint64(2**53), np.uint64)
    np.minimum.at(least, bucket, value)
    full = least < 2**53
    fraction, power = np.frexp(least[full].astype(np.float64))
    zeros = np.minimum(53 - power, 62)
    bits = np.where(fraction > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    out[full] = (((zeros + 1) << MANTISSA) | bits).astype(np.uint16)
    return out.reshape(-1, REGISTERS)


def registers(shingles: np.ndarray) -> np.ndarray:
    return registers_of([shingles])[0]


def _lenders() -> np.ndarray:
    """(REGISTERS, REGISTERS): for each register its own random order of all registers."""
    with np.errstate(over="ignore"):
        rank = _mix(_mix(np.arange(1, REGISTERS**2 + 1, dtype=np.uint64) * _MULT[3])).reshape(REGISTERS, REGISTERS)
    return np.argsort(rank, axis=1, kind="stable")


_LENDERS = _lenders()


def densified(sketches: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers have the value of the first full one in their own order of registers.

    So every register of two sets agrees with the probability of their Jaccard
    index; registers that are empty in both say nothing about the sets.
    """
    out = sketches.copy()
    row, column = np.nonzero((out == 0) & sketches.any(1)[:, None])
    for k in range(REGISTERS):
        if not len(row):
            break
        lent = sketches[row, _LENDERS[column, k]]
        out[row, column] = lent
        left = lent == 0
        row, column = row[left], column[left]
    return out


def band_keys(sketches: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit key) of the bands of (n, REGISTERS) sketches of sets of so many shingles.

    Bands with empty registers meet sets that share one shingle, so only sets of at
    most SPARSE shingles have them, which fill few bands.  A pair at 0.75 is within one of the two kinds.
    """
    found = []
    for kind, mine in enumerate((sizes <= SPARSE, sizes * 4 > SPARSE * 3)):
        rows = np.flatnonzero(mine)
        bands = (densified(sketches[rows]) if kind else sketches[rows]).reshape(-1, BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = np.tile((np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(kind * BANDS)) * _MULT[0], (len(bands), 1))
            for i in range(ROWS):
                keys = _mix(keys + bands[:, :, i] * _MULT[i])
        full = bands.any(2)
        found.append((rows[np.nonzero(full)[0]], keys[full].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def chance_match(sizes_a, sizes_b) -> np.ndarray:
    """Expected share of full buckets whose registers agree by accident.

    Two unrelated minima of n and m hashes per bucket fall in the same cell
    mostly through equal mantissas within one octave: about 2**-MANTISSA times
    the chance of the same octave, which is largest (about 1/2) for like sizes.
    """
    ratio = np.minimum(sizes_a, sizes_b) / np.maximum(np.maximum(sizes_a, sizes_b), 1)
    return 0.5 * ratio * 2.0**-MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, sizes_a, sizes_b) -> np.ndarray:
    """Collision-corrected Jaccard estimates of sketches a and b (broadcast over leading axes)."""
    full = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    raw, by_chance = same / np.maximum(full, 1), chance_match(sizes_a, sizes_b)
    return np.clip((raw - by_chance) / (1 - by_chance), 0, 1)


def floor_for(full, sizes_a, sizes_b) -> np.ndarray:
    """Estimate below which a pair is hopeless: five standard errors under 0.75.

    The full buckets show a random part of the union, drawn without replacement,
    so small sets, which the sketch shows almost whole, have a sharp estimate.
    """
    full, union = np.maximum(full, 1), np.maximum((np.asarray(sizes_a) + sizes_b) / 1.75, 2)
    return 0.75 - 0.01 - 5 * np.sqrt(0.1875 / full * np.clip((union - full) / (union - 1), 0, 1))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on full sets."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < LEAST_PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= LEAST_PERCENT * (len(a) + len(b) - both)


def node_of(set_print: bytes) -> int:
    return int.from_bytes(set_print[:8], "little") >> 1


def signature(sketches: np.ndarray) -> np.ndarray:
    """(n, 2 * WORDS64) int64: one bit of each of the first SIGNATURE registers, then whether it is full."""
    part = sketches[:, :SIGNATURE]
    return np.packbits(np.concatenate([part & 1, part != 0], axis=1).astype(bool), axis=1).view(np.int64)


def signatures_allow(unlike, full):
    """Whether a pair may reach 0.75: then an eighth of the bits differs on average, here up to five standard errors more."""
    return unlike <= full * 0.125 + 5 * (full * 0.109375) ** 0.5 + 1


_MOST_UNLIKE = np.array([k * 0.125 + 5 * (k * 0.109375) ** 0.5 + 1 for k in range(SIGNATURE + 1)])
SIGNS = [f"s{i}" for i in range(2 * WORDS64)]
SKETCH_SCHEMA = "doc_id long, mark long, n_shingles long, node long, print binary, sketch binary, " + ", ".join(f"{c} long" for c in SIGNS)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one_operator("near")
    for batch in batches:
        sets = shingle_sets(batch.column(2).to_pylist())
        sizes = [len(s) for s in sets]
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        rows = registers_of(sets)
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([p and node_of(p) for p in prints], pa.int64()), pa.array(prints, pa.binary())]
        columns += [pa.array([x.tobytes() if p else None for x, p in zip(rows, prints)], pa.binary()), *(pa.array(c) for c in signature(rows).T)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "node", "print", "sketch", *SIGNS])


def sketch_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, node and print of the set (null for an empty one), sketch and signature."""
    raw = text_bytes(text)
    rows = bounded_batches(docs).select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(raw).alias("mark"), raw.alias("raw"))
    return rows.mapInArrow(_sketch_batches, SKETCH_SCHEMA)


def unclashed(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``rows`` with nodes of their own for sets whose prints differ but whose nodes don't; None where there are none.

    At 64-bit nodes even 10^10 classes have about three such sets.
    """
    bad = classes.where("lo <> hi").select("node")
    if bad.isEmpty():
        return None
    prints = rows.join(bad, "node", "left_semi").select("print").distinct().orderBy("print").collect()
    own = rows.sparkSession.createDataFrame([(bytes(r.print), -1 - i) for i, r in enumerate(prints)], "print binary, own long")
    return rows.join(F.broadcast(own), "print", "left").withColumn("node", F.coalesce("own", "node")).select(rows.columns)


def classes_of(rows: DataFrame) -> DataFrame:
    """node, copies, n_shingles, first (doc_id and mark of a row) and signature of each class of equal sets; combined on the map side."""
    sums = [F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "mark")).alias("first")]
    edges = [F.min("print").alias("lo"), F.max("print").alias("hi")]
    return rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(*sums, *edges, *[F.min(c).alias(c) for c in SIGNS])


def _band_batches(batches):
    """(key, node); a task gives a node's bands once as long as it remembers the node."""
    seen: set = set()
    for batch in batches:
        if len(seen) > 200_000:
            seen.clear()
        fresh = {node: k for k, node in enumerate(batch.column(0).to_pylist()) if node not in seen}
        seen.update(fresh)
        at = pa.array([*fresh.values()], pa.int64())
        sketches, sizes = batch.column(1).take(at).to_pylist(), batch.column(2).take(at).to_numpy()
        row, keys = band_keys(np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array([*fresh], np.int64)[row])], ["key", "node"])


def _shared_keys(batches):
    """(key, node, leader) of keys with several nodes, from rows sorted by key and node; a key's least node leads it."""
    key, leader, last, told = None, None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = (batch.column(i).to_numpy() for i in (0, 1))
        new = np.empty(len(keys), bool)
        new[0], new[1:] = keys[0] != key, keys[1:] != keys[:-1]
        fresh = new.copy()  # the first row of each (key, node)
        fresh[0] |= nodes[0] != last
        fresh[1:] |= nodes[1:] != nodes[:-1]
        starts = np.where(new, np.arange(len(keys)), -1)
        starts = np.maximum.accumulate(starts)
        leaders = np.where(starts >= 0, nodes[starts], 0 if leader is None else leader)
        follow = fresh & (nodes != leaders)
        out = [np.stack([keys[follow], nodes[follow], leaders[follow]])]
        with_leader = np.unique(np.where(starts >= 0, starts, -1)[follow])
        if len(with_leader) and with_leader[0] < 0:  # the key began in an earlier batch
            if not told:
                out.append(np.array([[key], [leader], [leader]]))
                told = True
            with_leader = with_leader[1:]
        out.append(np.stack([keys[with_leader], nodes[with_leader], nodes[with_leader]]))
        if starts[-1] >= 0:
            told = bool(len(with_leader)) and with_leader[-1] == starts[-1]
        key, leader, last = keys[-1], leaders[-1], nodes[-1]
        found = np.concatenate(out, axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "node", "leader"])


def bucket_members(rows: DataFrame) -> DataFrame:
    """(key, node, leader) of the band buckets that hold several classes.

    The 16-byte band rows move once; a bucket of any size passes by in order and is never held.
    """
    bands = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").select("node", "sketch", "n_shingles").mapInArrow(_band_batches, "key long, node long")
    return bands.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared_keys, "key long, node long, leader long")


def sketches_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, sketch): one sketch of each wanted node."""
    wanted = materialize(nodes.distinct(), "wanted-sketches")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return rows.where("doc_id IS NOT NULL").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("sketch").alias("sketch"))


def possible_pairs(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes, then signatures, then the sketches' Jaccard estimate leave at 0.75 or more."""
    fact = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), *[F.col(c).alias(c + x) for c in SIGNS])
    both = pairs.join(fact("a"), "a").join(fact("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * LEAST_PERCENT)
    unlike = sum(F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(WORDS64))
    full = sum(F.bit_count(F.col(f"s{i}a").bitwiseOR(F.col(f"s{i}b"))) for i in range(WORDS64, 2 * WORDS64))
    left = materialize(both.where(signatures_allow(unlike, full)).select("a", "b", "na", "nb"), "alike")
    sketches = sketches_of(left.select(F.col("a").alias("node")).union(left.select("b")), rows)
    sa, sb = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return left.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_estimate_batches, "a long, b long")


def _estimate_batches(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(i)), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        keep = pa.array(estimate(a, b, na, nb) >= floor_for(((a != 0) | (b != 0)).sum(-1), na, nb))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, raw): one text of each wanted node; only wanted texts are moved while the list is short."""
    wanted = materialize(nodes.distinct().join(classes.select("node", "first.*"), "node"), "wanted")
    raw = text_bytes(text)
    texts = docs.select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(raw).alias("mark"), raw.alias("raw"))
    got = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["doc_id", "mark"])
    return materialize(got.groupBy("node").agg(F.min("raw").alias("raw")), "wanted-texts")  # rows may repeat


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify_stars(batches):
    """Rows sorted by (a, salt, role): the leader's text, then its members'."""
    one_operator("near")
    at, leader = None, None
    for batch in batches:
        found = []
        for g, s, role, node, mine in zip(*(batch.column(i).to_pylist() for i in range(4)), shingle_sets(batch.column(4).to_pylist())):
            if role == 0:
                at, leader = (g, s), mine
            elif at == (g, s) and linked(leader, mine):
                found.append((g, node))
        yield _edges(found)


def verify_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs whose full sets reach the threshold; a leader's members are salted over several tasks."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("members") / STAR))).alias("salt"))
    wanted = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node")).union(
        salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node")).distinct()
    )
    wanted = materialize(wanted, "star-rows")
    rows = wanted.join(texts_of(wanted.select("node"), classes, docs, doc_id, text), "node").select("a", "salt", "role", "node", "raw")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_verify_stars, "a long, b long")


def dealt(rows: DataFrame, group: str, most: int, weight: str | None = None, most_weight: int = 1, once: bool = False) -> DataFrame:
    """``rows`` (group, node, comp) as block pairs: those outside a group's largest component (side 0) with all (side 1).

    A block has about ``most`` rows, and at most about ``most_weight`` of ``weight``
    in sum.  Groups of one component are left out.  ``once``: a row of a group that is
    a single block pair comes once; such a pair has j = -1, and its side 0 is also to be compared within itself.
    """
    load = F.sum(weight) if weight else F.lit(0).cast("long")
    parts = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"), load.alias("w"))
    main = F.max(F.struct("n", "w", "comp")).alias("main")
    sums = parts.groupBy(group).agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w"), main).where("comps > 1")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(w / most_weight)).cast("int")
    outside = blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w"))
    plan = sums.select(group, F.col("main.comp").alias("main_comp"), outside.alias("n_left"), blocks(F.col("n"), F.col("w")).alias("n_right"))
    known = rows.join(plan, group)
    mine = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = known.where("comp <> main_comp").withColumn("i", mine("n_left")).withColumn("j", upto("n_right")).withColumn("side", F.lit(0))
    right = known.withColumn("i", upto("n_left")).withColumn("j", mine("n_right")).withColumn("side", F.lit(1))
    if once:
        alone = (F.col("n_left") == 1) & (F.col("n_right") == 1)
        left, right = (x.withColumn("j", F.when(alone, -1).otherwise(F.col("j"))) for x in (left, right.where(~alone | (F.col("comp") == F.col("main_comp")))))
    return left.unionByName(right).drop("main_comp", "n_left", "n_right")


def _segments(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of rows that agree in all columns."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(change).tolist()]
    yield from zip(starts, [*starts[1:], len(change)])


def _block_pairs(batches, at_once: int, allows, data):
    """Sorted (key, i, j, side, node, comp, n_shingles, ...) rows: (key, nodes, nodes) of the pairs of different
    components that sizes and ``allows`` leave possible, batch by batch; ``data(batch)`` is what ``allows`` compares.
    Where j is -1 rows of side 0 meet those of side 0 before them too."""
    at, left = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j, side, node, comp, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        facts, found = data(batch), []
        for start, end in _segments([key, i, j, side]):
            here = (key[start], i[start], j[start])
            mine = tuple(x[start:end] for x in (node, comp, n, facts))
            if here != at:
                at, left = here, None
            if side[start] == 0:
                before = 0 if left is None else len(left[0])
                left = mine if left is None else tuple(np.concatenate(x) for x in zip(left, mine))
                if j[start] >= 0:
                    continue
            if left is None:
                continue
            step = max(1, at_once // len(left[0]))
            for k in range(0, end - start, step):
                some, other = tuple(x[k : k + step] for x in mine), left
                if side[start] == 0:
                    other = tuple(x[: before + k + step] for x in left)
                able = (some[1][:, None] != other[1]) & (np.minimum(some[2][:, None], other[2]) * 100 >= LEAST_PERCENT * np.maximum(some[2][:, None], other[2]))
                if side[start] == 0:
                    able &= np.arange(len(other[0])) < before + k + np.arange(len(some[0]))[:, None]
                if able.any():
                    x, y = np.nonzero(able & allows(some[3], other[3], some[2], other[2]))
                    found.append((here, some[0][x], other[0][y]))
        yield found


def _signs_allow(a, b, na, nb):
    """(len(a), len(b)) whether signatures leave a pair possible."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    differ, full = (np.zeros((len(a), len(b)), np.int64) for _ in "ab")
    for w in range(WORDS64):
        differ += np.bitwise_count(a[:, w, None] ^ b[:, w])
        full += np.bitwise_count(a[:, WORDS64 + w, None] | b[:, WORDS64 + w])
    return differ <= _MOST_UNLIKE[full]


def _sketches_allow(a, b, na, nb):
    """(len(a), len(b)) whether the estimate from sketches leaves a pair possible."""
    same = np.stack([np.count_nonzero(b == np.where(x, x, 1), axis=1) for x in a])  # no register is 1, so empty ones match nothing
    in_a, in_b = (a != 0).astype(np.float32), (b != 0).astype(np.float32)
    full = np.maximum(in_a.sum(1)[:, None] + in_b.sum(1) - in_a @ in_b.T, 1)
    by_chance = chance_match(na[:, None], nb)
    return (same / full - by_chance) / (1 - by_chance) >= floor_for(full, na[:, None], nb)


def _flag_members(batches):
    """(key, node) of the members of which signatures leave a pair possible."""
    signs = lambda batch: np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(7, 7 + len(SIGNS))], axis=1)
    told = lambda key, nodes: pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), key, np.int64)), pa.array(nodes)], ["key", "node"])
    at, flagged = None, np.empty(0, np.int64)
    for found in _block_pairs(batches, 100_000, _signs_allow, signs):
        for here, a, b in found:
            if here != at:
                if len(flagged):
                    yield told(at[0], flagged)
                at, flagged = here, np.empty(0, np.int64)
            flagged = np.unique(np.concatenate([flagged, a, b]))  # a block pair names a member once
    if len(flagged):
        yield told(at[0], flagged)


def _possible_forest(batches):
    """A spanning forest, per block pair, of the pairs that the sketches leave possible."""
    sketches = lambda batch: np.frombuffer(b"".join(x.as_py() for x in batch.column(7)), np.uint16).reshape(-1, REGISTERS)
    at, forest, number = None, Forest(0), {}
    for found in _block_pairs(batches, 100_000, _sketches_allow, sketches):
        edges = []
        for here, a, b in found:
            if here != at:
                at, forest, number = here, Forest(0), {}
            for p, q in zip(a.tolist(), b.tolist()):
                for m in (p, q):
                    if m not in number:
                        number[m] = len(number)
                        forest.up.append(number[m])
                if forest.join(number[p], number[q]):
                    edges.append((p, q))
        yield _edges(edges)


def _verify_family(batches):
    """Sorted (family, i, j, side) rows: the links, per block pair, that join components; side 0 is held, side 1 passes by."""
    one_operator("near")
    at, held, sketches, sizes, forest, number = None, [], None, None, None, {}
    for batch in batches:
        found = []
        sets = shingle_sets(batch.column(6).to_pylist())
        for family, i, j, side, node, comp, mine, own in zip(*(batch.column(k).to_pylist() for k in range(6)), sets, registers_of(sets)):
            if (family, i, j) != at:
                at, held, sketches, forest, number = (family, i, j), [], None, Forest(0), {}
            if comp not in number:
                number[comp] = len(number)
                forest.up.append(number[comp])
            if side == 0:
                held.append((node, number[comp], mine, own))
                continue
            if sketches is None and held:
                sketches, sizes = np.array([r for *_, r in held]), np.array([len(s) for _, _, s, _ in held])
            if not held:
                continue
            able = np.minimum(sizes, len(mine)) * 100 >= LEAST_PERCENT * np.maximum(sizes, len(mine))
            able &= estimate(sketches, own, sizes, len(mine)) >= floor_for(((sketches != 0) | (own != 0)).sum(1), sizes, len(mine))
            for k in np.flatnonzero(able).tolist():
                other, c, their, _ = held[k]
                if forest.root(c) != forest.root(number[comp]) and linked(their, mine):  # what is connected needs no proof
                    forest.join(c, number[comp])
                    found.append((other, node))
        yield _edges(found)


def possible_families(members: DataFrame, classes: DataFrame, components: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, family): classes that sketches leave linkable across components, from buckets that still hold several."""
    # two members have met as leader and member; buckets of equal members are compared once
    stands_for = F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")
    once = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), stands_for).where("size > 2").groupBy("size", "members").agg(F.min("key").alias("key"))
    open_rows = members.join(once.select("key"), "key").select("key", "node").join(components, "node", "left")
    open_rows = materialize(open_rows.select("key", "node", F.coalesce("component", "node").alias("comp")), "open-buckets")
    facts = ["key", "i", "j", "side", "node", "comp", "n_shingles"]
    in_order = lambda blocks, *more: blocks.select(*facts, *more).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    first = in_order(dealt(open_rows, "key", BLOCK, once=True).join(classes.select("node", "n_shingles", *SIGNS), "node"), *SIGNS)
    flagged = materialize(first.mapInArrow(_flag_members, "key long, node long").distinct(), "flagged")
    some = dealt(open_rows.join(flagged, ["key", "node"]), "key", BLOCK, once=True).join(classes.select("node", "n_shingles"), "node")
    edges = in_order(some.join(sketches_of(flagged.select("node"), rows), "node"), "sketch").mapInArrow(_possible_forest, "a long, b long")
    return connected_components(edges, "families").withColumnRenamed("component", "family")


def family_links(families: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Confirmed links between components."""
    rows = families.join(components, "node", "left").select("family", "node", F.coalesce("component", "node").alias("comp"))
    rows = materialize(rows.join(classes.select("node", "n_shingles"), "node"), "family-rows")
    texts = texts_of(rows.select("node"), classes, docs, doc_id, text)
    pairs = dealt(rows, "family", FAMILY_BLOCK, "n_shingles", BLOCK_SHINGLES).join(texts, "node").select("family", "i", "j", "side", "node", "comp", "raw")
    return pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side").mapInArrow(_verify_family, "a long, b long")


def component_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component_id, keeper (doc_id and mark of the row that stands for the component)."""
    spark = docs.sparkSession
    rows = materialize(sketch_documents(docs, doc_id, text), "sketches")
    classes = classes_of(rows)
    classes = materialize(classes, "classes")
    apart = unclashed(rows, classes)
    if apart is not None:
        rows = materialize(apart, "sketches-apart")
        classes = materialize(classes_of(rows), "classes-apart")
    members = materialize(bucket_members(rows), "bucket-members")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(possible_pairs(stars, classes, rows), "stars")
    links = materialize(verify_pairs(stars, classes, docs, doc_id, text), "star-links")
    comps = connected_components(links, "first")
    families = possible_families(members, classes, comps, rows)
    if not families.isEmpty():
        links = materialize(links.union(family_links(families, comps, classes, docs, doc_id, text)), "links")
        comps = connected_components(links, "last")
    discard(spark, members)
    # a component stands for its smallest row; only classes of several rows or with links need one named
    linked_classes = classes.select("node", "copies", "first").join(comps, "node", "left")
    heads = linked_classes.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("keeper"))
    facts = linked_classes.join(heads, "component", "left").where("copies > 1 OR component IS NOT NULL").select("node", "copies", F.coalesce("keeper", "first").alias("keeper"))
    mine = rows.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    out = join_by_key(mine, materialize(facts, "class-facts"), "node", "copies", mine.count())
    out = out.withColumn("keeper", F.coalesce("keeper", own))
    return out.select("doc_id", "mark", "n_shingles", F.col("keeper.doc_id").alias("component_id"), "keeper")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    out = component_rows(docs, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that represent their component: one row each, however often it repeats."""
    rows = materialize(component_rows(docs.select(named(doc_id), named(text)), doc_id, text), "near-rows")
    stays = F.col("keeper").isNull() | ((F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("mark") == F.col("keeper.mark")))
    mark = F.xxhash64(text_bytes(text))
    left = rows_marked(docs, rows.where(~stays).select("doc_id", "mark").distinct(), doc_id, mark, "left_anti")
    several = rows.where(stays & F.col("keeper").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return once_each(left, several, doc_id, mark)
