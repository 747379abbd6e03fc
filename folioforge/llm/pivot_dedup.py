"""Embedding near-dedup with a pivot-permutation index.

Pivots are reference points spread by farthest-first choice over a bounded
sample of the vectors, so that a dense cluster takes few of them.  Every
vector is described by its PREFIX nearest pivots in order, and enters one
inverted list for each pair of them, so two vectors meet exactly when they share
at least two pivots of their prefixes: the shared-pivot count is the list key.
Within a list, pairs are verified by their cosine in double precision.  A pair
that shares several pivot pairs counts in the first of its common lists only, so
link counts add up without any pair ever being written: a list gives one partial
count per vector and a spanning forest of its links.

Pivots are chosen, and vectors described, after the sample's mean is taken off, so
that vectors that all point much the same way still have different pivots; cosines
are those of the vectors as they are.

Vectors with equal components and label are one class beforehand.  Long lists
are split into blocks and each block pair is one group, so no list, however hot,
meets in one task.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of different
length never link; rows with equal vec_id are separate rows of one id, each linked
by its own vector; of equally near pivots the one chosen first comes first; a null
vec_id keeps a null component; an empty table gives an empty table; extra
columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, join_by_key, materialize

THRESHOLD = 0.93
#: The index is fitted on SAMPLE vectors at most; PIVOTS of them (what is broadcast) are kept; descriptions have PREFIX pivots.
SAMPLE, PIVOTS, PREFIX = 4096, 512, 6
#: No pivot is as similar as this to another: pivots inside one dense cluster would order its members at random.
APART = 0.7
BLOCK, SMALL = 512, 48
PAIRS = list(combinations(range(PREFIX), 2))


def usable(vector: str, label: str):
    """Column: whether a vector can link at all."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: list) -> np.ndarray:
    """Rows scaled to length one, safe for very small and very large components."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of x, each the least similar to those before it and no closer than APART."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        i = int(near.argmin())
        if near[i] > APART:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return x[chosen]


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit rows without their mean, of length one again (a row that is the mean stays zero)."""
    x = x - mean
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 1e-9, size, 1)


def choose_pivots(classes: DataFrame, most: int = PIVOTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and pivots per dimension, from the SAMPLE vectors whose hash is least (bounded, repeatable)."""
    rows = classes.select("vector").orderBy(F.xxhash64("vector", F.lit(1)), "vector").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    units = {n: unit_rows(v) for n, v in by_size.items()}
    return {n: (x.mean(axis=0), farthest_first(centred(x, x.mean(axis=0)), most)) for n, x in units.items()}


def describe(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """(n, prefix) ids of the nearest pivots in order, of equally near ones the first; all pivots where there are fewer (-1 fills up)."""
    near = x @ pivots.T
    k = min(prefix, len(pivots))
    if k < len(pivots):  # everything as near as the k-th nearest, so that the sort decides ties
        least = np.partition(near, len(pivots) - k, axis=1)[:, len(pivots) - k, None]
        near = np.where(near >= least, near, -np.inf)
    out = np.full((len(x), prefix), -1)
    out[:, :k] = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return out


def pair_keys(described: np.ndarray) -> np.ndarray:
    """(n, pairs) list keys; a vector with under two pivots gets one list for all such vectors."""
    described = described.astype(np.int64)
    one, two = described[:, [a for a, _ in PAIRS]], described[:, [b for _, b in PAIRS]]
    low, high = np.minimum(one, two), np.maximum(one, two)
    return (low + 1) * 65536 + high + 1


def _post(pivots_of):
    """(label, dim, key, node, near): one row per inverted list that a vector is in."""

    def run(batches):
        pivots = pivots_of.value
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                mean, points = pivots.get(int(n), (np.zeros(int(n)), np.zeros((1, int(n)))))
                near = describe(centred(unit_rows([vectors[i] for i in at]), mean), points)
                keys = pair_keys(near)
                row, column = np.nonzero(np.sort(keys, 1) != np.pad(np.sort(keys, 1)[:, :-1], ((0, 0), (1, 0)), constant_values=-1))
                take = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [take.column("label"), pa.array(np.full(len(row), n, np.int32)), pa.array(np.sort(keys, 1)[row, column]), take.column("node"), pa.array(near[row].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    ["label", "dim", "key", "node", "near"],
                )

    return run


def candidate_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs a < b inside each small group, for all groups at once."""
    area = sizes * sizes
    group = np.repeat(np.arange(len(sizes)), area)
    place = np.arange(len(group)) - np.repeat(np.cumsum(area) - area, area)
    a, b = starts[group] + place // sizes[group], starts[group] + place % sizes[group]
    return a[a < b], b[a < b]


def links_of(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified index pairs a < b of rows in the same group."""
    sizes, out_a, out_b = ends - starts, [], []
    small = np.flatnonzero(sizes <= SMALL)
    for some in np.array_split(small, max(1, int((sizes[small] ** 2).sum()) // 300_000 + 1)):
        a, b = candidate_pairs(starts[some], sizes[some])
        good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        out_a.append(a[good])
        out_b.append(b[good])
    for g in np.flatnonzero(sizes > SMALL):
        rows = x[starts[g] : ends[g]]
        a, b = np.nonzero(np.triu(rows @ rows.T >= threshold, 1))
        out_a.append(a + starts[g])
        out_b.append(b + starts[g])
    return np.concatenate(out_a), np.concatenate(out_b)


def first_common(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """Least list key that the two descriptions share, row by row."""
    ka, kb, out = pair_keys(near_a), pair_keys(near_b), []
    for at in range(0, len(ka), 50_000):
        x, y = ka[at : at + 50_000], kb[at : at + 50_000]
        out.append(np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _verify(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Whole groups (sorted) of one dimension: partial link counts per vector, and a forest of the links."""
    get = lambda name: table.column(name).combine_chunks()
    number = lambda name: get(name).to_numpy(zero_copy_only=False)
    x = unit_rows(get("vector").flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1))
    key, i, j, side, node, copies = (number(c) for c in ("key", "i", "j", "side", "node", "copies"))
    near = get("near").flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    label = get("label").dictionary_encode().indices.to_numpy()
    change = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(label) != 0)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
    a, b = links_of(x, starts, ends, threshold)
    keep = (i[a] == j[a]) | (side[a] != side[b])  # between two blocks only left with right
    a, b = a[keep], b[keep]
    keep = first_common(near[a], near[b]) == key[a]
    a, b = a[keep], b[keep]
    ids, place = np.unique(node, return_inverse=True)
    counts = np.bincount(place[a], copies[b], len(ids)) + np.bincount(place[b], copies[a], len(ids))
    forest = Forest(len(ids))
    spans = [k for k, (p, q) in enumerate(zip(place[a].tolist(), place[b].tolist())) if forest.join(p, q)]
    some = np.flatnonzero(counts)
    other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b][spans], pa.int64())])
    n = np.concatenate([counts[some].astype(np.int64), np.zeros(len(spans), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], node[a][spans]]), pa.int64()), other, pa.array(n)], ["node", "other", "n"])


def _block_links(threshold: float, rows_at_once: int = 20_000):
    """Sorted block-pair groups in, links out; only whole groups are verified, a bounded number of rows at a time."""

    def run(batches):
        held: list = []
        n = 0

        def ready(table: pa.Table, last: bool):
            names = ["label", "dim", "key", "i", "j"]
            end = table.slice(table.num_rows - 1, 1).select(names).to_pylist()[0]
            cut = table.num_rows
            if not last:  # the last group may go on
                same = np.full(table.num_rows, True)
                for c in names:
                    same &= np.array(pa.compute.equal(table.column(c), end[c]).to_numpy())
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            done, rest = table.slice(0, cut), table.slice(cut)
            dims = done.column("dim").to_numpy() if cut else np.empty(0)
            out = [_verify(done.filter(pa.array(dims == d)), threshold) for d in np.unique(dims)]
            return out, rest

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows_at_once:
                out, rest = ready(pa.Table.from_batches(held), False)
                yield from out
                held, n = rest.combine_chunks().to_batches(), rest.num_rows
        if n:
            yield from ready(pa.Table.from_batches(held), True)[0]

    return run


def link_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, other, n): rows with other null are partial link counts, the rest are links that span the components.

    ``classes``: node, label, vector, copies; different nodes have different (label, vector).
    """
    spark = classes.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(classes))
    posted = classes.select("node", "label", "vector").mapInArrow(_post(pivots), "label string, dim int, key long, node long, near array<int>")
    posted = materialize(posted, "pivot-lists")
    # vectors travel only into lists of two or more
    sizes = posted.groupBy("label", "dim", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = posted.join(sizes, ["label", "dim", "key"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    lists = lists.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lists = lists.join(classes.select("node", "vector", "copies"), "node")
    cols = ["label", "dim", "key", "i", "j", "side", "node", "vector", "copies", "near"]
    left = lists.withColumn("j", F.explode(F.sequence("mine", F.col("blocks") - 1))).withColumn("i", F.col("mine")).withColumn("side", F.lit(0))
    right = lists.where("mine > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mine") - 1))).withColumn("j", F.col("mine")).withColumn("side", F.lit(1))
    group = ["label", "dim", "key", "i", "j"]
    blocks = left.select(cols).union(right.select(cols)).repartition(*group).sortWithinPartitions(*group, "node")
    return blocks.mapInArrow(_block_links(threshold), "node long, other long, n long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    base = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")
    ).withColumn("ok", usable("vector", "label") & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are one component
    base = base.withColumn("vector", F.when(F.col("ok"), F.transform("vector", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))
    base = materialize(base.withColumn("class", F.when(F.col("ok"), F.struct("label", "vector"))), "vectors")
    # a class has a number of its own: different classes may share ids
    classes = base.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    links = materialize(link_classes(classes, threshold), "vector-links")
    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    comps = connected_components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    named = classes.join(comps, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "vector-members")
    firsts = named.groupBy("component").agg(F.min("first").alias("smallest"), F.count(F.lit(1)).alias("members"))
    known = join_by_key(named, firsts, "component", "members", named.count()).select(
        F.struct("label", "vector").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "smallest", "copies"
    )
    out = join_by_key(base.select("vec_id", "class"), known, "class", "copies", base.count())
    component = F.coalesce("smallest", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
