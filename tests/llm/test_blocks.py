"""Block pairs of near-dedup, and batches of packing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.llm import common, near_dedup, packing


def _grouped(spark):
    rows = [(1, n, n // 3) for n in range(9)] + [(2, n, n % 4 if n < 30 else 9) for n in range(20, 60)] + [(3, n, 5) for n in range(4)] + [(4, n, n) for n in range(100, 105)]
    return rows, spark.createDataFrame(rows, "key long, node long, comp long")


def _met(rows):
    """Pairs of different components that meet in a block pair."""
    by = {}
    for r in rows:
        by.setdefault((r.key, r.i, r.j), ([], []))[r.side].append((r.node, r.comp))
    return {(key, min(a, b), max(a, b)) for (key, _, j), (left, right) in by.items() for a, ca in left for b, cb in right + (left if j == -1 else []) if ca != cb}


def test_rows_of_a_single_block_pair_come_once(spark):
    rows, df = _grouped(spark)
    pairs = {(k, a, b) for k, a, ca in rows for m, b, cb in rows if k == m and a < b and ca != cb}
    both, once = near_dedup.dealt(df, "key", 10).collect(), near_dedup.dealt(df, "key", 10, once=True).collect()
    assert _met(both) == _met(once) == pairs
    alone = [r for r in once if r.key in (1, 4)]
    assert len(alone) == 14 and {r.j for r in alone} == {-1}
    assert len([r for r in both if r.key in (1, 4)]) == 6 + 9 + 4 + 5


def test_single_blocks_are_compared_within_themselves_across_batches():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 40):
        comp = rng.integers(0, 6, 40)
        order = np.argsort(comp == 0, kind="stable")  # component 0 is side 1
        node, comp = np.arange(40)[order], comp[order]
        n = rng.integers(6, 12, 40)
        names = ["key", "i", "j", "side", "node", "comp", "n_shingles"]
        columns = [np.full(40, 7), np.zeros(40, int), np.full(40, -1), (comp == 0).astype(int), node, comp, n]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        batches = [whole.slice(k, size) for k in range(0, 40, size)]
        every = lambda a, b, na, nb: np.ones((len(na), len(nb)), bool)
        for at_once in (3, 100_000):
            got = [tuple(sorted(p)) for found in near_dedup._block_pairs(batches, at_once, every, lambda b: b.column(4).to_numpy()) for _, a, b in found for p in zip(a.tolist(), b.tolist())]
            able = [tuple(sorted((int(node[x]), int(node[y])))) for x in range(40) for y in range(x) if comp[x] != comp[y] and min(n[x], n[y]) * 100 >= near_dedup.LEAST_PERCENT * max(n[x], n[y])]
            assert sorted(got) == sorted(able)


def test_packing_is_the_same_whatever_the_batches(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit(" word"), F.col("id").cast("string")), (F.col("id") % 7).cast("int")).alias("text"))
    pieces = [sorted(r[:5] for r in packing.pack_documents(docs, batch_bytes=b).collect()) for b in (1 << 10, 8 << 20)]
    assert pieces[0] == pieces[1] and len(pieces[0]) == 300


def _pair(rng, n, both):
    """Two sets of ``n`` shingles that have ``both`` in common."""
    x = np.unique(rng.integers(0, 2**63, 2 * n, np.uint64))
    return np.sort(x[:n]), np.sort(x[n - both : 2 * n - both])


def _shared_bands(pairs):
    sets = [s for pair in pairs for s in pair]
    row, keys = near_dedup.band_keys(near_dedup.registers_of(sets), np.array([len(s) for s in sets]))
    return [len(set(keys[row == k].tolist()) & set(keys[row == k + 1].tolist())) for k in range(0, len(sets), 2)]


def test_bands_of_near_copies_meet_and_those_of_other_texts_do_not():
    rng = np.random.default_rng(5)
    for n in (4, 7, 40, 48, 49, 56, 64, 65, 90, 300):  # both / (2 * n - both) >= 0.75
        assert min(_shared_bands([_pair(rng, n, -(-6 * n // 7)) for _ in range(60)])) > 0
    uneven = [(a[: len(a) * 5 // 6], a) for a, _ in (_pair(rng, n, 0) for n in range(45, 90))]
    assert min(_shared_bands(uneven)) > 0
    for n in (120, 300):  # a third of both sets: 60 * (1/5)**5 bands
        assert sum(_shared_bands([_pair(rng, n, n // 3) for _ in range(100)])) < 20


def test_registers_lend_only_what_the_set_has():
    sketches = near_dedup.registers_of([np.arange(1, 50, dtype=np.uint64), np.empty(0, np.uint64)])
    dense = near_dedup.densified(sketches)
    assert dense[0].all() and set(dense[0].tolist()) == set(sketches[0].tolist()) - {0} and not dense[1].any()
    assert (dense[0] == sketches[0])[sketches[0] != 0].all()


def test_few_edges_are_joined_by_one_task_and_many_in_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(common, "materialize", lambda df, name, write=common.materialize: tables.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    want = {**{i: 1 for i in range(1, 61)}, **{k: 100 for k in range(100, 160)}}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {r.node: r.component for r in common.connected_components(df).collect()} == want
    assert len(tables) == 2
    monkeypatch.setattr(common, "EDGES_A_TASK", 30)
    assert {r.node: r.component for r in common.connected_components(df).collect()} == want
    assert len(tables) > 4
