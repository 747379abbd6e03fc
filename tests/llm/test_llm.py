"""Corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures with hard cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import bytebpe, exact_dedup, lattice_lm, near_dedup, packing, pivot_dedup, quality, records, token_count, toxicity, trie_bpe
from folioforge.llm.common import connected_components, split_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, score double, predicted int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards Quietly mix 12 potions, né Ünder straße 日本語 <|endoftext|> it's".split()


def texts():
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    long = say(3000)
    base = say(60)
    near = base.split()
    near[3] = "changed"
    return [
        None, "", " ", "\n\t ", "a", "A a", base, base, base.upper(), " ".join(near), long, long + " tail", "x" * 20_000, "z" * 9_000 + "\n\n",
        "  two  spaces \n then\r\n\x1c odd\x85space wide ", "l'été <|endoftext|><|endoftext|> fin", "😀🏽‍🚀 emoji ﷽", *(say(rnd.randint(1, 90)) for _ in range(60)),
    ]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, ("en", "de", None)[i % 3], "s", len(t or ""), "clash", 0.5, 7) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bytebpe.default_vocabulary())


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_bpe_encode_decode_and_count(docs, rows, library):
    got, counts = by_id(trie_bpe.encode_documents(docs, with_ids=True)), by_id(token_count.count_tokens(docs))
    for i, t, *_ in rows:
        ids = ids_of(library, t)
        assert got[i].ids == ids.tolist() and got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 1024)
    back = {r.doc_id: r.text for r in trie_bpe.decode_documents(trie_bpe.encode_documents(docs, with_ids=True)).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)


def test_bpe_on_random_unicode(library):
    rnd = random.Random(3)
    alphabet = "ab '\n\t.,!1²½é中ñ\x1c\x85  　ǅʰ̈😀‍_-<|>\x00"
    some = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    path = bytebpe.default_vocabulary()
    want = [ids_of(library, t).tobytes() for t in some]
    raws = pa.array([t.encode() for t in some], pa.binary())
    for again in range(2):  # the second time mostly from the cache
        assert trie_bpe.trie_encoder(path).encode(raws) == want
        assert bytebpe.library_encoder(path).encode(raws) == want
        assert [len(x) for x in token_count.counter(path).encode(raws)] == [len(w) // 4 for w in want]
    small = bytebpe.library_encoder(path)
    small.limit = 2000  # the cache is cut back after every batch
    assert [x for k in range(0, 1500, 50) for x in small.encode(raws.slice(k, 50))] == want


def test_records(spark, docs, rows, library, tmp_path):
    folder = f"file://{tmp_path}/records"
    manifest = records.write_records(docs, folder)
    got, at = by_id(records.read_records(spark, folder, manifest)), 0
    for i, t, *_ in sorted(rows):
        ids = np.append(ids_of(library, t), 2).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = max(manifest.collect(), key=lambda r: r.records)
    picked = [records.read_record_at(folder, shard.name, k)[0] for k in reversed(range(shard.records))]
    assert picked == sorted(picked, reverse=True)
    with pytest.raises(ValueError):
        import io

        data = bytearray(records.frame(b"payload"))
        data[14] ^= 1
        records.read_frame(io.BytesIO(bytes(data)))


def naive_bfd(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(room, k) for k, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 100])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 400))]
    plan, bins = packing.pack_counts(Counter(lengths), capacity)
    room = [capacity] * bins
    spans = [[] for _ in range(bins)]
    for n, rows in plan.items():
        ends = [*rows[1:, 0], Counter(lengths)[n]]
        for (rank, first, offset), end in zip(rows.tolist(), ends):
            for b in range(first, first + end - rank):
                room[b] -= n
                spans[b].append((offset, n))
    assert sorted(room) == naive_bfd(lengths, capacity)
    for s in spans:
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n


def test_packing(docs, rows, library):
    got = packing.pack_documents(docs).collect()
    ids = {i: np.append(ids_of(library, t), 2).astype("<u4") for i, t, *_ in rows}
    for i, whole in ids.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(whole)
        assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in mine)
        assert all(r.length == 1024 for r in mine[1:])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup(spark, docs, rows):
    got = by_id(near_dedup.near_groups(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near([(r[0], r[1]) for r in rows])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_dedup_families_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    data = []
    for i in range(60):  # copies with 0 to 9 changed words: similarities on both sides of 0.75
        w = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 9)):
            w[k] = f"n{rnd.randint(0, 9)}"
        data.append((i, " ".join(w)))
    got = by_id(near_dedup.near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)))
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in brute_near(data).items()}


def test_signatures_count_all_bits():
    """The top bit of a word is one bit too: signatures that differ in few bits leave a pair possible."""
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63, (40, len(near_dedup.SIGNS)), dtype=np.int64)
    a[:, near_dedup.WORDS64 :] = -1  # all registers full
    b = a.copy()
    b[:, : near_dedup.WORDS64] ^= np.int64(-(2**63)) | rng.integers(0, 2, (40, near_dedup.WORDS64), dtype=np.int64)
    bits = lambda x: [sum(int(v).bit_count() for v in row.view(np.uint64)) for row in x]
    want = [[bits([(x ^ y)[: near_dedup.WORDS64]])[0] <= near_dedup._MOST_UNLIKE[near_dedup.SIGNATURE] for y in b] for x in a]
    got = near_dedup._signs_allow(a, b, None, None)
    assert got.diagonal().all() and got.tolist() == want


def test_members_are_flagged_once_a_block_pair():
    """However many batches a bucket passes in: rows grow with its members, not with their pairs."""
    n, names = 600, ["key", "i", "j", "side", "node", "comp", "n_shingles", *near_dedup.SIGNS]
    rows = [(7, 0, 0, side, k, k, 10, *[0] * near_dedup.WORDS64, *[-1] * near_dedup.WORDS64) for side in (0, 1) for k in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 100])], names) for k in range(0, len(rows), 100)]
    got = [tuple(r.values()) for b in near_dedup._flag_members(batches) for r in b.to_pylist()]
    assert sorted(got) == [(7, k) for k in range(n)]


def test_near_dedup_with_repeated_and_null_ids(spark):
    rnd = random.Random(4)
    a, b = ([f"{x}{rnd.random()}" for _ in range(60)] for x in "ab")
    long = lambda w: " ".join([*w, "more"])
    data = [(5, " ".join(a)), (5, " ".join(b)), (9, long(a)), (4, long(b)), (4, long(b)), (None, " ".join(a)), (None, " ".join(a)), (7, ""), (7, None)]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(data)], "doc_id long, text string, raw int, `a.b` string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == sorted([(5, 56, 5, True), (5, 56, 4, False), (9, 57, 5, False), (4, 57, 4, True), (4, 57, 4, True), (-1, 56, -1, True), (-1, 56, -1, True), (7, 0, 7, True), (7, 0, 7, True)])
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(5, " ".join(a)), (4, long(b)), (-1, " ".join(a)), (-1, " ".join(a)), (7, ""), (7, "")])
    exact = exact_dedup.drop_exact_copies(docs)
    assert sorted((r.doc_id or -1, r.text or "") for r in exact.collect()) == sorted([(5, " ".join(a)), (5, " ".join(b)), (9, long(a)), (4, long(b)), (-1, " ".join(a)), (-1, " ".join(a)), (7, "")])


def test_sets_with_one_node_get_their_own(spark):
    signs = ", ".join(f"{c} long" for c in near_dedup.SIGNS)
    rows = spark.createDataFrame([(i, i, 1, 8 if i < 4 else 9, bytes([i % 2 if i < 4 else 7]), b"s", *[0] * len(near_dedup.SIGNS)) for i in range(6)], f"doc_id long, mark long, n_shingles long, node long, print binary, sketch binary, {signs}")
    got = {r.doc_id: r.node for r in near_dedup.unclashed(rows, near_dedup.classes_of(rows)).collect()}
    assert got[0] == got[2] != got[1] == got[3] and got[4] == got[5] == 9 and 8 not in got.values()
    assert near_dedup.unclashed(rows.where("node = 9"), near_dedup.classes_of(rows.where("node = 9"))) is None


def test_buckets_pass_by_in_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, step = rng.integers(1, 60), rng.integers(1, 10)
        pairs = np.array(sorted(zip(rng.integers(0, 8, n).tolist(), rng.integers(0, 6, n).tolist())))
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[i : i + step].T], ["key", "node"]) for i in range(0, n, step)]
        got = sorted(tuple(r.values()) for b in near_dedup._shared_keys(batches) for r in b.to_pylist())
        sets = {k: set(pairs[pairs[:, 0] == k, 1].tolist()) for k in set(pairs[:, 0].tolist())}
        assert got == sorted((k, v, min(x)) for k, x in sets.items() if len(x) > 1 for v in x)


def test_votes_against_plain_loops():
    rng = np.random.default_rng(3)
    counts, labels = rng.poisson(0.2, (60, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 60)
    model = quality.LatentVotes(counts, labels, 0.4, dimensions=8, neighbours=5)
    test = rng.poisson(0.2, (9, quality.TERMS)).astype(np.float32)
    for x, got in zip(model.latent(test), model.scores(test)):
        near = sorted((-round(float(x @ v), 9), k) for k, v in enumerate(model.vectors))[:5]
        votes = [(max(-s, 1e-6) * (0.4 / labels.mean() if labels[k] else 0.6 / (1 - labels.mean())), labels[k]) for s, k in near]
        assert math.isclose(got, sum(w * y for w, y in votes) / sum(w for w, _ in votes), rel_tol=1e-6)


def test_nnpu_against_plain_loops():
    rnd = random.Random(5)
    make = lambda bad: np.array(sorted({rnd.randint(0, 30) + 100 * bad * (rnd.random() < 0.6) for _ in range(6)}), np.int32)
    p, u, prior = [make(1) for _ in range(30)], [make(rnd.random() < 0.3) for _ in range(80)], 0.3
    theta, bias = toxicity.train_nnpu(p, u, prior, epochs=3)
    chosen = set(toxicity.telling_features(p, u).tolist())
    w, b, m, v = Counter(), math.log(prior / (1 - prior)), Counter(), Counter()
    for step in (1, 2, 3):
        z = lambda r: b + sum(w[f] for f in r.tolist() if f in chosen)
        sig = lambda t: 1 / (1 + math.exp(-t))
        negative = sum(math.log1p(math.exp(z(r))) for r in u) / len(u) - prior * sum(math.log1p(math.exp(z(r))) for r in p) / len(p)
        per = [(r, prior * ((sig(z(r)) - 1) - sig(z(r))) / len(p) if negative >= 0 else prior * sig(z(r)) / len(p)) for r in p]
        per += [(r, (1 if negative >= 0 else -1) * sig(z(r)) / len(u)) for r in u]
        g = Counter({"bias": sum(x for _, x in per)})
        for r, x in per:
            for f in r.tolist():
                if f in chosen:
                    g[f] += x
        for f in chosen:
            g[f] += toxicity.DECAY * w[f]
        for f in [*chosen, "bias"]:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.999 * v[f] + 0.001 * g[f] ** 2
            move = toxicity.RATE * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
            if f == "bias":
                b -= move
            else:
                w[f] -= move
    assert chosen and math.isclose(bias, b, rel_tol=1e-6) and all(math.isclose(theta[f], w[f], rel_tol=1e-5, abs_tol=1e-9) for f in chosen)


def test_estimate_is_close():
    rnd = np.random.default_rng(5)
    for share in (0.5, 0.75, 0.9):
        n = 2000
        both = rnd.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)])) for _ in "ab")
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b), len(a), len(b)) - j) < 0.12


@pytest.mark.parametrize("hasher", [exact_dedup.chunk_hash, lambda c: F.length(c).cast("long") % 7])
def test_exact_dedup(docs, rows, hasher):
    got = by_id(exact_dedup.exact_groups(docs, hasher=hasher))
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(members), len(members), i == max(members), hashlib.sha256(t.encode()).hexdigest())


def test_chunks_cover_the_text(docs):
    pieces = exact_dedup.chunk_array(F.coalesce("text", F.lit("")))
    assert docs.where(F.array_join(pieces, "") != F.coalesce("text", F.lit(""))).count() == 0
    assert docs.select(F.max(F.array_max(F.transform(pieces, F.length)))).first()[0] <= exact_dedup.MAX_CHUNK


def test_lattice_equals_all_segmentations():
    pieces = {"▁": 256, "a": 257, "b": 258, "ab": 259, "▁a": 260, "▁ab": 261, "ba": 262}
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(263), 2).T)
    words = ["", "a", "abab", "aé", "bbbaab"]

    def total(text, k):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                out += math.exp(logp[pieces[text[:n]], k]) * total(text[n:], k)
            elif n == 1:
                out += math.exp(sum(logp[b, k] for b in text[0].encode())) * total(text[1:], k)
        return out

    got = lattice_lm.Lattice(words, pieces, 3).totals(logp)
    for w, row in zip(words, got):
        assert np.allclose(row, [math.log(total("▁" + w, k)) for k in (0, 1)])
        assert np.allclose(row, lattice_lm.long_total(w, pieces, 3, logp))


def test_language_model(docs, rows):
    held = split_remainder(10) == 0
    got = by_id(lattice_lm.score_documents(docs, held))
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    is_held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not is_held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    rare = by_id(lattice_lm.score_documents(docs, held, class_column=None))
    assert all(math.isfinite(r.score) for r in rare.values())
    # every score again, by segmenting each word in plain recursion
    pieces, _, logp = lattice_lm.piece_table(lattice_lm.default_pieces())
    memo: dict = {}

    def total(text):
        if text not in memo:
            memo[text] = 1.0 if not text else sum(
                math.exp(logp[pieces[text[:k]]] if text[:k] in pieces else sum(logp[b] for b in text[:k].encode())) * total(text[k:])
                for k in range(1, len(text) + 1) if k == 1 or text[:k] in pieces
            )
        return memo[text]

    lang = {r[0]: r[2] for r in rows}
    names = [c for c, _ in sorted(Counter(v for i, v in lang.items() if not is_held[i]).items(), key=lambda x: (-x[1], x[0] or ""))]
    groups = [[i for i, v in lang.items() if v == c and not is_held[i]] for c in names[:4]] + [[i for i, v in lang.items() if v in names[4:] and not is_held[i]]]
    words = [Counter(w for i in g for w in tokens[i] if w) for g in groups]
    grand, prior = sum(sum(x.values()) for x in words), lattice_lm.PRIOR
    every = sum(words, Counter())
    once, twice = (sum(v == k for v in every.values()) for k in (1, 2))
    cut = (once + 0.5) / (once + 2 * twice + 1)
    arc = lambda w, x, n: (x[w] + prior * every[w] / grand) / (n + prior)
    shares = [cut * sum(arc(w, x, sum(x.values())) / every[w] for w in every) for x in words]
    # what the word arcs keep and what the segmentations get is everything
    assert all(math.isclose(s + sum(arc(w, x, sum(x.values())) * (1 - cut / every[w]) for w in every), 1.0) for s, x in zip(shares, words))
    for i, ws in tokens.items():
        if any(w and len(w) > 200 for w in ws):
            continue  # too deep for the recursion; the exact sum of long words has a test of its own
        parts = []
        for g, x, share in zip(groups, words, shares):
            n = sum(x.values())
            end = (len(g) + 1) / (n + len(g) + 2)
            out = math.log10((len(g) + 0.5) / (sum(map(len, groups)) + 0.5 * len(groups))) + math.log10(end)
            for w in ws[:-1]:
                lattice = total("▁" + lattice_lm.decoded(w))
                out += math.log10(share * lattice + (arc(w, x, n) * (1 - cut / every[w]) if every[w] else 0)) + math.log10(1 - end)
            parts.append(out)
        want = max(parts) + math.log10(sum(10 ** (p - max(parts)) for p in parts))
        assert math.isclose(got[i].score, want, rel_tol=1e-6), i


def test_tail_words_score_like_head_words(docs, monkeypatch):
    held = split_remainder(10) == 0
    a = by_id(lattice_lm.score_documents(docs, held))
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", 3)
    b = by_id(lattice_lm.score_documents(docs, held))
    assert all(math.isclose(a[i].score, b[i].score, rel_tol=1e-9) and math.isclose(a[i].base_score, b[i].base_score, rel_tol=1e-9) and a[i].n_known == b[i].n_known for i in a)


def test_pivot_dedup(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = base[0] + 0.05 * rng.normal(size=(50, 16))
    x = np.concatenate([base, near, near[:5], base[3:6] * 2]).astype(np.float32)
    data = [(i, v.tolist(), i % 2 if i < 40 else 0) for i, v in enumerate(x)]
    data += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, x[0].tolist(), None), (205, [1.0, 2.0], 0), (206, [], 0)]
    got = by_id(pivot_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    labels = np.array([d[2] for d in data[: len(x)]])
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.9 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert len({got[i].component_id for i in range(40, 95)}) == 1
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 207))


def classified(spark, module, make, label):
    rnd = random.Random(1)
    data, marks = [], []
    for i in range(900):
        bad = rnd.random() < 0.25
        data.append((i, make(rnd, bad)))
        if i % 10:
            marks.append((i, int(bad), int(not bad)))
    docs = spark.createDataFrame([*data, (5000, None), (5001, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*marks, (99999, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    held = split_remainder(3) == 1
    model = module.fit(docs.where(~held), labels, label=label)
    got = by_id(module.score_documents(docs, model, ["doc_id"]))
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got.values())
    test = [(i, t) for i, t, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    return got, test


def test_toxicity(spark):
    def make(rnd, bad):
        return " ".join(rnd.choice(["plain", "words", "of", "text"] + ["nasty"] * bad) + rnd.choice("abcdefgh") for _ in range(40))

    got, test = classified(spark, toxicity, make, "toxic")
    assert sum(got[i].predicted == t for i, t in test) / len(test) > 0.97
    assert toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None


def repeated(spark, make, label):
    """Documents once, the same with repeated rows and one hot doc_id (the smallest), and labels of some."""
    rnd = random.Random(2)
    data = [(i, make(rnd, i % 3 == 1)) for i in range(90)]
    many = [r for r in data for _ in range(2)] + [data[0]] * 400
    labels = spark.createDataFrame([(i, int((i % 3 == 1) == (label == "toxic"))) for i in range(0, 90, 2)], f"doc_id long, {label} int")
    return *(spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (data, many)), labels


def test_toxicity_learns_alike_from_repeated_rows(spark, monkeypatch):
    def make(rnd, bad):
        return " ".join(rnd.choice(["plain", "words", "of", "text"] + ["nasty"] * bad) + rnd.choice("abcdefgh") for _ in range(40))

    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 20)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 90)
    once, many, labels = repeated(spark, make, "toxic")
    a, b = toxicity.fit(once, labels), toxicity.fit(many, labels)
    assert len(a.at) and a.word_weights() == b.word_weights() and a.bias == b.bias


def test_quality(spark):
    def make(rnd, bad):
        words = [rnd.choice(["Plain", "words", "of", "text,"]) + rnd.choice("abcdefgh") for _ in range(40)]
        return " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)

    got, test = classified(spark, quality, make, "quality")
    assert sum(got[i].predicted == 1 - t for i, t in test) / len(test) > 0.97


def test_shape_reads_whole_words():
    assert quality.shape("x1" * 40) != quality.shape("x1" * 40 + "Y?") and quality.shape("x" + "!?" * 40) != quality.shape("x" + "!?" * 40 + ".")
    assert quality.shape("x" * 100_000 + "1") == "a0" and quality.shape("X" + "!" * 100_000) == "A!!"


def test_quality_learns_alike_from_repeated_rows(spark, monkeypatch):
    def make(rnd, bad):
        words = [rnd.choice(["Plain", "words", "of", "text,"]) + rnd.choice("abcdefgh") for _ in range(40)]
        return " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)

    monkeypatch.setattr(quality, "MAX_PER_LABEL", 40)
    once, many, labels = repeated(spark, make, "quality")
    a, b = quality.fit(once, labels), quality.fit(many, labels)
    assert not a.single and not b.single and np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert near_dedup.near_groups(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0 and records.round_trip(empty).count() == 0
    assert trie_bpe.encode_documents(empty).count() == 0 and token_count.count_tokens(empty).count() == 0
    assert lattice_lm.score_documents(empty, split_remainder(10) == 0).count() == 0
    assert pivot_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        assert module.score_documents(empty, module.fit(empty, labels, label=label), ["doc_id"]).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 160)}}


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as P

    docs.withColumn("a.b", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(r[0], 1, int(k % 4 == 0)) for k, r in enumerate(rows)] + [(rows[0][0], 0, 0), (rows[1][0], 0, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    nothing = table.limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.join(table, "doc_id", "left_anti").count() == 0, name
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
    kept = {r.doc_id for r in P.drop_copies(spark, table, "").collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert kept == {max(m) for m in groups.values()}
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, table, "").collect()}
    assert kept == {i for i, (_, c) in brute_near([(r[0], r[1]) for r in rows]).items() if i == c}
    packed = P.run(spark, str(tmp_path))
    assert packed.count() > 0 and set(packed.columns) >= {"doc_id", "sequence_id", "offset"}


def test_pivot_dedup_repeated_ids(spark):
    v1, v2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v1), (2, v1), (1, v2), (3, v2), (7, [0.0, 0.0, 1.0]), (None, v1)]
    got = pivot_dedup.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False), (7, 0, 7, True), (None, 0, None, True)], key=repr)


def test_pivot_dedup_of_correlated_vectors(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=64) * 2
    x = base + rnd.normal(size=(1500, 64))
    x = np.concatenate([x, x[:300] + 0.35 * rnd.normal(size=(300, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    assert 0.7 < cosines.mean() < 0.9
    want = (np.triu(cosines >= 0.93, 1)).sum()
    mean, pivots = pivot_dedup.choose_pivots(spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>"))[64]
    assert len(pivots) > 100 and np.linalg.norm(mean) > 0.5  # pivots don't collapse
    got = pivot_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    links = got.agg(F.sum("n_links")).first()[0] / 2
    assert want > 200 and 0.9 * want <= links <= want


def test_one_vector_as_half_of_all_rows(spark):
    rows = [(i, [1.0, 2.0] if i % 2 else [float(i), -1.0], 1) for i in range(3000)]
    got = pivot_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    odd = got.where("vec_id % 2 = 1").agg(F.min("n_links"), F.max("n_links"), F.min("component_id"), F.max("component_id")).first()
    assert tuple(odd) == (1499, 1499, 1, 1)


@pytest.mark.parametrize("cut", ["record", "index of the manifest"])
def test_lost_records_are_an_error(spark, docs, tmp_path, cut):
    folder = f"file://{tmp_path}/records"
    manifest = records.write_records(docs, folder)
    shard = max(manifest.collect(), key=lambda r: r.records)
    path = tmp_path / "records" / f"{shard.name}.rec"
    if cut == "record":  # the shard ends at the border before its last record
        index = np.frombuffer((tmp_path / "records" / f"{shard.name}.idx").read_bytes(), "<u8")
        path.write_bytes(path.read_bytes()[: int(index[-2])])
    else:
        manifest = manifest.withColumn("tokens", F.col("tokens") + 1)
    with pytest.raises(Exception, match="holds"):
        records.read_records(spark, folder, manifest).collect()


def test_all_unlabelled_texts_equal_the_local_fit(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(12)) + (" vile filth" if i % 6 == 0 else "")) for i in range(240)] + [(None, "vile"), (3, "again w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 240, 2)], "doc_id long, toxic int")
    some, every = (toxicity.fit(docs, labels, max_unlabelled=n, epochs=4) for n in (1000, None))
    assert len(some.at) > 0 and some.at.tolist() == every.at.tolist()
    np.testing.assert_allclose(some.values, every.values, rtol=1e-9)
    assert abs(some.bias - every.bias) < 1e-9
