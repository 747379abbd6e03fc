"""Lexical search, piece encoding and token alignment against the libraries and plain loops."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import alignment, lexical_search, piece_bpe
from folioforge.llm.bytebpe import byte_alphabet, default_vocabulary

SCHEMA = "doc_id long, text string, term string, shard int, `a.b` string, score double"
WORDS = "the quick Brown fox jumps_over a lazy dog né Ünder straße 日本語 <|endoftext|> it's 42 x1 \x1c 　 ▁ <s> --".split(" ")


def texts():
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    odd = "ab '\n\t.,!1²é中\x85 　ʰ̈😀‍_-<|>\x00▁ﷺ日the  "
    same = say(30)
    return [
        None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", same, same, "x" * 5000, "=" * 3000 + "\n\n", " " * 300, say(4000), "▁▁ plain", "l'été <|endoftext|><s></s> <0x41>",
        *("".join(rnd.choice(odd) for _ in range(rnd.randint(1, 40))) for _ in range(150)), *(say(rnd.randint(1, 60)) for _ in range(60)),
    ]


@pytest.fixture(scope="module")
def rows():
    return [(i // 2 if i in (30, 31) else i * 3 if i != 40 else None, t, "clash", 1, "ab", 0.5) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_pieces())


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_piece_encoding_equals_the_library(docs, rows, pieces):
    want = []
    for i, t, *_ in rows:
        ids = pieces.encode(t or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256(pieces.decode(ids).encode()).hexdigest(), ids))
    coded = piece_bpe.encode_documents(docs, with_ids=True)
    assert ordered((*r[:4], list(r.ids)) for r in coded.collect()) == ordered(want)
    back = piece_bpe.decode_documents(coded)
    assert ordered(back.collect()) == ordered((i, pieces.decode(pieces.encode(t or ""))) for i, t, *_ in rows)
    assert piece_bpe.encode_documents(docs.limit(0)).collect() == []


def test_pieces_in_random_order_and_a_cut_cache(pieces):
    rnd = random.Random(2)
    shown = [pieces.id_to_piece(i).replace("▁", " ") for i in range(259, pieces.get_piece_size())]
    some = ["".join(rnd.choice(shown) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    encoder = piece_bpe.PieceEncoder(*(lambda v: (v, piece_bpe.PrefixTable(v)))(piece_bpe.PieceVocabulary(piece_bpe.default_pieces())), None, limit=5000)
    got = [x for k in range(0, 3000, 300) for x in encoder.encode(pa.array([t.encode() for t in some[k : k + 300]], pa.binary()))]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == pieces.encode(some)
    mixed = [[rnd.randrange(259) if rnd.random() < 0.5 else rnd.randrange(pieces.get_piece_size()) for _ in range(rnd.randint(0, 9))] for _ in range(3000)]
    decode = piece_bpe.PieceDecoder(encoder.vocab)
    flat = np.array([i for x in mixed for i in x], np.int64)
    assert decode(flat, np.cumsum([0, *map(len, mixed)])) == [pieces.decode(x).encode() for x in mixed]


def brute_links(rows, pieces):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(default_vocabulary())
    tok.encode_special_tokens = True
    back, shown = byte_alphabet(), {i: s for s, i in tok.get_vocab().items()}
    raw_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    per, held = [], Counter()
    for i, t, *_ in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        sides = [[bytes(back[c] for c in shown[x]) for x in a], [raw_b(x) for x in b]]
        if not t or any(b"".join(s) != (" " + t).encode() for s in sides):
            per.append((i, 0, 0, 0, Counter(), ""))
            continue
        ends = [list(accumulate(map(len, s))) for s in sides]
        links, said, start = Counter(), [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            one, two = ([x for x, e in zip(ids, side) if start < e <= end] for ids, side in zip((a, b), ends))
            said.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
            links.update((x, y) for x in one for y in two)
            start = end
        held.update(links.keys())
        per.append((i, len(a), len(b), len(said), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    return [(i, a, b, g, sum(k.values()), sum(u for p, u in k.items() if held[p] == top[p[0]]), sum(u * held[p] for p, u in k.items()), sha) for i, a, b, g, k, sha in per]


@pytest.mark.parametrize("head", [alignment.HEAD, 300, 0])
def test_links_equal_a_plain_loop(docs, rows, pieces, head):
    got = alignment.link_documents(docs, head=head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert ordered(got.collect()) == ordered(brute_links(rows, pieces))


def test_large_groups_and_a_cut_cache(spark, docs, rows, pieces, monkeypatch):
    monkeypatch.setattr(alignment, "PLAIN", 1)
    monkeypatch.setattr(alignment, "CACHED", 20)
    got = {}
    align = alignment.Aligner(default_vocabulary(), piece_bpe.default_pieces())
    for k in range(0, len(rows), 40):
        some = rows[k : k + 40]
        batch = align(pa.array([(t or "").encode() for _, t, *_ in some], pa.binary()))
        got.update({k + j: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for j, r in enumerate(batch.to_pylist())})
    want = {j: (r[1], r[2], r[3], r[4], r[7]) for j, r in enumerate(brute_links(rows, pieces))}
    assert got == want


def test_links_of_an_empty_table(docs):
    assert alignment.link_documents(docs.limit(0)).collect() == []


def test_groups_are_components():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randint(1, 30)
        ends = [sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n}) for _ in range(2)]
        one, two = (x.tolist() for x in alignment.groups_of(*map(np.array, ends)))
        shared = sorted(set(ends[0]) & set(ends[1]))
        assert one == [sum(e > s for s in shared) for e in ends[0]] and two == [sum(e > s for s in shared) for e in ends[1]]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, top=10):
    docs = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t, *_ in rows]
    docs = [d for d in docs if d[2]]
    total, df = sum(d[2] for d in docs), Counter(t for d in docs for t in d[1])
    out = []
    for item in sorted({i for i, _ in items}, key=repr):
        terms = {x for i, t in items if i == item for x in plain_terms(t)}
        hits = []
        for i, tf, n in docs:
            m = 100 - 90 + (90 * n * len(docs)) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms if x in tf)
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, h[3], -h[0]) for k, h in enumerate(sorted(hits)[:top])]
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000])
def test_search_equals_a_plain_loop(spark, docs, rows, shard_bytes):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 9)))) for i in range(40)] + [(50, None), (51, "..."), (52, "unseen zzz"), (3, "the the THE dog"), (None, "né x1")]
    table = spark.createDataFrame([(*x, 1.0, "y") for x in items], "item_id long, text string, doc_id double, term string")
    index = lexical_search.materialize(lexical_search.index_documents(docs, shard_bytes=shard_bytes), "index")
    for top in (10, 3):
        got = lexical_search.search(index, lexical_search.item_terms(table), top)
        assert ordered(got.collect()) == ordered(brute_search(rows, items, top))
    assert ordered(lexical_search.rank_documents(docs, table).collect()) == ordered(brute_search(rows, items))
    assert lexical_search.rank_documents(docs.limit(0), table).collect() == [] and lexical_search.rank_documents(docs, table.limit(0)).collect() == []


def test_search_in_several_passes(spark, docs, rows, monkeypatch):
    items = [(f"i{i}", f"the {w} dog {i}") for i, w in enumerate(WORDS)]
    monkeypatch.setattr(lexical_search, "PASS_ROWS", 20)
    monkeypatch.setattr(lexical_search, "PASS_BYTES", 0)  # nothing is broadcast
    got = lexical_search.rank_documents(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert ordered(got.collect()) == ordered(brute_search(rows, items))


def test_best_documents_drop_none():
    rnd = random.Random(8)
    from array import array

    for _ in range(400):
        lists, sums = [], Counter()
        for _ in range(rnd.randint(0, 8)):
            places = sorted(rnd.sample(range(60), rnd.randint(1, 50)))
            gains = [rnd.randint(0, rnd.choice((3, 40))) for _ in places]
            lists.append((array("q", places), array("q", gains), max(gains)))
            sums.update(dict(zip(places, gains)))
        want = sorted(((s, p) for p, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:5]
        assert sorted(lexical_search.best_documents(lists, 5), key=lambda x: (-x[0], x[1])) == want


def test_packed_integers():
    rnd = np.random.default_rng(1)
    values = np.concatenate([[0, 127, 128, 1 << 40], rnd.integers(0, 1 << rnd.integers(1, 50, 500))])
    assert lexical_search.unpack(lexical_search.pack(values)[0]).tolist() == values.tolist()
    assert lexical_search.unpack(b"").tolist() == []


def test_queries_as_registered_and_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from folioforge.llm.oracles import ORACLES
    from folioforge.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op4_hyperminhash", "op10_chunk_recipes", "op11_heap_merge_search"):
        df = QUERIES[name](spark, folder)
        want = con.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert ordered(df.select(*names).collect()) == ordered(want.fetchall())
    n = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for name, columns in {
        "op12_prefix_table_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13_token_links": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    }.items():
        df = QUERIES[name](spark, folder)
        assert set(columns) <= set(df.columns) and df.count() == n
