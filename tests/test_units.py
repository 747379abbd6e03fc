"""Units, projections, alignment and ownership against plain loops and difflib."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.operators import align, units
from folioforge.operators import nodes as N
from folioforge.sources import docx
from folioforge.sources.scratch import written
from tests.test_docx import BODY, MORE, NS

BY = ["doc_id", "part", "paragraph_id"]
ZWJ = "‍"


def plain_clusters(text):
    out, flags = [], 0
    for c in text:
        flag = "\U0001f1e6" <= c <= "\U0001f1ff"
        glue = out and (c == "\n" and out[-1][-1] == "\r" or unicodedata.category(c) in ("Mn", "Me", "Mc") or c == ZWJ or out[-1].endswith(ZWJ) or flag and flags % 2 == 1)
        flags = flags + 1 if flag else 0
        if glue:
            out[-1] += c
        else:
            out.append(c)
    return out


def test_clusters(spark):
    rnd = random.Random(3)
    some = ["", "éa\r\nb", "\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7\U0001f1e9", "\U0001f44d\U0001f3fd\U0001f468‍\U0001f469", ZWJ * 3 + "x", "a" + "́" * 9000]
    some += ["".join(rnd.choice("ab\r\ń̈ः‍\U0001f1e9\U0001f1ea😀 ") for _ in range(rnd.randint(1, 14))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in some], "t string").select("t", units.clusters(F.col("t")).alias("c")).collect()
    assert all(r.c == plain_clusters(r.t) for r in got)


def test_opcodes_equal_difflib():
    rnd = random.Random(1)
    for _ in range(1500):
        n, letters = rnd.choice((4, 20, 60)), rnd.choice(("ab", "abcd", "abcdefghij kl"))
        a = [rnd.choice(letters) for _ in range(rnd.randint(0, n))]
        b = [c for c in a if rnd.random() < 0.9] if rnd.random() < 0.5 else [rnd.choice(letters) for _ in range(rnd.randint(0, n))]
        assert align.opcodes([ord(c) for c in a], [ord(c) for c in b]) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_long_pairs_go_row_by_row(monkeypatch):
    """Without bit sets (memory that grows with the product of the lengths) the opcodes are the same."""
    rnd = random.Random(2)
    monkeypatch.setattr(align, "MOST_BITS", 0)
    monkeypatch.setattr(align, "longest_block", None)
    for _ in range(300):
        a, b = ([rnd.choice(letters) for _ in range(rnd.randint(1, 40))] for letters in ("abc", "abcd"))
        assert align.opcodes([ord(c) for c in a], [ord(c) for c in b]) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_pairs_reach_python_in_bounded_batches(spark):
    """A batch of pairs is bounded by bytes, not by 10,000 rows of any length."""
    pairs = spark.range(400).selectExpr("id", "repeat('ab ', 700) AS before", "repeat('ab', 700) AS after").coalesce(1)
    sides = pairs.select("id", units.clusters(F.col("before")).alias("a"), units.clusters(F.col("after")).alias("b"))
    assert align.with_opcodes(sides.limit(1), ["id"]).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= align.BATCH_BYTES
    rows = sides.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), sides.schema)
    assert rows.count() > 1


def test_bodies_are_read_once(spark):
    """What reads a body is a table, not a plan that every use repeats in the driver and the executors."""
    bodies = spark.createDataFrame([("a", 'x⟦token id="N1" kind="tab"⟧y'), ("b", "⟦")], "doc_id string, body string")
    read, bad = units.read_bodies(bodies, ["doc_id"])
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (read, bad)]
    assert plans[0].count("Window ") == 1 and plans[1].count("Window ") == 0
    assert [r.value for r in read.orderBy("pos").collect()] == ["x", '⟦token id="N1" kind="tab"⟧', "y"] and bad.count() == 1


def test_text_hunks(spark):
    pairs = [("a", "", "x"), ("b", "abc", ""), ("c", "one two three", "one 2 three four"), ("d", "éx\r\n😀", "ex\r\n"), ("e", "same", "same"), ("f", None, "x"), ("g", "x", None)]
    df = spark.createDataFrame(pairs, "id string, before string, after string")
    hunks = align.text_hunks(df)
    want = []
    for i, a, b in pairs:
        if a is not None and b is not None:
            x, y = plain_clusters(a), plain_clusters(b)
            ops = [o for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
            at = lambda side, k: len("".join(side[:k]))
            want += [(i, k, o, at(x, i1), at(x, i2), at(y, j1), at(y, j2), "".join(x[i1:i2]), "".join(y[j1:j2])) for k, (o, i1, i2, j1, j2) in enumerate(ops)]
    got = hunks.select("id", "hunk", "operation", "i1", "i2", "j1", "j2", "removed", "inserted")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.id: r.text for r in align.spliced(df, hunks).collect()} == {i: b for i, a, b in pairs if a is not None and b is not None}
    assert sorted((r.id, r.kind, r.text) for r in align.tracked(hunks.where("id = 'd'"), ["id"]).collect()) == [("d", "delete", "é"), ("d", "delete", "😀"), ("d", "insert", "e")]


@pytest.fixture(scope="module")
def nodes(spark):
    xml = f"<w:document {NS}><w:body>{BODY}{MORE}</w:body></w:document>"
    parts = spark.createDataFrame([("d", docx.MAIN, xml)], "doc_id string, part string, xml string")
    nested = written(N.nest(N.tokens(parts, N.KEYS, "xml"), N.KEYS), "tokens")
    return written(N.word_nodes(nested, written(N.word_paragraphs(nested), "paragraphs")), "nodes")


@pytest.fixture(scope="module")
def base(nodes):
    return written(units.units(nodes, BY), "units")


def merged(rows):
    """Nodes in order, adjacent text of one style in one wrapper merged."""
    out = []
    for r in sorted(rows, key=lambda r: r.path):
        inner = r.path[:-1]
        if r.cls == "text" and out and out[-1][0] == "text" and out[-1][3:] == (r.style, inner):
            out[-1] = ("text", "text", out[-1][2] + r.text, r.style, inner)
        elif r.cls != "text" or r.text:
            out.append((r.cls, r.kind, r.text, r.style, inner))
    return out


def test_nodes_to_units_to_nodes(nodes, base):
    back = units.rebuilt(base, nodes, BY).orderBy("paragraph_id", "order").collect()
    by_paragraph = {}
    for r in nodes.collect():
        by_paragraph.setdefault(r.paragraph_id, []).append(r)
    assert len(by_paragraph) > 10
    for i, rows in by_paragraph.items():
        assert [(r.cls, r.kind, r.text, r.style, r.wrappers) for r in back if r.paragraph_id == i] == merged(rows)


def test_projection_reads_back(base):
    bodies = written(units.edit_bodies(base, BY), "bodies")
    read, bad = units.read_bodies(bodies, BY)
    assert bad.count() == 0
    columns = [*BY, "pos", "value", "is_token", "wrappers", "in_revision", "role"]
    assert sorted(map(repr, read.select(columns).collect())) == sorted(map(repr, base.select(columns).collect()))
    body = {r.paragraph_id: r.body for r in bodies.collect()}["P1"]
    assert body.startswith('Keep ⟦insert id="N') and "⟦revision-gap" in body and body.endswith("text & more")


BAD = {
    "stray ⟦": "unescaped", "back \\slash": "unescaped", "⟧": "unescaped", '⟦what id="N1"⟧': "unknown-placeholder", '⟦token id="N1"⟧': "incomplete-placeholder", '⟦token id="" kind="tab"⟧': "incomplete-placeholder",
    '⟦range-end id="N1"⟧': "mismatched-placeholder", '⟦range-start id="N1" kind="hyperlink"⟧x': "unclosed-placeholder", '⟦revision-gap id="N1" kind="insert"⟧': "wrong-kind", '⟦range-end id="N1" x="y"⟧': "unknown-attribute",
    '⟦insert id="N1" kind="insert"⟧a⟦range-start id="N2" kind="hyperlink"⟧⟦/insert id="N1"⟧⟦range-end id="N2"⟧': "mismatched-placeholder", '⟦token id="N1" kind="tab" oops⟧': "unknown-attribute",
}


def test_grammar_violations(spark):
    good = {"escaped \\u27E6 \\U27e7 \\\\": "escaped ⟦ ⟧ \\", '⟦token id="N1" kind="tab" x="&#x27E6;"⟧': None, "": None}
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*BAD, *good])], "id int, body string")
    read, bad = units.read_bodies(df, ["id"])
    got = {}
    for r in bad.collect():
        assert r.code == "edit-grammar-invalid"
        got.setdefault(r.id, set()).add(r.detail)
    assert set(got) == set(range(len(BAD))) and all(d in got[i] for i, d in enumerate(BAD.values()))
    text = "".join(r.value for r in read.where(f"id = {len(BAD)}").orderBy("pos").collect())
    assert text == good["escaped \\u27E6 \\U27e7 \\\\"] and {r.id for r in read.collect()} == {len(BAD), len(BAD) + 1}


# (mode, opaque, baseline, draft, code, assigned style, reason): letters are text of style a or b,
# A and B of another case of the same styles; [ ] an insertion, | a token, < > a range
CASES = [
    ("direct", False, "aab", "aaXb", None, "a", "left-context"), ("direct", False, "aab", "Xaab", None, "a", "paragraph-start-right-context"), ("direct", False, "", "X", None, "s", "insertion-style-fallback"),
    ("direct", False, "xaay", "xXy", None, "a", "single-region-inheritance"), ("direct", False, "xaay", "xy", None, None, "deletion-preserves-survivors"),
    ("direct", False, "xaby", "xXYy", "mixed-replacement-requires-unchanged-text", None, None), ("direct", False, "ab", "XY", "unanchored-mixed-rewrite", None, None),
    ("direct", True, "aa", "ab", "opaque-paragraph-mutated", None, None), ("direct", False, "a|a", "aa", "protected-token-mutated", None, None), ("ambiguous", False, "aa", "aX", "edit-mode-ambiguous", None, None),
    ("direct", False, "a[a]b", "a[X]b", "revision-text-mutated-in-direct-mode", None, None), ("track", False, "a[a]b", "a[X]b", None, "a", "tracked-revision-mapping"),
    ("direct", False, "|", "|X", "protected-context-ambiguous", None, None), ("direct", False, "xy", "xXy", "ambiguous-alignment", None, None), ("direct", False, "|b", "|Xb", None, "b", "right-context-fallback"),
    ("direct", False, "a<a>b", "XX", "protected-token-mutated", None, None), ("track", False, "xaby", "xXYy", "mixed-replacement-requires-unchanged-text", None, None),
]


def unit_rows(k, said, styled):
    out, depth = [], []
    for c in said:
        role = {"[": "start", "<": "start", "]": "end", ">": "end", "|": "token"}.get(c, "text")
        if role == "end":
            depth.pop()
        style = c if c in "ab" else {"x": "a", "y": "b"}.get(c)
        value = "a" if styled and c in "xy" and said == "xy" else c  # equal text of different styles
        out.append((k, len(out), value, role != "text", style if styled and role == "text" else None, [d for d, _ in depth], any(b == "[" for _, b in depth), len(out), role))
        if role == "start":
            depth.append((len(out), c))
    return out


def test_codes_and_styles(spark):
    schema = "id int, pos int, value string, is_token boolean, style string, wrappers array<int>, in_revision boolean, node int, role string"
    base_rows = [r for k, c in enumerate(CASES) for r in unit_rows(k, c[2], True)]
    draft_rows = [r for k, c in enumerate(CASES) for r in unit_rows(k, c[3], False)]
    twin = {k for k, c in enumerate(CASES) if c[2] == "xy"}
    draft_rows = [(*r[:2], "a" if r[0] in twin and r[2] in "xy" else r[2], *r[3:]) for r in draft_rows]
    base, drafts = (written(spark.createDataFrame(r, schema), "rows") for r in (base_rows, draft_rows))
    paragraphs = spark.createDataFrame([(k, c[0], c[1], "s") for k, c in enumerate(CASES)], "id int, mode string, has_opaque boolean, insertion_style string")
    hunks, new = align.plan_hunks(base, drafts, paragraphs, ["id"])
    hunks = written(hunks, "hunks")
    got = {}
    for r in hunks.orderBy("id", "hunk").collect():
        got.setdefault(r.id, []).append(r)
    for k, (mode, opaque, a, b, code, style, reason) in enumerate(CASES):
        rows = got[k]
        first = next((r for r in rows if r.code), rows[0])
        assert (first.code, first.assigned_style, first.reason) == (code, style, reason), CASES[k]
    assert {r.id: r.code for r in align.rejected(hunks, ["id"]).collect()} == {k: c[4] for k, c in enumerate(CASES) if c[4]}
    after = {}
    for r in align.synced_units(base, new, hunks, ["id"]).orderBy("id", "pos").collect():
        after.setdefault(r.id, []).append((r.value, r.style))
    assert after[0] == [("a", "a"), ("a", "a"), ("X", "a"), ("b", "b")] and after[5] == [("x", "a"), ("a", "a"), ("b", "b"), ("y", "b")]


def test_boundary_crossing(spark):
    schema = "id int, pos int, value string, is_token boolean, style string, wrappers array<int>, in_revision boolean, node int, role string"
    base = spark.createDataFrame([(1, 0, "k", False, "a", [], False, 0, "text"), (1, 1, "b", False, "a", [9], False, 1, "text"), (1, 2, "c", False, "a", [], False, 2, "text"), (1, 3, "d", False, "a", [], False, 3, "text")], schema)
    draft = spark.createDataFrame([(1, 0, "k", False, None, [], False, 0, "text"), (1, 1, "X", False, None, [], False, 1, "text"), (1, 2, "d", False, None, [], False, 2, "text")], schema)
    paragraphs = spark.createDataFrame([(1, "direct", False, "s")], "id int, mode string, has_opaque boolean, insertion_style string")
    assert [r.code for r in align.plan_hunks(base, draft, paragraphs, ["id"])[0].collect()] == ["protected-boundary-crossing"]


def test_plans_hold_no_units_in_a_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(align, "written", lambda df, name: seen.append(df) or written(df, name))
    schema = "id int, pos int, value string, is_token boolean, style string, wrappers array<int>, in_revision boolean, node int, role string"
    base, drafts = (written(spark.createDataFrame(unit_rows(1, said, styled), schema), "rows") for said, styled in (("aab", True), ("aXb", False)))
    paragraphs = written(spark.createDataFrame([(1, "direct", False, "s")], "id int, mode string, has_opaque boolean, insertion_style string"), "paragraphs")
    hunks, new = align.plan_hunks(base, drafts, paragraphs, ["id"])
    assert seen and not any("Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in (*seen, hunks, new))
    assert [(r.removed, r.inserted, r.assigned_style) for r in hunks.collect()] == [("a", "X", "a")]


def test_places_and_styles_around_tokens(spark):
    schema = "id int, pos int, value string, is_token boolean, style string, wrappers array<int>, in_revision boolean, node int, role string"
    text = lambda k, pos, value, style: (k, pos, value, False, style, [], False, pos, "text")
    token = lambda k, pos: (k, pos, "⟦token⟧", True, None, [], False, pos, "token")
    base = [text(1, 0, "e\u0301", "a"), token(1, 1), text(1, 2, "b", "b"), text(1, 3, "c", "b"), text(1, 4, "d", None), text(2, 0, "a", "a"), text(2, 1, "b", "a")]
    draft = [text(1, 0, "e\u0301", None), token(1, 1), text(1, 2, "X", None), text(1, 3, "c", None), text(1, 4, "Y", None), text(1, 5, "d", None), text(2, 0, "a", None), text(2, 1, "Z", None), text(2, 2, "b", None)]
    paragraphs = spark.createDataFrame([(1, "direct", False, "s"), (2, "direct", False, "s"), (3, "direct", False, "s")], "id int, mode string, has_opaque boolean, insertion_style string")
    hunks, _ = align.plan_hunks(spark.createDataFrame(base, schema), spark.createDataFrame(draft, schema), paragraphs, ["id"])
    got = [(r.id, r.hunk, r.operation, r.base_start, r.removed, r.inserted, r.source_styles, r.assigned_style, r.reason) for r in hunks.orderBy("id", "hunk").collect()]
    assert got == [
        (1, 0, "replace", 2, "b", "X", ["b"], "b", "single-region-inheritance"), (1, 1, "insert", 4, "", "Y", [], "b", "left-context"),
        (2, 0, "insert", 1, "", "Z", [], "a", "left-context"),
    ]
