"""Settlement and patch batches: codes, blocking, nesting, repetition, and plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import collab
from folioforge.operators import nodes as N
from folioforge.sources import docx
from folioforge.sources.scratch import written
from tests.test_docx import BOX, NS, run

PRINT = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]


def wrap(name, w_id, inner):
    return f'<w:{name} w:id="{w_id}" w:author="A">{inner}</w:{name}>'


def gone(text):
    return f"<w:r><w:delText>{text}</w:delText></w:r>"


# outer insertion 1 holds deletion 2; 3 stands alone; 4 lies beside a text box
XML = f"<w:document {NS}><w:body><w:p>{run('a')}{wrap('ins', 1, run('b') + wrap('del', 2, gone('c')) + run('d'))}{wrap('del', 3, gone('e'))}</w:p><w:p>{wrap('ins', 4, run('x'))}{BOX}</w:p></w:body></w:document>"
HEAD = f"<w:hdr {NS}><w:p>{wrap('ins', 9, run('h'))}</w:p></w:hdr>"
KEY = {1: f"{docx.MAIN}|insert|1|{PRINT('bcd')}", 2: f"{docx.MAIN}|delete|2|{PRINT('c')}", 3: f"{docx.MAIN}|delete|3|{PRINT('e')}", 4: f"{docx.MAIN}|insert|4|{PRINT('x')}", 9: f"word/header1.xml|insert|9|{PRINT('h')}"}
# document: events (key, decision), expected states and codes, expected views of P0
CASES = {
    "plain": ([(KEY[1], "accept"), (KEY[3], "reject")], [("settled", None)] * 2, ("abde", "abcde")),
    "inner": ([(KEY[2], "reject"), (KEY[3], "defer")], [("settled", None), ("deferred", None)], ("abcd", "ae")),
    "drops": ([(KEY[1], "reject")], [("settled", None)], ("a", "ae")),
    "nested": ([(KEY[1], "accept"), (KEY[2], "accept"), (KEY[3], "accept")], [("blocked", "nested-decision-conflict")] * 2 + [("blocked", None)], ("abd", "ae")),
    "twice": ([(KEY[3], "accept"), (KEY[3], "reject")], [("blocked", "duplicate-decision")] * 2, ("abd", "ae")),
    "absent": ([(f"{docx.MAIN}|insert|77|x", "accept"), (KEY[3], "accept")], [("blocked", "revision-not-found"), ("blocked", None)], ("abd", "ae")),
    "opaque": ([(KEY[4], "accept")], [("blocked", "revision-outside-editable-surface")], ("abd", "ae")),
    "header": ([(KEY[9], "accept")], [("blocked", "revision-outside-editable-surface")], ("abd", "ae")),
    "print": ([(KEY[3][:-1] + "?", "accept")], [("blocked", "revision-text-fingerprint-mismatch")], ("abd", "ae")),
    "kind": ([(KEY[3].replace("delete", "insert"), "accept")], [("blocked", "revision-text-fingerprint-mismatch")], ("abd", "ae")),
    "empty": ([(KEY[3], "pending")], [("blocked", "settlement-empty")], ("abd", "ae")),
}


@pytest.fixture(scope="module")
def model(spark):
    parts = spark.createDataFrame([(d, p, x) for d in CASES for p, x in ((docx.MAIN, XML), ("word/header1.xml", HEAD))], "doc_id string, part string, xml string")
    nested = written(N.nest(N.tokens(parts, N.KEYS, "xml"), N.KEYS), "tokens")
    paragraphs = written(N.word_paragraphs(nested), "paragraphs")
    nodes = written(N.word_nodes(nested, paragraphs), "nodes")
    return paragraphs, nodes, written(N.word_revisions(nodes), "revisions")


def events_of(spark, state="staged"):
    rows = [(d, "b", f"{d}{k}", key, decision, state) for d, (events, _, _) in CASES.items() for k, (key, decision) in enumerate(events)]
    return spark.createDataFrame(rows, "doc_id string, batch_id string, event_id string, revision_key string, decision string, delivery_state string")


def views(paragraphs, nodes):
    rows = N.word_views(paragraphs, nodes).where("part = 'word/document.xml' AND paragraph_id = 'P0'").collect()
    return {r.doc_id: (r.final_text, r.original_text) for r in rows}


def test_settlement(spark, model):
    paragraphs, nodes, revisions = model
    after, status = collab.settlement(nodes, revisions, events_of(spark))
    got = {}
    for r in status.orderBy("event_id").collect():
        got.setdefault(r.doc_id, []).append((r.state, r.code))
    assert got == {d: want for d, (_, want, _) in CASES.items()}
    after = written(after, "settled")
    assert views(paragraphs, after) == {d: want for d, (_, _, want) in CASES.items()}
    left = {r.doc_id: sorted(r.ids) for r in after.where("cls = 'revision' AND part = 'word/document.xml'").join(revisions.select(*N.KEYS, "seq", "w_id"), [*N.KEYS, "seq"]).groupBy("doc_id").agg(F.collect_list("w_id").alias("ids")).collect()}
    assert left["plain"] == ["2", "4"] and left["drops"] == ["3", "4"] and left["nested"] == ["1", "2", "3", "4"]


def test_settling_again_changes_nothing(spark, model):
    paragraphs, nodes, revisions = model
    after, status = collab.settlement(nodes, revisions, events_of(spark, "applied"))
    assert {r.state for r in status.collect()} == {"already-settled"}
    assert views(paragraphs, after) == {d: ("abd", "ae") for d in CASES}


FIELDS = "doc_id string, batch_id string, event_id string, step int, origin string, parent_snapshot string, staged_snapshot string, paragraph_id string, start_offset int, end_offset int, before string, after string, expected_text string, left_context string, right_context string, paragraph_fingerprint string, region_fingerprint string"
TEXT = "The quick brown fox jumps over the lazy dog. " * 8


def fnv(text):
    h = 2166136261
    for i in range(0, len(raw := text.encode("utf-16-le")), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 % 2**32
    return f"fnv1a-{h:08x}"


def patch(doc, step, start, end, after, text=TEXT, **other):
    row = {
        "doc_id": doc, "batch_id": "b", "event_id": f"{doc}{step}", "step": step, "origin": "human_ui", "parent_snapshot": f"H1.{step}" if step else "C1", "staged_snapshot": f"H1.{step + 1}", "paragraph_id": "P0",
        "start_offset": start, "end_offset": end, "before": text[start:end], "after": after, "expected_text": text[start:end], "left_context": text[max(0, start - 100) : start], "right_context": text[end : end + 100],
        "paragraph_fingerprint": fnv(text), "region_fingerprint": fnv(text[start:end]) if end > start else None,
    }
    return tuple((row | other).values())


BROKEN = {
    "patch-origin": [patch("patch-origin", 0, 0, 3, "A", origin="robot")], "patch-target": [patch("patch-target", 0, 0, 3, "A", paragraph_id="P7")], "patch-range": [patch("patch-range", 0, 5, 3, "A", before="", expected_text="")],
    "patch-too-large": [patch("patch-too-large", 0, 0, 3, "x" * 8001)], "patch-precondition": [patch("patch-precondition", 0, 0, 3, "A", before="Tha", expected_text="Tha")], "patch-context-mismatch": [patch("patch-context-mismatch", 0, 4, 9, "A", right_context="?")],
    "patch-fingerprint-mismatch": [patch("patch-fingerprint-mismatch", 0, 4, 9, "A", paragraph_fingerprint="fnv1a-00000000")], "patch-parent-mismatch": [patch("patch-parent-mismatch", 0, 0, 3, "A"), patch("patch-parent-mismatch", 1, 4, 9, "B", parent_snapshot="C1")],
    "patch-overlap": [patch("patch-overlap", 0, 0, 9, "A"), patch("patch-overlap", 1, 2, 4, "B"), patch("patch-overlap", 2, 5, 7, "C")], "patch-noop": [patch("patch-noop", 0, 0, 3, "The")], "cross-region-text": [patch("cross-region-text", 0, 8, 12, "A")],
}


def test_patch_codes_block_their_batch(spark):
    rows = [p for ps in BROKEN.values() for p in ps] + [patch("same-place", 0, 4, 4, "a"), patch("same-place", 1, 4, 4, "b"), patch("fine", 0, 12, 14, "é😀"), patch("fine", 1, 4, 4, "very "), patch("fine", 2, 20, 24, "")]
    docs = sorted({r[0] for r in rows} | {"untouched"})
    paragraphs = spark.createDataFrame([(d, "P0", TEXT) for d in docs], "doc_id string, paragraph_id string, text string")
    regions = spark.createDataFrame([(d, "P0", a, b) for d in docs for a, b in ((0, 10), (10, len(TEXT)))], "doc_id string, paragraph_id string, start int, stop int")
    texts, status = collab.patch_batches(paragraphs, spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(d, "C1") for d in docs], "doc_id string, snapshot string"), regions)
    got = {}
    for r in status.collect():
        got.setdefault(r.doc_id, set()).add((r.state, r.code))
    for code in BROKEN:
        assert {s for s, _ in got[code]} == {"blocked"} and {c for _, c in got[code] if c} == {code}, code
    assert got["same-place"] == {("blocked", None), ("blocked", "patch-overlap")} and got["fine"] == {("applied", None)}
    texts = {r.doc_id: r.text for r in texts.collect()}
    assert texts["fine"] == TEXT[:4] + "very " + TEXT[4:12] + "é😀" + TEXT[14:20] + TEXT[24:]
    assert all(t == TEXT for d, t in texts.items() if d != "fine")


def test_batches_equal_application_from_the_right(spark):
    rnd = random.Random(9)
    texts, patches, want = [], [], {}
    for k in range(60):
        text = "".join(rnd.choice("ab é😀\n") for _ in range(rnd.randint(0, 80)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(2 * rnd.randint(1, 4), len(text) // 2 * 2)))
        ranges = list(zip(cuts[::2], cuts[1::2])) or [(0, 0)]
        new = ["".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 5))) for _ in ranges]
        order = rnd.sample(range(len(ranges)), len(ranges))
        patches += [patch(f"d{k}", step, *ranges[i], new[i], text) for step, i in enumerate(order)]
        done = text
        for (a, b), n in sorted(zip(ranges, new), reverse=True):
            done = done[:a] + n + done[b:]
        texts.append((f"d{k}", "P0", text))
        want[f"d{k}"] = done
    paragraphs = spark.createDataFrame(texts, "doc_id string, paragraph_id string, text string")
    after, status = collab.patch_batches(paragraphs, spark.createDataFrame(patches, FIELDS), paragraphs.select("doc_id", F.lit("C1").alias("snapshot")))
    assert {r.state for r in status.collect()} == {"applied"}
    assert {r.doc_id: r.text for r in after.collect()} == want
