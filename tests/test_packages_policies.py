"""Relationship graphs, package statistics, canonical JSON, fingerprints and policy gates against plain code."""

import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators import nodes as N
from folioforge.operators import packages as P
from folioforge.operators import policies, validate
from folioforge.sources import docx
from tests.test_docx import MORE, package


def rels(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="t" Target="{t}"/>' for k, t in enumerate(targets)) + "</Relationships>"


def test_targets_and_violations(spark):
    rows = [
        ("fine", "_rels/.rels", rels("word/document.xml", "https://x.y/z", "mailto:a@b", "/abs")), ("fine", "word/_rels/document.xml.rels", rels("styles.xml", "../custom/./item.xml", "media/../media/i.png")),
        ("lost", "word/_rels/document.xml.rels", rels("gone.xml", "styles.xml")), ("pair", "a/_rels/x.xml.rels", rels("y.xml")), ("pair", "a/_rels/y.xml.rels", rels("../a/x.xml")),
        ("ring", "_rels/x.rels", rels("y")), ("ring", "_rels/y.rels", rels("z")), ("ring", "_rels/z.rels", rels("x", "w")), ("tree", "_rels/x.rels", rels("y", "z")), ("tree", "_rels/y.rels", rels("z")), ("self", "_rels/x.rels", rels("x")),
    ]
    members = [("fine", m) for m in ("word/document.xml", "word/styles.xml", "custom/item.xml", "word/media/i.png")] + [("lost", "word/styles.xml"), ("pair", "a/x.xml"), ("pair", "a/y.xml"), ("self", "x")] + [(d, m) for d in ("ring", "tree") for m in "xyzw"]
    links = P.relationships(spark.createDataFrame(rows, "doc_id string, part string, xml string"))
    got = {(r.doc_id, r.source, r.target): r.resolved for r in links.collect()}
    assert got["fine", "", "https://x.y/z"] is None and got["fine", "", "/abs"] is None and got["fine", "word/document.xml", "../custom/./item.xml"] == "custom/item.xml" and got["pair", "a/y.xml", "../a/x.xml"] == "a/x.xml"
    bad = P.relationship_violations(links, spark.createDataFrame(members, "doc_id string, part string"))
    whole = "relationship-cycle-transitive"
    assert sorted(map(tuple, bad.collect()), key=repr) == sorted([
        ("lost", "word/document.xml", "word/gone.xml", "relationship-target-missing"), ("pair", "a/x.xml", "a/y.xml", "relationship-cycle"), ("pair", "a/y.xml", "a/x.xml", "relationship-cycle"), ("pair", None, None, whole),
        ("ring", None, None, whole), ("self", "x", "x", "relationship-cycle"), ("self", None, None, whole),
    ], key=repr)


def test_cycles_of_random_graphs(spark):
    rnd, edges, want = random.Random(2), [], set()
    for g in range(40):
        n = rnd.randint(2, 8)
        mine = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, n + 1))}
        edges += [(str(g), str(a), str(b)) for a, b in mine]
        reach = set(mine)
        for _ in range(n):
            reach |= {(a, d) for a, b in reach for c, d in mine if b == c}
        if any(a == b for a, b in reach):
            want.add(str(g))
    assert {r.doc_id for r in P.cyclic(spark.createDataFrame(edges, "doc_id string, a string, b string")).collect()} == want


def test_package_statistics(spark):
    packages = spark.createDataFrame([("a", package()), ("b", package(MORE)), ("broken", b"x")], "doc_id string, content binary")
    parts = docx.explode_parts(packages).cache()
    got = {r.doc_id: r for r in P.package_stats(packages, parts, docx.sound_tokens(parts)).collect()}
    sizes = {r.doc_id: r.n for r in parts.where("part IS NOT NULL").groupBy("doc_id").agg(F.sum("size").alias("n")).collect()}
    assert (got["a"].n_parts, got["a"].n_revisions, got["a"].n_cells, got["a"].longest_text, got["a"].depth) == (3, 2, 3, 17, 11)
    assert got["a"].package_bytes == len(package()) and abs(got["a"].ratio - sizes["a"] / len(package())) < 1e-9 and (got["broken"].n_parts, got["broken"].depth) == (0, 0)
    over = validate.limit_violations(P.package_stats(packages, parts, docx.sound_tokens(parts)), "doc_id", P.PROFILES["S"] | {"n_cells": 2, "depth": 11})
    assert sorted((r.doc_id, r.dimension, r.actual) for r in over.collect()) == [("a", "n_cells", 3), ("b", "depth", 14)]  # limits are inclusive


def test_canonical_json(spark):
    kind = T.StructType().add("b", "string").add("a", T.ArrayType(T.LongType())).add("m", T.MapType(T.StringType(), T.BooleanType())).add("s", T.StructType().add("z", T.IntegerType()).add("y", "string"))
    rows = [('q"\\/\n\t\x01\x1fé😀', [1, None], {"k": True, "a": None}, (1, "x")), (None, None, None, None), ("", [], {}, (None, None)), ("\b\f\r", [-5], {"é": False}, (0, "'"))]
    got = [r.j for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType().add("i", T.IntegerType()).add("o", kind)).orderBy("i").select(policies.canonical_json(F.col("o"), kind).alias("j")).collect()]
    as_object = lambda r: {"b": r[0], "a": r[1], "m": r[2], "s": r[3] and dict(zip("zy", r[3]))}
    assert got == [json.dumps(as_object(r), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows]


def test_plain_texts_are_quoted_without_replacing(spark):
    assert "ELSE x END" in str(policies._quoted(F.col("x")))


def sha(x):
    return hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


SNAP = {"project_id": "p", "baseline_sha256": "0" * 64, "draft_snapshot_sha256": "1" * 64, "model_sha256": "2" * 64, "catalog_sha256": "3" * 64, "scanner_contract_version": 1}


def candidate(k, **other):
    base = {"candidate_id": f"C{k:05d}", "occurrence_id": f"P0-V{k:04d}", "paragraph_id": "P0", "node_path": f"[{k}]", "visible_offset": k, "codepoint": "U+00B2", "source": "²", "style_id": "s", "classification": "approved", "proposed_target": "2", "vertical": "superscript", "reversible": True}
    return base | other


CANDIDATE_TYPES = "doc_id string, " + ", ".join(f"{n} {'int' if n == 'visible_offset' else 'boolean' if n == 'reversible' else 'string'}" for n in policies.CANDIDATE)
# policy: candidates, changed decisions, changed policy, first violation
POLICIES = {
    "good": ([candidate(1), candidate(2, classification="manual")], {2: {"decision": "preserve", "rationale": "kept"}}, {}, None), "pending": ([candidate(1), candidate(2)], {2: None}, {}, "pending-decision"), "word": ([candidate(1)], {1: {"decision": "maybe"}}, {}, "invalid-decision"),
    "actor": ([candidate(1)], {1: {"actor": " "}}, {}, "missing-actor"), "print": ([candidate(1)], {1: {"candidate_fingerprint": "x"}}, {}, "fingerprint-mismatch"), "why": ([candidate(1, classification="ambiguous")], {1: {"decision": "preserve"}}, {}, "rationale-required"),
    "undo": ([candidate(1, reversible=False)], {}, {}, "rationale-required"), "class": ([candidate(1, classification="manual")], {1: {"rationale": "r"}}, {}, "class-not-convertible"), "target": ([candidate(1, proposed_target="")], {}, {}, "no-target"),
    "stale": ([candidate(1)], {}, {"model_sha256": "9" * 64}, "stale-model_sha256"), "scan": ([candidate(1)], {}, {"scan_artifact_sha256": "x"}, "different-scan"), "status": ([candidate(1)], {}, {"status": "done"}, "invalid-status"), "need": ([candidate(1)], {}, {"approval_requirement": "none"}, "invalid-requirement"),
    "unknown": ([candidate(1)], {9: {}}, {}, "unknown-occurrence"), "draft": ([candidate(1)], {}, {"status": "draft"}, "not-approved"), "bare": ([candidate(1)], {}, {"approval": None}, "approval-missing"), "other": ([candidate(1)], {}, {"approval": (True, "self", "x", "t")}, "approval-requirement-mismatch"),
    "nobody": ([candidate(1)], {}, {"approval": (True, "human", " ", "t")}, "approval-without-name"), "refused": ([candidate(1)], {}, {"approval": (False, "human", "x", "t")}, "approval-not-given"), "empty": ([], {}, {}, None),
}


def test_fingerprints_and_policy_gate(spark):
    rows, decided, given = [], [], []
    hashes = {}
    for d, (candidates, changes, policy, _) in POLICIES.items():
        bound = [c | {"candidate_fingerprint": sha({"snapshot_sha256": sha(SNAP), **SNAP, **c})} for c in candidates]
        hashes[d] = sha({"schema": policies.SCAN_SCHEMA, "scanner_contract_version": 1, "snapshot": SNAP, "candidates": bound})
        rows += [(d, *c.values()) for c in candidates]
        prints = {int(c["candidate_id"][1:]): c["candidate_fingerprint"] for c in bound}
        for k in sorted({*prints, *changes}):
            if changes.get(k, {}) is not None:
                row = {"decision": "convert", "actor": "me", "candidate_fingerprint": prints.get(k), "rationale": None} | changes.get(k, {})
                decided.append((d, f"P0-V{k:04d}", *row.values()))
        row = {"status": "approved", "approval_requirement": "human", **SNAP, "scan_artifact_sha256": hashes[d], "approval": (True, "human", "x", "t")} | policy
        given.append((d, *row.values()))
    snap_types = ", ".join(f"{n} {'int' if n.endswith('version') else 'string'}" for n in policies.SNAPSHOT)
    snapshots = spark.createDataFrame([(d, *SNAP.values()) for d in POLICIES], "doc_id string, " + snap_types)
    candidates = spark.createDataFrame(rows, CANDIDATE_TYPES)
    assert policies.scan_violations(candidates).count() == 0
    bound = policies.with_fingerprints(candidates, snapshots).withColumns({"word_vert_align": F.lit(None).cast("string"), "word_position": F.lit(None).cast("string")}).cache()
    found = policies.scan_hashes(bound, snapshots).cache()
    assert {r.doc_id: r.scan_artifact_sha256 for r in found.collect()} == hashes
    table = spark.createDataFrame(given, f"doc_id string, status string, approval_requirement string, {snap_types}, scan_artifact_sha256 string, approval struct<approved:boolean,requirement:string,approved_by:string,approval_time:string>")
    decisions = spark.createDataFrame(decided, "doc_id string, occurrence_id string, decision string, actor string, candidate_fingerprint string, rationale string")
    bad = policies.policy_violations(table, decisions, snapshots.join(found, "doc_id"), bound, require_approved=True)
    first = policies.first_violations(bad).cache()
    assert {r.doc_id: r.code for r in first.collect()} == {d: p[3] for d, p in POLICIES.items() if p[3]}
    audit = policies.audit_records(bound, decisions, first).orderBy("occurrence_id").collect()
    assert [(r.doc_id, r.old_text, r.new_text, r.decision) for r in audit] == [("good", "²", "2", "convert"), ("good", "²", "²", "preserve")]


@pytest.mark.parametrize("change,code", [({"visible_offset": -1}, "invalid-offset"), ({"source": "ab"}, "invalid-source"), ({"codepoint": "U+0041"}, "codepoint-mismatch"), ({"classification": "x"}, "invalid-classification"), ({"occurrence_id": "P0-V0001"}, "duplicate-occurrence"), ({"candidate_id": "C00001"}, "duplicate-candidate")])
def test_scan_violations(spark, change, code):
    rows = [("d", *candidate(1).values()), ("d", *candidate(2, **change).values())]
    assert {r.code for r in policies.scan_violations(spark.createDataFrame(rows, CANDIDATE_TYPES)).collect()} == {code}


def test_graphs_are_read_in_one_pass(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(P, "written", lambda df, name, write=P.written: tables.append(name) or write(df, name))
    chain = [(d, f"n{k}", f"n{k + 1}") for d in ("open", "round") for k in range(90)] + [("round", "n90", "n0"), ("self", "x", "x"), ("two", "x", "y"), ("two", "y", "x"), ("two", "z", "x")]
    links = spark.createDataFrame(chain, "doc_id string, source string, resolved string").repartition(3)
    members = links.select("doc_id", F.col("source").alias("part")).union(spark.createDataFrame([("open", "n90")], links.select("doc_id", "source").schema))
    want = {("self", "x", "x", P.MUTUAL), ("two", "x", "y", P.MUTUAL), ("two", "y", "x", P.MUTUAL), *((d, None, None, P.TRANSITIVE) for d in ("round", "self", "two"))}
    got = [tuple(r) for r in P.relationship_violations(links, members).collect()]
    assert set(got) == want and len(got) == len(want) and tables == ["graphs"]


def test_large_graphs_are_passed_on(monkeypatch):
    monkeypatch.setattr(P, "EDGES_HELD", 4)
    rows = [("a", "x", "y"), ("a", "y", "x")] + [("b", str(k), str(k + 1)) for k in range(9)] + [("c", "x", "y"), ("d", "x", "x")]
    for size in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "a", "b"), r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        out = [tuple(r.values()) for batch in P._graph_batches(iter(batches)) for r in batch.to_pylist()]
        assert [r[:3] for r in out if r[3] is None] == (rows[2:11] if size < 20 else [])  # what one batch holds is read anyway
        assert {r for r in out if r[3]} == {("a", "x", "y", P.MUTUAL), ("a", "y", "x", P.MUTUAL), ("d", "x", "x", P.MUTUAL), ("a", None, None, P.TRANSITIVE), ("d", None, None, P.TRANSITIVE)}


def test_attribute_values(spark):
    tag = """<w:x a="1" w:b='two "q"' c = "x&amp;y's" d="" e="&#65;="/>"""
    row = spark.createDataFrame([(tag,), ("<y/>",), (None,)], "t string").select(N.attributes(F.col("t"))).collect()
    assert [r[0] for r in row] == [{"a": "1", "w:b": 'two "q"', "c": "x&y's", "d": "", "e": "A="}, {}, None]
