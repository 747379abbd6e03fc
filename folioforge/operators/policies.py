"""Canonical JSON, fingerprints bound to a snapshot, and the gate of normalisation policies.

``canonical_json`` follows a column's type: sorted keys, no white space, text as
it is but for the escapes JSON needs.  A candidate's fingerprint covers its own
fields and the snapshot it was found in, a scan's hash covers all of both, so a
change of either makes decisions stale.  Violations are rows, in the order of the
rules; the first one of a policy is what a reader would be told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema names, fields that hashes cover, and the words of policies.
SCAN_SCHEMA, VERSION = "vertical-normalization-scan-1", 1
SNAPSHOT = ("project_id", "baseline_sha256", "draft_snapshot_sha256", "model_sha256", "catalog_sha256", "scanner_contract_version")
CANDIDATE = ("candidate_id", "occurrence_id", "paragraph_id", "node_path", "visible_offset", "codepoint", "source", "style_id", "classification", "proposed_target", "vertical", "reversible")
CLASSES, RISKY = ("approved", "ambiguous", "manual", "unsupported"), ("ambiguous", "manual", "unsupported")
STATUSES, REQUIREMENTS, DECISIONS = ("draft", "reviewed", "approved", "superseded", "applied", "rejected"), ("human", "self"), ("convert", "preserve")
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def _quoted(x: Column) -> Column:
    escaped = x
    for old, new in (*_ESCAPES, *((chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\n\r\t\b\f")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    # few texts need an escape; the others are looked at once
    return F.concat(F.lit('"'), F.when(x.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(x), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A column as canonical JSON: sorted keys, compact, null as null."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        said = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        said = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        said = _quoted(value)
    else:
        said = value.cast("string")
    return F.when(value.isNotNull(), said).otherwise("null")


def payload_sha256(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind).cast("binary"), 256)


def _hash_of(df: DataFrame, columns: dict[str, Column]) -> Column:
    """Hash of an object with these members, typed as ``df`` resolves them."""
    kind = df.select(F.struct(*(c.alias(n) for n, c in columns.items())).alias("o")).schema["o"].dataType
    return payload_sha256(F.struct(*(c.alias(n) for n, c in columns.items())), kind)


def with_fingerprints(candidates: DataFrame, snapshots: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates (key and CANDIDATE columns) with their snapshot's columns, snapshot_sha256 and candidate_fingerprint."""
    rows = snapshots.withColumn("snapshot_sha256", _hash_of(snapshots, {n: F.col(n) for n in SNAPSHOT})).join(candidates, key)
    members = {"snapshot_sha256": F.col("snapshot_sha256"), **{n: F.col(n) for n in (*SNAPSHOT, *CANDIDATE)}}
    return rows.withColumn("candidate_fingerprint", _hash_of(rows, members))


def scan_violations(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, occurrence_id, code): what keeps candidates from being a scan; the first rule that is broken."""
    point = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("source")), 4, "0"))
    count = lambda name: F.count(F.lit(1)).over(Window.partitionBy(key, name))
    code = (
        F.when(F.col("visible_offset").isNull() | (F.col("visible_offset") < 0), "invalid-offset").when(F.coalesce(F.length("source"), F.lit(0)) != 1, "invalid-source").when(~F.col("codepoint").eqNullSafe(point), "codepoint-mismatch")
        .when(~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)), "invalid-classification").when(count("occurrence_id") > 1, "duplicate-occurrence").when(count("candidate_id") > 1, "duplicate-candidate")
    )
    return candidates.withColumn("code", code).where("code IS NOT NULL").select(key, "occurrence_id", "code")


def scan_hashes(fingerprinted: DataFrame, snapshots: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, scan_artifact_sha256): the hash of a document's snapshot and all its candidates in order of their occurrence ids."""
    listed = F.struct("occurrence_id", F.struct(*CANDIDATE, "candidate_fingerprint").alias("c"))
    per = fingerprinted.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["c"]).alias("candidates"))
    rows = snapshots.join(per, key, "left")
    kind = rows.schema["candidates"].dataType
    rows = rows.withColumn("candidates", F.coalesce("candidates", F.array().cast(kind)))
    members = {"schema": F.lit(SCAN_SCHEMA), "scanner_contract_version": F.col("scanner_contract_version"), "snapshot": F.struct(*SNAPSHOT), "candidates": F.col("candidates")}
    return rows.select(key, _hash_of(rows, members).alias("scan_artifact_sha256"))


def risk_reasons() -> Column:
    """Why a candidate needs a rationale: its class, a conversion that can't be undone, a style it would conflict with."""
    conflict = (F.coalesce("word_vert_align", F.lit("")) != "") & ~F.col("word_vert_align").eqNullSafe(F.col("vertical")) | (F.coalesce("word_position", F.lit("")) != "")
    parts = [F.when(F.col("classification").isin(*RISKY), F.col("classification")), F.when(~F.col("reversible"), "non_reversible"), F.when(conflict, "conflicting_style")]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def policy_violations(policies: DataFrame, decisions: DataFrame, scans: DataFrame, fingerprinted: DataFrame, key: str = "doc_id", require_approved: bool = False) -> DataFrame:
    """(key, occurrence_id, rule, code) of everything that keeps a policy from being applied; ``rule`` is its place in the order.

    ``policies``: key, status, approval_requirement, the SNAPSHOT columns,
    scan_artifact_sha256, and approval (a struct of approved, requirement,
    approved_by, approval_time); ``decisions``: key, occurrence_id, decision, actor,
    candidate_fingerprint, rationale; ``scans``: key, the SNAPSHOT columns,
    scan_artifact_sha256; ``fingerprinted``: candidates with word_vert_align and
    word_position too.
    """
    theirs = scans.select(key, *(F.col(n).alias("s_" + n) for n in (*SNAPSHOT, "scan_artifact_sha256")))
    rows = policies.join(theirs, key)
    stale = [~F.col(n).eqNullSafe(F.col("s_" + n)) for n in SNAPSHOT]
    whole = [
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid-status"), (~F.coalesce(F.col("approval_requirement").isin(*REQUIREMENTS), F.lit(False)), "invalid-requirement"),
        *((c, f"stale-{n}") for c, n in zip(stale, SNAPSHOT)), (~F.col("scan_artifact_sha256").eqNullSafe(F.col("s_scan_artifact_sha256")), "different-scan"),
    ]
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    last = [
        (F.col("status") != "approved", "not-approved"), (F.col("approval").isNull(), "approval-missing"), (~F.coalesce("approval.approved", F.lit(False)), "approval-not-given"),
        (~F.col("approval.requirement").eqNullSafe(F.col("approval_requirement")), "approval-requirement-mismatch"), (~given(F.col("approval.approved_by")), "approval-without-name"), (~given(F.col("approval.approval_time")), "approval-without-time"),
    ]
    none = F.lit(None).cast("string")

    def broken(rules: list, first: int) -> Column:
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(first + k).alias("rule"), F.lit(code).alias("code"))) for k, (c, code) in enumerate(rules))))

    checks = F.concat(broken(whole, 0), broken(last, 100)) if require_approved else broken(whole, 0)
    out = rows.select(key, none.alias("occurrence_id"), F.explode(checks).alias("v")).select(key, "occurrence_id", "v.rule", "v.code")
    mine = decisions.select(key, "occurrence_id", "decision", "actor", F.col("candidate_fingerprint").alias("d_fingerprint"), "rationale", F.lit(True).alias("decided"))
    both = fingerprinted.withColumn("found", F.lit(True)).withColumn("risks", risk_reasons()).join(mine, [key, "occurrence_id"], "full").join(policies.select(key), key, "left_semi")
    one = [
        (F.col("found").isNull(), "unknown-occurrence"), (F.col("decided").isNull(), "pending-decision"), (~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "invalid-decision"), (~given(F.col("actor")), "missing-actor"),
        (~F.col("d_fingerprint").eqNullSafe(F.col("candidate_fingerprint")), "fingerprint-mismatch"), ((F.size("risks") > 0) & (F.coalesce("rationale", F.lit("")) == ""), "rationale-required"),
        ((F.col("decision") == "convert") & (F.col("classification") != "approved"), "class-not-convertible"), ((F.col("decision") == "convert") & ~given(F.col("proposed_target")), "no-target"),
    ]
    first = F.get(broken(one, 50), F.lit(0))
    return out.unionByName(both.withColumn("v", first).where("v IS NOT NULL").select(key, "occurrence_id", "v.rule", "v.code"))


def first_violations(violations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, code, occurrence_id): the violation a reader is told of."""
    best = F.min(F.struct("rule", F.coalesce("occurrence_id", F.lit("")).alias("occurrence_id"), "code"))
    return violations.groupBy(key).agg(best.alias("v")).select(key, "v.code", "v.occurrence_id")


def audit_records(fingerprinted: DataFrame, decisions: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """One record per candidate of policies without violations, with the text before and after."""
    mine = decisions.select(key, "occurrence_id", "decision", "actor", "rationale")
    rows = fingerprinted.join(rejected.select(key), key, "left_anti").join(mine, [key, "occurrence_id"])
    convert = F.col("decision") == "convert"
    delta = F.when(convert, F.struct("vertical", "reversible"))
    return rows.select(key, "occurrence_id", "candidate_id", "paragraph_id", "candidate_fingerprint", F.col("source").alias("old_text"), F.when(convert, F.col("proposed_target")).otherwise(F.col("source")).alias("new_text"), F.col("style_id").alias("old_style_id"), delta.alias("style_delta"), "classification", "decision", "actor", "rationale")
