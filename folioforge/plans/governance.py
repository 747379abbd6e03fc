"""Queries over relationship graphs and normalisation policies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import normalize, packages, policies
from ..sources.scratch import written
from ..sources.tables import table
from .fragments import CANDIDATES

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(relationship members, parts): a customer is a package, an order a part that names the customer's next one.

    The last order names the first for one customer in five, and a part that isn't
    there for one of the others in seven.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    first = F.first("o_orderkey").over(w).cast("string")
    last = F.when(cust % 5 == 0, first).when(cust % 7 == 0, F.concat(key, F.lit("-gone")))
    named = F.coalesce(F.lead("o_orderkey").over(w).cast("string"), last)
    rows = orders.select(F.concat(F.lit("c"), cust.cast("string")).alias("doc_id"), key.alias("key"), named.alias("named"))
    xml = F.concat(F.lit('<Relationships><Relationship Id="r1" Type="next" Target="../orders/'), "named", F.lit('.xml"/></Relationships>'))
    rels = rows.where("named IS NOT NULL").select("doc_id", F.concat(F.lit("orders/_rels/"), "key", F.lit(".xml.rels")).alias("part"), xml.alias("xml"))
    return rels, rows.select("doc_id", F.concat(F.lit("orders/"), "key", F.lit(".xml")).alias("part"))


@query
def relationship_check(spark, sf_dir):
    """Missing targets and cycles of relationship graphs."""
    rels, parts = _packages(spark, sf_dir)
    return packages.relationship_violations(written(packages.relationships(rels), "relationships"), parts)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprinted candidates, snapshots) of all documents with a text."""
    docs = table(spark, sf_dir, "documents")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    snapshots = docs.where("text IS NOT NULL").select(
        "doc_id", F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("project_id"), sha(F.col("text")).alias("baseline_sha256"), sha(F.col("text")).alias("draft_snapshot_sha256"),
        sha(F.lit("model")).alias("model_sha256"), sha(F.lit("catalog")).alias("catalog_sha256"), F.lit(policies.VERSION).alias("scanner_contract_version"),
    )
    found = normalize.candidate_scan(docs, normalize.accent_catalog())
    rows = found.select(
        "doc_id", F.concat(F.lit("C"), F.expr("substring(occurrence_id, 2)")).alias("candidate_id"), "occurrence_id", F.lit("P0").alias("paragraph_id"), F.lit("[0]").alias("node_path"), F.col("offset").alias("visible_offset"),
        F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("source")), 4, "0")).alias("codepoint"), "source", F.lit("s").alias("style_id"), F.col("class").alias("classification"), F.col("target").alias("proposed_target"),
        F.lit("none").alias("vertical"), (F.col("class") == normalize.APPROVED).alias("reversible"), F.lit(None).cast("string").alias("word_vert_align"), F.lit(None).cast("string").alias("word_position"),
    )
    return policies.with_fingerprints(rows, snapshots), snapshots


@query
def candidate_fingerprints(spark, sf_dir):
    """Fingerprints that bind every candidate to its document's snapshot."""
    return _candidates(spark, sf_dir)[0].select("doc_id", "occurrence_id", "candidate_fingerprint")


@query
def policy_gate(spark, sf_dir):
    """What keeps each document's policy from being applied: by document a stale model, an open candidate, a missing rationale, or nothing."""
    bound, snapshots = _candidates(spark, sf_dir)
    bound = written(bound, "candidates")
    scans = written(snapshots.join(policies.scan_hashes(bound, snapshots), "doc_id"), "scans")
    kind = F.pmod("doc_id", F.lit(4))
    convert = F.col("classification") == normalize.APPROVED
    rationale = F.when(~convert & (kind != 1), "read")
    decisions = bound.where(~((kind == 2) & (F.col("occurrence_id") == "V00001"))).select(
        "doc_id", "occurrence_id", F.when(convert, "convert").otherwise("preserve").alias("decision"), F.lit("editor").alias("actor"), "candidate_fingerprint", rationale.alias("rationale")
    )
    model = F.when(kind == 3, F.sha2(F.lit("old").cast("binary"), 256)).otherwise(F.col("model_sha256"))
    approval = F.lit(None).cast("struct<approved:boolean,requirement:string,approved_by:string,approval_time:string>")
    given = scans.withColumns({"model_sha256": model, "status": F.lit("reviewed"), "approval_requirement": F.lit("human"), "approval": approval})
    return policies.first_violations(policies.policy_violations(given, decisions, scans, bound))


_SNAPSHOT = """'{"baseline_sha256":"' || sha256(text) || '","catalog_sha256":"' || sha256('catalog') || '","draft_snapshot_sha256":"' || sha256(text) || '","model_sha256":"' || sha256('model') || '","project_id":"p-' || doc_id || '","scanner_contract_version":1}'"""
ORACLES = {
    "relationship_check": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n, first_value(o_orderkey) OVER w AS head, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT 'c' || o_custkey AS doc_id, 'orders/' || o_orderkey || '.xml' AS source, 'orders/' || o_orderkey || '-gone.xml' AS resolved, 'relationship-target-missing' AS code FROM o WHERE k = n AND o_custkey % 5 <> 0 AND o_custkey % 7 = 0
        UNION ALL SELECT 'c' || o_custkey, 'orders/' || o_orderkey || '.xml', 'orders/' || coalesce(next, head) || '.xml', 'relationship-cycle' FROM o WHERE o_custkey % 5 = 0 AND n <= 2
        UNION ALL SELECT DISTINCT 'c' || o_custkey, NULL, NULL, 'relationship-cycle-transitive' FROM o WHERE o_custkey % 5 = 0""",
    "candidate_fingerprints": f"""WITH s AS (SELECT doc_id, sha256(text) AS base, sha256({_SNAPSHOT}) AS snapshot FROM documents WHERE text IS NOT NULL)
        SELECT c.doc_id, occurrence_id, sha256('{{"baseline_sha256":"' || base || '","candidate_id":"C' || substr(occurrence_id, 2) || '","catalog_sha256":"' || sha256('catalog') || '","classification":"' || class || '","codepoint":"U+' || lpad(upper(to_hex(unicode(source))), 4, '0')
        || '","draft_snapshot_sha256":"' || base || '","model_sha256":"' || sha256('model') || '","node_path":"[0]","occurrence_id":"' || occurrence_id || '","paragraph_id":"P0","project_id":"p-' || c.doc_id || '","proposed_target":"' || target || '","reversible":' || (class = 'approved')
        || ',"scanner_contract_version":1,"snapshot_sha256":"' || snapshot || '","source":"' || source || '","style_id":"s","vertical":"none","visible_offset":' || "offset" || '}}') AS candidate_fingerprint FROM {CANDIDATES} c JOIN s USING (doc_id)""",
    "policy_gate": f"""WITH c AS (SELECT * FROM {CANDIDATES})
        SELECT doc_id, 'stale-model_sha256' AS code, '' AS occurrence_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3
        UNION ALL SELECT doc_id, 'pending-decision', 'V00001' FROM c WHERE doc_id % 4 = 2 GROUP BY doc_id
        UNION ALL SELECT doc_id, 'rationale-required', min(occurrence_id) FROM c WHERE doc_id % 4 = 1 AND class <> 'approved' GROUP BY doc_id""",
}
