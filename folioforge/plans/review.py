"""Queries over review batches: settlement of revisions and human text patches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, collab
from ..operators import nodes as N
from ..operators.validate import fnv1a_utf16
from ..sources.scratch import written
from ..sources.tables import draft_pairs, table
from .structure import _PART, _TURNS, conversation_nodes

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on every revision of a conversation: accept, reject or defer by its turn.

    One conversation in seven decides a revision twice, one names texts that are not
    there, one was settled before.
    """
    turns = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    conv, odd = F.col("conv_id"), F.col("conv_id") % 7
    kind = F.when(F.col("role") == "user", "insert").otherwise("delete")
    known = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12)
    key = F.concat_ws("|", F.lit(_PART), kind, F.col("turn").cast("string"), F.when(odd == 1, F.lit("f" * 12)).otherwise(known))
    decision = F.when(F.col("turn") % 3 == 0, "defer").when(F.col("turn") % 3 == 1, "accept").otherwise("reject")
    rows = turns.select(conv.cast("string").alias("doc_id"), F.lit("b").alias("batch_id"), F.concat_ws("-", conv.cast("string"), F.col("turn").cast("string")).alias("event_id"), key.alias("revision_key"), decision.alias("decision"), F.when(odd == 2, "applied").otherwise("staged").alias("delivery_state"), "turn", odd.alias("odd"))
    first = F.min("turn").over(Window.partitionBy("doc_id"))
    again = rows.withColumn("first", first).where("odd = 0 AND turn = first").withColumn("event_id", F.concat("doc_id", F.lit("-again"))).withColumn("decision", F.lit("accept"))
    return rows.unionByName(again.drop("first")).drop("turn", "odd")


def _settlement(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    paragraphs, nodes = conversation_nodes(spark, sf_dir)
    nodes = written(nodes, "part-nodes")
    return paragraphs, *collab.settlement(nodes, written(N.word_revisions(nodes), "revisions"), _events(spark, sf_dir))


@query
def settlement_status(spark, sf_dir):
    """What became of every decision."""
    return _settlement(spark, sf_dir)[2]


@query
def settlement_views(spark, sf_dir):
    """Both views of every paragraph after the batches were settled."""
    paragraphs, nodes, _ = _settlement(spark, sf_dir)
    return N.word_views(paragraphs, nodes).select("doc_id", "paragraph_id", "final_text", "original_text", "n_revisions")


def _patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paragraphs, patches, current snapshots): drafts as batches of human patches.

    Of one conversation in four the first patch has another parent, of one another context.
    """
    pairs = draft_pairs(spark, sf_dir).where("before IS NOT NULL AND after IS NOT NULL")
    pairs = written(pairs.withColumn("print", F.concat(F.lit("fnv1a-"), fnv1a_utf16(F.col("before")))), "pairs")
    kind = F.regexp_extract("id", "^([0-9]+)", 1).cast("long") % 4
    hunks = align.text_hunks(pairs).join(pairs.select("id", F.col("before").alias("text"), "print"), "id")
    first = F.col("hunk") == 0
    parent = F.when(first, F.when(kind == 0, "C0").otherwise("C1")).otherwise(F.concat(F.lit("H1."), F.col("hunk").cast("string")))
    left = F.substring("text", F.greatest(F.col("i1") - 100, F.lit(0)) + 1, F.least("i1", F.lit(100)))
    patches = hunks.select(
        F.col("id").alias("doc_id"), F.lit("b").alias("batch_id"), F.concat_ws("-", "id", F.col("hunk").cast("string")).alias("event_id"), F.col("hunk").alias("step"), F.lit("human_ui").alias("origin"),
        parent.alias("parent_snapshot"), F.concat(F.lit("H1."), (F.col("hunk") + 1).cast("string")).alias("staged_snapshot"), F.lit("P0").alias("paragraph_id"), F.col("i1").alias("start_offset"), F.col("i2").alias("end_offset"),
        F.col("removed").alias("before"), F.col("inserted").alias("after"), F.col("removed").alias("expected_text"), F.when(first & (kind == 1), F.concat(left, F.lit("?"))).otherwise(left).alias("left_context"),
        F.substring("text", F.col("i2") + 1, F.lit(100)).alias("right_context"), F.col("print").alias("paragraph_fingerprint"), F.lit(None).cast("string").alias("region_fingerprint"),
    )
    paragraphs = pairs.select(F.col("id").alias("doc_id"), F.lit("P0").alias("paragraph_id"), F.col("before").alias("text"))
    return paragraphs, written(patches, "patches"), paragraphs.select("doc_id", F.lit("C1").alias("snapshot"))


@query
def patch_batch(spark, sf_dir):
    """Texts after their batches of patches."""
    return collab.patch_batches(*_patches(spark, sf_dir))[0].select("doc_id", "text")


@query
def patch_status(spark, sf_dir):
    """Batches by state and code."""
    status = collab.patch_batches(*_patches(spark, sf_dir))[1]
    return status.groupBy("doc_id", "state").agg(F.max("code").alias("code"))


_EVENTS = f"""{_TURNS}, e0 AS (SELECT doc_id, turn, doc_id || '-' || turn AS event_id, CASE turn % 3 WHEN 0 THEN 'defer' WHEN 1 THEN 'accept' ELSE 'reject' END AS decision, CAST(doc_id AS BIGINT) % 7 AS odd FROM t WHERE role IN ('user', 'assistant')),
  e AS (SELECT * FROM e0 UNION ALL SELECT doc_id, min(turn), doc_id || '-again', 'accept', 0 FROM e0 WHERE odd = 0 GROUP BY doc_id),
  c AS (SELECT *, CASE WHEN odd = 2 OR decision = 'defer' THEN NULL WHEN count(*) FILTER (decision <> 'defer') OVER (PARTITION BY doc_id, turn) > 1 THEN 'duplicate-decision' WHEN odd = 1 THEN 'revision-text-fingerprint-mismatch' END AS code FROM e),
  s AS (SELECT *, CASE WHEN odd = 2 THEN 'already-settled' WHEN count(code) OVER (PARTITION BY doc_id) > 0 THEN 'blocked' WHEN decision = 'defer' THEN 'deferred' ELSE 'settled' END AS state FROM c)"""
_PAIRS = """p AS (SELECT conv_id, conv_id || '-' || role || '-' || turn AS id, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before, text AS after FROM conversations)"""

ORACLES = {
    "settlement_status": f"WITH {_EVENTS} SELECT doc_id, 'b' AS batch_id, event_id, state, code FROM s",
    "settlement_views": f"""WITH {_EVENTS}, d AS (SELECT doc_id, turn, any_value(decision) AS decision FROM s WHERE state = 'settled' GROUP BY ALL), j AS (SELECT t.*, d.decision FROM t LEFT JOIN d USING (doc_id, turn))
        SELECT doc_id, 'P' || k AS paragraph_id, role || CASE WHEN role = 'user' AND coalesce(decision, '') <> 'reject' THEN text WHEN role = 'assistant' AND decision = 'reject' THEN text WHEN role IN ('user', 'assistant') THEN '' ELSE '[opaque:unsupported-run]' END AS final_text,
        role || CASE WHEN role = 'user' AND decision = 'accept' THEN text WHEN role = 'assistant' AND coalesce(decision, '') <> 'accept' THEN text ELSE '' END AS original_text, CAST(role IN ('user', 'assistant') AND decision IS NULL AS BIGINT) AS n_revisions FROM j
        UNION ALL SELECT doc_id, 'B' || b || '.P0', text, text, 0 FROM t WHERE role NOT IN ('user', 'assistant')""",
    "patch_batch": f"WITH {_PAIRS} SELECT id AS doc_id, CASE WHEN conv_id % 4 < 2 THEN before ELSE after END AS text FROM p WHERE before IS NOT NULL AND after IS NOT NULL",
    "patch_status": f"WITH {_PAIRS} SELECT id AS doc_id, CASE WHEN conv_id % 4 < 2 THEN 'blocked' ELSE 'applied' END AS state, CASE conv_id % 4 WHEN 0 THEN 'patch-parent-mismatch' WHEN 1 THEN 'patch-context-mismatch' END AS code FROM p WHERE before <> after",
}
