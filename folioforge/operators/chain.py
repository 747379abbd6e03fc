"""Snapshot chains, idempotency ledgers and hash-chained journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_violations(snapshots: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Snapshots (id, parent_id) whose parent is not the snapshot before them."""
    w = Window.partitionBy(group).orderBy(*order)
    expected = F.lag("id").over(w)
    code = F.when(~F.col("parent_id").eqNullSafe(F.col("expected")), "current-parent-mismatch")
    return snapshots.withColumn("expected", expected).withColumn("code", code).where(F.col("code").isNotNull())


def ledger_replay(calls: DataFrame, order: list[str]) -> DataFrame:
    """Per operation id: the first input wins; a later different input is ``operation-id-reused``."""
    first = F.min_by("input_sha", F.struct(*order))
    got = calls.groupBy("op_id").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("input_sha").alias("inputs"), first.alias("kept_input"))
    return got.withColumn("code", F.when(F.col("inputs") > 1, "operation-id-reused").when(F.col("calls") > 1, "replayed").otherwise("recorded"))


ZEROS = "0" * 64  # fixed value: what the first record names as the one before


def record_sha(payload: Column, prev: Column) -> Column:
    """Hash of a record's content together with the hash of the record before."""
    return F.sha2(F.concat(prev, F.lit("|"), payload).cast("binary"), 256)


def journal(records: DataFrame, group: str, order: str, payload: str) -> DataFrame:
    """Records with record_sha and prev_sha: every hash covers the one before, so a change shows in all that follow.

    A journal (the records of one group) is folded in order as one array.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(payload).alias("payload"))))
    kind = records.schema[order].dataType.simpleString()
    empty = F.array().cast(f"array<struct<{order}:{kind},prev_sha:string,record_sha:string>>")

    def add(done: Column, x: Column) -> Column:
        prev = F.coalesce(F.try_element_at(done, F.lit(-1))["record_sha"], F.lit(ZEROS))
        return F.concat(done, F.array(F.struct(x[order].alias(order), prev.alias("prev_sha"), record_sha(x["payload"], prev).alias("record_sha"))))

    return records.groupBy(group).agg(F.aggregate(rows, empty, add).alias("r")).select(group, F.explode("r").alias("r")).select(group, "r.*")


def journal_violations(records: DataFrame, group: str, order: str, payload: str) -> DataFrame:
    """(group, order, code) of written records: record-hash-mismatch, and chain-broken where a record names another one before it."""
    before = F.lag("record_sha").over(Window.partitionBy(group).orderBy(order))
    rows = records.withColumn("before", before)
    code = F.when(F.col("record_sha") != record_sha(F.col(payload), F.col("prev_sha")), "record-hash-mismatch").when(F.col("prev_sha") != F.coalesce("before", F.lit(ZEROS)), "chain-broken")
    return rows.withColumn("code", code).where("code IS NOT NULL").select(group, order, "code")


def recovery(pointers: DataFrame) -> DataFrame:
    """Forward, back or needs-recovery from current, prepared and parent generation."""
    way = F.when(F.col("current") == F.col("prepared"), "forward").when(F.col("current") == F.col("parent"), "back").otherwise("needs-recovery")
    return pointers.withColumn("decision", way)
