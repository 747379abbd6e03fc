"""Review events in batch: upsert, dispatch, acknowledge, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: event type → status of the review event it stands for
STATUSES = ("draft", "queued", "acknowledged", "settled", "rejected")


def latest_per_client(events: DataFrame, client: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each client; one map-side combined aggregation, no window."""
    last = events.groupBy(client).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n_events"))
    return last.select(client, *[F.col(f"last.{c}").alias(c) for c in columns], "n_events")


def upserted(events: DataFrame, client: str, order: list[str], columns: list[str], sends: Column) -> DataFrame:
    """(client, draft, event_id, created_at, updated_at, n_writes, sent, columns): what becomes of a client's writes.

    A write overwrites the client's draft while there is one and keeps its id and
    time of creation; ``sends`` marks events that send the draft off, after which the
    next write makes a new one.  ``events`` has event_id and ts.
    """
    w = Window.partitionBy(client).orderBy(*order)
    draft = F.coalesce(F.sum(sends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("draft", draft).withColumn("sends", sends)
    write, at = ~F.col("sends"), F.struct(*order)
    got = rows.groupBy(client, "draft").agg(
        F.min_by("event_id", F.when(write, at)).alias("event_id"), F.min_by("ts", F.when(write, at)).alias("created_at"), F.max_by("ts", F.when(write, at)).alias("updated_at"), F.count_if(write).alias("n_writes"), F.bool_or("sends").alias("sent"),
        F.max_by(F.struct(*columns), F.when(write, at)).alias("last"),
    )
    return got.where("n_writes > 0").select(client, "draft", "event_id", "created_at", "updated_at", "n_writes", "sent", *[F.col(f"last.{c}").alias(c) for c in columns])


def counts_by_status(events: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """Number of events for every status of the domain, zeros included."""
    known = events.sparkSession.createDataFrame([(s,) for s in domain], "status string")
    got = events.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(got, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dispatch(events: DataFrame, batch_id: Column) -> DataFrame:
    """Drafts become queued under one batch id."""
    draft = F.col("status") == "draft"
    return events.withColumn("batch_id", F.when(draft, batch_id).otherwise(F.col("batch_id"))).withColumn("status", F.when(draft, F.lit("queued")).otherwise(F.col("status")))


def acknowledge(events: DataFrame, batch_id: Column) -> DataFrame:
    """Queued events of the batch become acknowledged; repeating it changes nothing and drafts stay."""
    mine = (F.col("status") == "queued") & (F.col("batch_id") == batch_id)
    return events.withColumn("status", F.when(mine, F.lit("acknowledged")).otherwise(F.col("status")))
