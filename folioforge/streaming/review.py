"""Review events as streams: latest state per client, status counts, exactly-once replay of operations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark: a repeated delivery is a replay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_per_client(events: DataFrame) -> DataFrame:
    """Running last event of every client (update or complete mode)."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("last"), F.count(F.lit(1)).alias("n_events")).select("user_id", "last.*", "n_events")


def counts_per_window(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by status in tumbling windows; windows close when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Process everything available into an in-memory table (tests, small state)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


DRAFT = "user_id long, draft int, event_id long, created long, updated long, n_writes long, sent boolean, event_type string, value double"
_HELD = "draft int, event_id long, created long, updated long, n_writes long, event_type string, value double"


def _drafts(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """A client's events of one trigger, in order, on the draft it has; rows of the drafts they changed."""
    events = pd.concat(list(batches)).sort_values(["micros", "event_id"])
    draft, number, created, updated, writes, kind, value = state.get if state.exists else (0, None, None, None, 0, None, None)
    out = []
    for e in events.itertuples(index=False):
        if e.sends:
            if writes:
                out.append((key[0], draft, number, created, updated, writes, True, kind, value))
            draft, number, created, updated, writes, kind, value = draft + 1, None, None, None, 0, None, None
            continue
        at = int(e.micros)
        number, created = (number, created) if writes else (int(e.event_id), at)
        updated, writes, kind, value = at, writes + 1, e.event_type, None if pd.isna(e.value) else float(e.value)
    if writes and not events.sends.iloc[-1]:
        out.append((key[0], draft, number, created, updated, writes, False, kind, value))
    state.update((draft, number, created, updated, writes, kind, value))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in DRAFT.split(", ")]).astype(object)


def upserted(events: DataFrame, sends: Column) -> DataFrame:
    """Stream form of ``operators.events.upserted``: rows of the drafts that a trigger's events made, changed or sent.

    A client's state is its open draft: a write overwrites it and keeps its id and time
    of creation, an event for which ``sends`` holds sends it off.  The last row of a
    (user_id, draft), that with most writes, sent before unsent, is what the batch
    operator gives.  Update mode.  Events of a client are taken in order of (ts,
    event_id) within a trigger, and triggers in the order they come: an event that is
    late by a trigger counts as written when it came.  A client's events of one
    trigger are held in one task; the files of a trigger bound them.  Events without
    user_id are those of one client.
    """
    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("micros"), "event_type", "value", F.coalesce(sends, F.lit(False)).alias("sends"))
    return rows.groupBy("user_id").applyInPandasWithState(_drafts, DRAFT, _HELD, "update", "NoTimeout")


def run_to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process everything available; each trigger's rows go to a folder of its own, so a trigger that runs again writes the same rows once."""
    write = lambda rows, trigger: rows.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest_drafts(rows: DataFrame) -> DataFrame:
    """What the rows of :func:`upserted` say in the end, as the batch operator says it."""
    names = ["event_id", "created", "updated", "n_writes", "sent", "event_type", "value"]
    last = rows.groupBy("user_id", "draft").agg(F.max_by(F.struct(*names), F.struct("n_writes", "sent")).alias("r")).select("user_id", "draft", "r.*")
    times = {"created_at": F.timestamp_micros("created"), "updated_at": F.timestamp_micros("updated")}
    return last.withColumns(times).select("user_id", "draft", "event_id", "created_at", "updated_at", "n_writes", "sent", "event_type", "value")
