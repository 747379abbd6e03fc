"""The stateful stream of review drafts equals the batch operator, over split files and across a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from folioforge.operators import events as batch
from folioforge.streaming import review

SENDS = "event_type = 'send'"


def events_of(spark, rng, n):
    start = dt.datetime(2024, 1, 1)
    kinds = ["edit", "edit", "comment", "send", None]
    rows = [(i, start + dt.timedelta(seconds=i // 3), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), rng.choice([None, float(i)]), "{}") for i in range(n)]
    return rows, spark.createDataFrame(rows, review.EVENT)


def test_stream_with_restart_equals_batch(spark, tmp_path):
    rows, every = events_of(spark, random.Random(3), 240)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda: review.run_to_parquet(review.upserted(review.read_events(spark, source, 1), F.expr(SENDS)), out, checkpoint)
    spark.createDataFrame([], review.EVENT).write.parquet(source)
    for k in range(0, 240, 60):
        spark.createDataFrame(rows[k : k + 60], review.EVENT).coalesce(1).write.mode("append").parquet(source)
        if k in (60, 180):
            run()  # the second run goes on from the checkpoint of the first
    got = review.latest_drafts(spark.read.parquet(out))
    want = batch.upserted(every, "user_id", ["ts", "event_id"], ["event_type", "value"], F.coalesce(F.expr(SENDS), F.lit(False)))
    assert got.columns == want.columns
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    found = key(got.collect())
    assert found == key(want.collect()) and len(found) > 20
    changed = spark.read.parquet(out).groupBy("user_id", "draft").count().where("count > 1")
    assert not changed.isEmpty()  # some drafts lived through more than one trigger
