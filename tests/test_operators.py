"""Metamorphic relations and edge cases of the core operators."""

from pyspark.sql import functions as F

from folioforge.operators import grid, nodes, normalize, paragraphs, revisions, validate
from folioforge.plans.queries import QUERIES
from folioforge.streaming import review


def cells(spark):
    return spark.createDataFrame([(t, r, c, 10.0 * r + c, 1) for t in (1, 2) for r in range(3) for c in range(3)], "t long, r int, c int, value double, span int")


def rows(df):
    return sorted(map(tuple, df.select("t", "r", "c", "value", "span").collect()), key=repr)


def test_insert_then_delete_is_identity(spark):
    base = cells(spark)
    assert rows(grid.delete_row(grid.insert_row(base, 0), 1)) == rows(base)
    assert rows(grid.delete_col(grid.insert_col(base, 2), 3)) == rows(base)


def test_per_item_decisions_equal_accept_all(spark):
    nodes = spark.createDataFrame([(1, 0, "text", "s", "a"), (1, 1, "insert", "s", "b"), (1, 2, "delete", "s", "c")], "paragraph_id long, ord long, kind string, style string, text string")
    each = revisions.settle_some(nodes, nodes.select("paragraph_id", "ord", F.lit("accept").alias("decision")))
    assert sorted(map(tuple, each.select("ord", "kind", "text").collect())) == sorted(map(tuple, revisions.settle_all(nodes, True).select("ord", "kind", "text").collect()))
    assert revisions.final_view(nodes).first().final_text == "ab" and revisions.original_view(nodes).first().original_text == "ac"


def test_vertical_candidates(spark):
    docs = spark.createDataFrame([(1, "H₂O and x²"), (2, None), (3, "")], "doc_id long, text string")
    got = normalize.candidate_scan(docs, normalize.vertical_catalog()).orderBy("offset").collect()
    assert [(r.doc_id, r.occurrence_id, r.offset, r.source, r.target) for r in got] == [(1, "V00001", 1, "₂", "2"), (1, "V00002", 9, "²", "2")]


def test_occurrence_ids_beyond_five_digits(spark):
    docs = spark.range(1010).select(F.lit(1).cast("long").alias("doc_id"), F.lit("é" * 100).alias("text"))
    ids = normalize.candidate_scan(docs, normalize.accent_catalog()).select("occurrence_id")
    assert ids.distinct().count() == 101_000 and ids.where("occurrence_id IN ('V00001', 'V101000')").count() == 2


def test_conversion_to_longer_targets(spark):
    docs = spark.createDataFrame([(1, "¼ of é½"), (2, None), (3, "")], "doc_id long, text string")
    catalog = [("¼", "1/4", normalize.APPROVED), ("é", "½", normalize.APPROVED), ("½", "1/2", normalize.APPROVED)]
    got = {r.doc_id: (r.normalized, r.n_converted) for r in normalize.apply_catalog(docs, catalog).collect()}
    assert got == {1: ("1/4 of ½1/2", 3), 3: ("", 0)}


def test_character_references(spark):
    texts = {"H&#x2082;O &#233;&amp;#65; &lt;": ("H₂O é&#65; <", False), "&#9999999;&#xFFFFFFFFFF;&#xD800;": ("�" * 3, True), "&#x1F600;&nbsp;&# &": ("😀&nbsp;&# &", False), "": ("", False), None: (None, None)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nodes.unescaped(F.col("t")), nodes.bad_reference(F.col("t")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == texts


def test_fnv1a(spark):
    def expected(text):
        h = 2166136261
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 % 2**32
        return f"{h:08x}"

    texts = ["", "a", "héllo", "\U0001f600 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", validate.fnv1a_utf16(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: expected(t) for t in texts}


def test_tombstones_and_free_ids(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {tuple(r) for r in validate.tombstone_violations(ids(1, 2, 3, 4), ids(1, 2), ids(2, 3, 9)).collect()}
    assert got == {(4, "missing-tombstone"), (9, "unknown-delete"), (2, "live-and-deleted")}
    used = spark.createDataFrame([("a", 1), ("a", 3)], "g string, id int")
    free = validate.lowest_free_ids(used, spark.createDataFrame([("a",), ("b",)], "g string"), 2)
    assert sorted((r.g, r.id) for r in free.collect()) == [("a", 2), ("a", 4), ("b", 1), ("b", 2)]


def test_retention_of_every_paragraph(spark, tmp_path):
    docs = [(2, "a\nb\nc"), (3, "a\nB\nc\nd"), (4, "x\ny"), (5, "x"), (6, "only"), (9, "new\nlines")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.key, r.pos): r.outcome for r in QUERIES["retention_check"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, 0): "kept", (1, 1): "changed", (1, 2): "kept", (1, 3): "added", (2, 0): "kept", (2, 1): "removed",
        (3, 0): "removed", (4, 0): "added", (4, 1): "added",
    }


def test_decision_violations_of_all_documents(spark, tmp_path):
    spark.createDataFrame([(i, "t") for i in (1, 7, 8, 14)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (8, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in QUERIES["decision_violations"](spark, str(tmp_path)).collect())
    assert got == [(1, "decision-pending"), (8, "duplicate-decision"), (9, "revision-not-found"), (14, "decision-pending")]


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb")], "doc_id long, text string")
    assert {r.doc_id: r.n_paragraphs for r in paragraphs.summary(docs).collect()} == {2: 1, 3: 3}


def test_stream_equals_batch(spark, tmp_path):
    data = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 7, "view", float(i), "{}") for i in range(100)]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    review.run_to_table(review.latest_per_client(review.read_events(spark, str(tmp_path / "in"))), "latest", "complete", str(tmp_path / "cp"))
    got = {r.user_id: (r.event_id, r.n_events) for r in spark.table("latest").collect()}
    batch = df.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"), F.count("*").alias("n")).collect()
    assert got == {r.user_id: (r.e, r.n) for r in batch}
