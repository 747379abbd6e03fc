"""Batches of review decisions and of text patches: one violation blocks its whole batch.

Both are joins and windows over rows of many documents at once.  Statuses are
rows; what is applied is a new node or text table, so repeating a job whose
events say that they were applied changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import KEYS
from .validate import fnv1a_utf16

MAIN = "word/document.xml"  # fixed value: the part whose revisions can be settled
PLAIN_LIMIT, CONTEXT_LIMIT, NAME_LIMIT, CONTEXT = 8000, 2000, 120, 100  # fixed values: bounds of patch fields, and of compared contexts


def settlement(nodes: DataFrame, revisions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes after settlement, status of every event and batch).

    ``nodes`` and ``revisions`` are those of ``word_nodes`` and ``word_revisions``;
    ``events``: doc_id, batch_id, event_id, revision_key, decision (accept, reject or
    defer), delivery_state.  Status rows have event_id, state (settled, deferred,
    blocked, already-settled) and code; deferred events are carried forward.

    Codes: revision-outside-editable-surface (another part, or a paragraph with
    opaque content), duplicate-decision (of one revision id in the document),
    revision-not-found, revision-text-fingerprint-mismatch (kind or text differ),
    nested-decision-conflict (a decided revision lies in another decided one);
    a batch without a decision has a row without event and the code settlement-empty.
    Accepting an insertion or rejecting a deletion unwraps it, and revisions inside
    stay; the other way its content goes with all revisions inside.
    """
    part = F.split("revision_key", r"\|", 4)
    rows = events.withColumns({"part": F.get(part, F.lit(0)), "kind": F.get(part, F.lit(1)), "w_id": F.get(part, F.lit(2)), "fingerprint": F.get(part, F.lit(3))})
    done = F.col("delivery_state").isin("applied", "acknowledged")
    open_ = rows.where(~F.coalesce(done, F.lit(False)) & F.col("decision").isin("accept", "reject", "defer"))
    targets = open_.where("decision <> 'defer'")
    opaque = nodes.groupBy(*KEYS, "paragraph_id").agg(F.bool_or(F.col("cls") == "opaque").alias("opaque"))
    # a revision id is looked up in the main part; repeated ids count once, the first of them
    known = revisions.where(F.col("part") == MAIN).groupBy("doc_id", "w_id").agg(F.min_by(F.struct("paragraph_id", "seq", "kind", F.substring(F.sha2("text", 256), 1, 12).alias("print")), "seq").alias("r"))
    known = known.select("doc_id", "w_id", "r.*").withColumnRenamed("kind", "known_kind")
    known = known.join(opaque.where(F.col("part") == MAIN).drop("part"), ["doc_id", "paragraph_id"], "left")
    found = targets.join(known, ["doc_id", "w_id"], "left")
    twice = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "w_id")) > 1
    found = found.withColumn("twice", twice)
    # revisions that lie in decided ones, by the ids on their paths
    wraps = nodes.where((F.col("cls") == "revision") & (F.size("rev_path") > 0)).select("doc_id", "seq", F.explode("rev_path").alias("outer")).select("doc_id", "seq", F.col("outer.seq").alias("outer"))
    decided = found.where("seq IS NOT NULL").select("doc_id", "seq").distinct()
    nested = wraps.join(decided, ["doc_id", "seq"]).join(decided.withColumnRenamed("seq", "outer"), ["doc_id", "outer"])
    inside = nested.select("doc_id", "seq").union(nested.select("doc_id", "outer")).distinct().withColumn("nested", F.lit(True))
    found = found.join(inside, ["doc_id", "seq"], "left")
    code = (
        F.when(F.col("part") != MAIN, "revision-outside-editable-surface").when(F.col("twice"), "duplicate-decision").when(F.col("seq").isNull(), "revision-not-found")
        .when(F.coalesce("opaque", F.lit(False)), "revision-outside-editable-surface").when(F.col("nested"), "nested-decision-conflict")
        .when((F.col("kind") != F.col("known_kind")) | (F.col("fingerprint") != F.col("print")), "revision-text-fingerprint-mismatch")
    )
    found = found.withColumn("code", code)
    blocked = found.where("code IS NOT NULL").select("doc_id", "batch_id").distinct().withColumn("blocked", F.lit(True))
    judged = found.select("doc_id", "batch_id", "event_id", "decision", "code", "seq", "known_kind").unionByName(
        open_.where("decision = 'defer'").select("doc_id", "batch_id", "event_id", "decision", F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("known_kind"))
    )
    judged = judged.join(blocked, ["doc_id", "batch_id"], "left")
    state = F.when(F.col("blocked"), "blocked").when(F.col("decision") == "defer", "deferred").otherwise("settled")
    judged = judged.withColumn("state", state)
    past = rows.where(done).select("doc_id", "batch_id", "event_id", F.lit("already-settled").alias("state"), F.lit(None).cast("string").alias("code"))
    empty = rows.groupBy("doc_id", "batch_id").agg(F.bool_or(done | F.col("decision").isin("accept", "reject", "defer")).alias("some")).where("NOT coalesce(some, false)")
    status = judged.select("doc_id", "batch_id", "event_id", "state", "code").unionByName(past)
    status = status.unionByName(empty.select("doc_id", "batch_id", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit("blocked").alias("state"), F.lit("settlement-empty").alias("code")))
    applied = judged.where("state = 'settled'").select("doc_id", "seq", "decision", "known_kind")
    return settle_nodes(nodes, applied), status


def settle_nodes(nodes: DataFrame, applied: DataFrame) -> DataFrame:
    """Nodes after decisions (doc_id, seq of the revision, decision, known_kind) on revisions of the main part."""
    adds = F.col("known_kind").isin("insert", "move_to")
    lost = (F.col("decision") == "accept") != adds
    per = applied.groupBy("doc_id").agg(F.collect_set(F.when(lost, F.col("seq"))).alias("lost"), F.collect_set(F.when(~lost, F.col("seq"))).alias("bare"))
    rows = nodes.join(per, "doc_id", "left")
    main, none = F.col("part") == MAIN, F.array().cast("array<int>")
    gone, bare = F.coalesce("lost", none), F.coalesce("bare", none)
    wraps = F.transform("rev_path", lambda x: x["seq"])
    drop = main & (F.arrays_overlap(wraps, gone) | ((F.col("cls") == "revision") & (F.array_contains(gone, F.col("seq")) | F.array_contains(bare, F.col("seq")))))
    kept = rows.where(~drop)
    left = F.filter("rev_path", lambda x: ~F.array_contains(F.when(main, bare).otherwise(none), x["seq"]))
    path = F.array_except("path", F.when(main, bare).otherwise(none))
    return kept.withColumns({"rev_path": left, "path": path}).select(*nodes.columns)


def patch_shape(p: dict[str, Column] | None = None) -> Column:
    """Code of the first broken rule of a patch's own fields."""
    c = F.col
    none, start, end = F.lit(""), c("start_offset"), c("end_offset")
    before, after = F.coalesce("before", none), F.coalesce("after", none)
    expected, left, right = (F.coalesce(x, none) for x in ("expected_text", "left_context", "right_context"))
    long = lambda x, n: F.length(F.coalesce(x, none)) > n
    return (
        F.when(~F.coalesce(c("origin").isin("human_ui", "human_external", "agent"), F.lit(False)), "patch-origin").when(long("parent_snapshot", NAME_LIMIT) | long("paragraph_id", NAME_LIMIT), "patch-too-large")
        .when((F.coalesce("parent_snapshot", none) == "") | (F.coalesce("paragraph_id", none) == ""), "patch-target").when(start.isNull() | end.isNull() | (start < 0) | (end < start), "patch-range")
        .when((F.length(before) > PLAIN_LIMIT) | (F.length(after) > PLAIN_LIMIT) | (F.length(expected) > PLAIN_LIMIT), "patch-too-large").when(before != expected, "patch-precondition")
        .when((start == end) != (before == ""), "patch-range").when((F.length(left) > CONTEXT_LIMIT) | (F.length(right) > CONTEXT_LIMIT), "patch-too-large")
    )


def patch_batches(paragraphs: DataFrame, patches: DataFrame, current: DataFrame, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paragraphs with their new text, status of every patch).

    ``paragraphs``: doc_id, paragraph_id, text.  ``patches``: doc_id, batch_id,
    event_id, step (order in the batch), origin, parent_snapshot, staged_snapshot,
    paragraph_id, start_offset, end_offset, before, after, expected_text,
    left_context, right_context, paragraph_fingerprint, region_fingerprint; offsets
    are code points.  ``current``: doc_id, snapshot.  ``regions``: doc_id,
    paragraph_id, start, stop of stretches of one style.

    Codes, the first that fits: those of :func:`patch_shape`; patch-parent-mismatch
    (the parent is not the snapshot the patch before it made, or the current one);
    patch-target (no such paragraph), patch-precondition, patch-context-mismatch,
    patch-fingerprint-mismatch, cross-region-text; patch-overlap (a patch begins
    before an earlier one ends, or two insertions at one place), patch-noop (no
    patch of the batch changes anything).  One code blocks the batch.
    """
    w = Window.partitionBy("doc_id", "batch_id").orderBy("step", "event_id")
    rows = patches.withColumn("shape", patch_shape()).join(current, "doc_id", "left").join(paragraphs.select("doc_id", "paragraph_id", "text", F.concat(F.lit("fnv1a-"), fnv1a_utf16(F.col("text"))).alias("text_print")), ["doc_id", "paragraph_id"], "left")
    # a patch that makes no snapshot leaves the expected parent as it was
    last = F.last(F.col("staged_snapshot"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("expected_parent", F.coalesce(last, F.col("snapshot")))
    start, end, before = F.col("start_offset"), F.col("end_offset"), F.coalesce("before", F.lit(""))
    held = F.substring("text", start + 1, end - start)
    left = F.substring("text", F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
    right = F.substring("text", end + 1, F.lit(CONTEXT))
    none = F.lit("")
    prints = lambda name, of: (F.coalesce(name, none) != "") & (F.col(name) != of)
    order = Window.partitionBy("doc_id", "batch_id", "paragraph_id").orderBy("start_offset", "end_offset", "step", "event_id")
    rows = rows.withColumns({"reached": F.max("end_offset").over(order.rowsBetween(Window.unboundedPreceding, -1)), "last_start": F.lag("start_offset").over(order), "changes": F.max((before != F.coalesce("after", none)).cast("int")).over(Window.partitionBy("doc_id", "batch_id"))})
    if regions is None:
        rows = rows.withColumn("touched", F.lit(1))
    else:
        r = regions.select("doc_id", "paragraph_id", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
        hit = rows.join(r, ["doc_id", "paragraph_id"]).where((F.col("r_start") < end) & (start < F.col("r_stop"))).groupBy("doc_id", "batch_id", "event_id").agg(F.count(F.lit(1)).alias("touched"))
        rows = rows.join(hit, ["doc_id", "batch_id", "event_id"], "left")
    code = (
        F.when(F.col("shape").isNotNull(), F.col("shape")).when(~F.col("parent_snapshot").eqNullSafe(F.col("expected_parent")), "patch-parent-mismatch").when(F.col("text").isNull(), "patch-target")
        .when(held != before, "patch-precondition").when((left != F.coalesce("left_context", none)) | (right != F.coalesce("right_context", none)), "patch-context-mismatch")
        .when(prints("paragraph_fingerprint", F.col("text_print")) | prints("region_fingerprint", F.concat(F.lit("fnv1a-"), fnv1a_utf16(before))), "patch-fingerprint-mismatch").when((before != "") & (F.col("touched") > 1), "cross-region-text")
        .when((start < F.col("reached")) | ((start == F.col("last_start")) & (start == end)), "patch-overlap").when(F.col("changes") == 0, "patch-noop")
    )
    rows = rows.withColumn("code", code)
    rows = rows.withColumn("blocked", F.max(F.col("code").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "batch_id")) == 1)
    status = rows.select("doc_id", "batch_id", "event_id", F.when(F.col("blocked"), "blocked").otherwise("applied").alias("state"), "code")
    good = rows.where("NOT blocked").groupBy("doc_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", F.coalesce("after", none).alias("after")))).alias("h"))
    return paragraphs.join(good, ["doc_id", "paragraph_id"], "left").withColumn("text", with_splices(F.col("text"), F.coalesce("h", F.array()))).drop("h"), status


def with_splices(text: Column, patches: Column) -> Column:
    """``text`` with ordered (start_offset, end_offset, after) put in, all at once."""
    stops = F.concat(F.array(F.lit(0)), F.transform(patches, lambda x: x["end_offset"].cast("int")))
    kept = F.transform(patches, lambda x, k: F.concat(F.substring(text, F.get(stops, k) + 1, x["start_offset"].cast("int") - F.get(stops, k)), x["after"]))
    return F.concat(F.array_join(kept, ""), F.substring(text, F.try_element_at(stops, F.lit(-1)) + 1, F.length(text)))
