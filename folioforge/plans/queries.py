"""The engine's queries over the driver tables; SQL for each is in :mod:`folioforge.plans.oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, chain, events, grid, markup, normalize, paragraphs, revisions, units, validate
from ..sources.tables import conversation_nodes, draft_pairs, label_decisions, order_cells, table

QUERIES: dict = {}
#: Limits of the resource query (characters, paragraphs, longest paragraph).
LIMITS = {"n_chars": 4000, "n_paragraphs": 12, "longest": 1200}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def paragraph_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.inventory(paragraphs.explode_paragraphs(table(spark, sf_dir, "documents")))


@query
def paragraph_listing(spark, sf_dir):
    return paragraphs.listing(paragraphs.explode_paragraphs(table(spark, sf_dir, "documents")))


@query
def document_summary(spark, sf_dir):
    return paragraphs.summary(table(spark, sf_dir, "documents"))


@query
def duplicate_signature(spark, sf_dir):
    return paragraphs.duplicate_signatures(table(spark, sf_dir, "documents"))


@query
def tag_scan(spark, sf_dir):
    return markup.tag_scan(table(spark, sf_dir, "pages"))


@query
def tag_balance(spark, sf_dir):
    return markup.tag_balance(markup.tag_scan(table(spark, sf_dir, "pages")))


@query
def tag_depth(spark, sf_dir):
    return markup.tag_depth(markup.tag_scan(table(spark, sf_dir, "pages")))


@query
def markup_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.visible_text(F.col("html")).alias("visible"))


@query
def hyperlink_inventory(spark, sf_dir):
    return markup.hyperlinks(table(spark, sf_dir, "pages"))


@query
def opaque_inventory(spark, sf_dir):
    return markup.opaque_inventory(table(spark, sf_dir, "pages"))


@query
def attach_preceding(spark, sf_dir):
    """Every tag attached to the nearest paragraph or heading tag before it."""
    tags = markup.tag_scan(table(spark, sf_dir, "pages"))
    holder = F.col("name").isin("p", "h1", "h2", "div") & ~F.col("closing")
    return validate.attach_preceding(tags, "page_id", ["seq"], holder, F.col("seq")).select("page_id", "seq", "name", "attached_to")


@query
def anchor_pairing(spark, sf_dir):
    """Link elements as anchors: opening and closing tags numbered per page must pair up in order."""
    tags = markup.tag_scan(table(spark, sf_dir, "pages")).where("name = 'p'")
    rank = F.row_number().over(Window.partitionBy("page_id", "closing").orderBy("seq"))
    rows = tags.select("closing", F.concat_ws("-", F.col("page_id").cast("string"), rank.cast("string")).alias("id"), F.col("seq").alias("at"))
    return validate.anchor_violations(rows.where("NOT closing"), rows.where("closing"))


@query
def final_view(spark, sf_dir):
    return revisions.final_view(conversation_nodes(spark, sf_dir))


@query
def original_view(spark, sf_dir):
    return revisions.original_view(conversation_nodes(spark, sf_dir))


@query
def clean_view(spark, sf_dir):
    return revisions.clean_view(conversation_nodes(spark, sf_dir))


@query
def style_view(spark, sf_dir):
    return revisions.style_view(conversation_nodes(spark, sf_dir))


@query
def node_skeleton(spark, sf_dir):
    return revisions.skeleton(conversation_nodes(spark, sf_dir))


@query
def revision_inventory(spark, sf_dir):
    return revisions.revision_inventory(conversation_nodes(spark, sf_dir))


@query
def accept_all(spark, sf_dir):
    return revisions.settle_all(conversation_nodes(spark, sf_dir), True)


@query
def reject_all(spark, sf_dir):
    return revisions.settle_all(conversation_nodes(spark, sf_dir), False)


@query
def settle_some(spark, sf_dir):
    """Even turns are accepted, every fifth turn is rejected first."""
    nodes = conversation_nodes(spark, sf_dir)
    decision = F.when(F.col("ord") % 5 == 0, "reject").when(F.col("ord") % 2 == 0, "accept").otherwise("defer")
    return revisions.settle_some(nodes, nodes.select("paragraph_id", "ord", decision.alias("decision")))


@query
def style_weighted_mode(spark, sf_dir):
    """Conversations in tens as documents, each conversation a paragraph."""
    nodes = conversation_nodes(spark, sf_dir).withColumn("document", F.floor(F.col("paragraph_id") / 10))
    return revisions.base_style(nodes)


@query
def style_regions(spark, sf_dir):
    return revisions.style_regions(conversation_nodes(spark, sf_dir))


@query
def apply_decisions(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return revisions.apply_decisions(items, label_decisions(spark, sf_dir))


@query
def decision_violations(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return revisions.decision_violations(items, label_decisions(spark, sf_dir))


@query
def candidate_scan(spark, sf_dir):
    return normalize.candidate_scan(table(spark, sf_dir, "documents"), normalize.accent_catalog())


@query
def normalize_apply(spark, sf_dir):
    return normalize.apply_catalog(table(spark, sf_dir, "documents"), normalize.accent_catalog())


@query
def normalize_audit(spark, sf_dir):
    return normalize.audit(candidate_scan(spark, sf_dir))


@query
def unique_text_match(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return validate.text_match(items, validate.occurrences(table(spark, sf_dir, "documents"), items))


@query
def grid_insert_row(spark, sf_dir):
    return grid.insert_row(order_cells(spark, sf_dir), 0)


@query
def grid_delete_row(spark, sf_dir):
    return grid.delete_row(order_cells(spark, sf_dir), 1)


@query
def grid_insert_col(spark, sf_dir):
    return grid.insert_col(order_cells(spark, sf_dir), 1)


@query
def grid_delete_col(spark, sf_dir):
    return grid.delete_col(order_cells(spark, sf_dir), 1)


@query
def grid_merge_cells(spark, sf_dir):
    return grid.merge_cells(order_cells(spark, sf_dir), 0, 0, 2)


@query
def grid_split_cell(spark, sf_dir):
    return grid.split_cell(order_cells(spark, sf_dir), 1, 1, 3)


@query
def grid_render(spark, sf_dir):
    return grid.render_rows(order_cells(spark, sf_dir), [0, 1, 2])


@query
def merge_violations(spark, sf_dir):
    return grid.merge_violations(order_cells(spark, sf_dir), 2, 1, 2)


@query
def event_upsert_latest(spark, sf_dir):
    return events.latest_per_client(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query
def event_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("status", F.lower("event_type"))
    return events.counts_by_status(rows, "status", ["click", "purchase", "view", "signup", "error", "settled"])


@query
def event_dispatch(spark, sf_dir):
    """Events of value under 20 are drafts; they are dispatched and then acknowledged as one batch."""
    status = F.when(F.col("value") < 20, "draft").when(F.col("value") < 60, "queued").otherwise("settled")
    rows = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.lit("b0").alias("batch_id"))
    return events.acknowledge(events.dispatch(rows, F.lit("b1")), F.lit("b1"))


@query
def snapshot_chain_check(spark, sf_dir):
    """Orders of one customer as a chain: each names the customer's previous order, except those with key divisible by 50."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("id"))
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "id"))
    named = orders.withColumn("parent_id", F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(before))
    return chain.chain_violations(named, "o_custkey", ["o_orderdate", "id"]).select("o_custkey", "id", "parent_id", "expected", "code")


@query
def ledger_replay(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("op_id"), F.sha2(F.floor(F.col("value") / 10).cast("string").cast("binary"), 256).alias("input_sha"), "event_id"
    )
    return chain.ledger_replay(calls, ["event_id"])


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))
    return rows.join(chain.journal(rows, "user_id", "event_id", "payload"), ["user_id", "event_id"])


@query
def journal_chain(spark, sf_dir):
    """Events of a user as a journal of records, each of which covers the one before."""
    return _journal(spark, sf_dir).select("user_id", "event_id", "record_sha", "prev_sha")


@query
def journal_check(spark, sf_dir):
    """The same journals after every fiftieth event was altered and every ninetieth was lost."""
    rows = _journal(spark, sf_dir).where("event_id % 90 <> 1")
    altered = F.when(F.col("event_id") % 50 == 0, F.concat("payload", F.lit("?"))).otherwise(F.col("payload"))
    return chain.journal_violations(rows.withColumn("payload", altered), "user_id", "event_id", "payload")


@query
def event_drafts(spark, sf_dir):
    """Events as writes of drafts by user; a purchase sends the draft off."""
    rows = events.upserted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"], F.col("event_type") == "purchase")
    return rows.select("user_id", "draft", "event_id", "n_writes", "sent", "event_type", "value")


@query
def recovery_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 3).alias("current"), (F.col("o_orderkey") % 2).alias("prepared"), F.lit(2).cast("long").alias("parent")
    )
    return chain.recovery(rows)


@query
def resource_violations(spark, sf_dir):
    return validate.limit_violations(paragraphs.summary(table(spark, sf_dir, "documents")), "doc_id", LIMITS)


@query
def retention_check(spark, sf_dir):
    """Signatures of all paragraphs of even and odd documents as the states before and after."""
    rows = paragraphs.explode_paragraphs(table(spark, sf_dir, "documents"))
    keyed = rows.select("doc_id", F.floor(F.col("doc_id") / 2).alias("key"), "pos", paragraphs.fingerprint(F.col("text")).alias("sig"))
    return validate.retention(keyed.where("doc_id % 2 = 0"), keyed.where("doc_id % 2 = 1"), ("key", "pos"))


@query
def freshness_state(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    base, live, seen = F.col("o_custkey") % 2, F.col("o_orderkey") % 2, F.length("o_orderpriority") % 2
    return rows.select("o_orderkey", validate.freshness(base, live, seen).alias("state"))


@query
def tombstone_completeness(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    known = table(spark, sf_dir, "labels")
    live = known.where("quality = 1").select(F.col("doc_id").alias("id"))
    deleted = known.where("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("id"))
    return validate.tombstone_violations(ids, live, deleted)


@query
def lowest_free_ids(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("int").alias("id")).distinct()
    return validate.lowest_free_ids(used, used.select("g").distinct(), 2)


@query
def box_containment(spark, sf_dir):
    """Bold and line-break tags inside the byte-order range from one paragraph tag to the next (range join)."""
    tags = markup.tag_scan(table(spark, sf_dir, "pages"))
    starts = tags.where("name = 'p' AND NOT closing").select(F.col("page_id").alias("g"), F.col("seq").alias("start"))
    stop = F.coalesce(F.lead("start").over(Window.partitionBy("g").orderBy("start")), F.lit(1 << 30))
    ranges = starts.select("g", "start", stop.alias("stop"), F.col("start").alias("id"))
    points = tags.where("name IN ('b', 'br') AND NOT closing").select(F.col("page_id").alias("g"), F.col("seq").alias("at"))
    return validate.containment(points, ranges)


@query
def sync_diff(spark, sf_dir):
    """Hunks between drafts."""
    return align.text_hunks(draft_pairs(spark, sf_dir))


@query
def sync_splice(spark, sf_dir):
    """Drafts put together again from what they replaced and their hunks."""
    pairs = draft_pairs(spark, sf_dir)
    return align.spliced(pairs, align.text_hunks(pairs))


@query
def grapheme_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(units.clusters(F.coalesce("text", F.lit("")))).alias("n_units"))


@query
def utf16_fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", validate.fnv1a_utf16(F.col("text")).alias("fingerprint"))

from . import governance, review, structure, typed  # noqa: E402

QUERIES.update(structure.QUERIES | review.QUERIES | governance.QUERIES | typed.QUERIES)
