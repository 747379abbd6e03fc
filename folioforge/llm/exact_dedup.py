"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Every text is cut where its own content says so, each chunk gets a verified
identifier, and texts are compared as ordered identifier lists.  A chunk's bytes
cross the network at most once per map task that holds it (map-side combined);
whole documents never move.

Defined results: null text counts as empty; all empty texts are equal; repeated
rows of one doc_id are rows of their group (``group_size`` counts rows, every
row with the largest doc_id is kept, but ``drop_exact_copies`` leaves one of
them); a null doc_id never outranks another; an
empty table gives an empty table; other columns of ``docs`` don't matter,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, named, once_each, rows_marked, text_bytes

#: A chunk has MIN_CHUNK..MAX_CHUNK characters and ends after the first boundary character past the minimum.
MIN_CHUNK, MAX_CHUNK = 768, 8192
BOUNDARY = r"[\n.!?]"


def chunk_array(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Ordered chunks whose concatenation is the text; cut places depend on content only."""
    pattern = rf"(?s).{{{least - 1},{most - 1}}}?{BOUNDARY}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def shared_identifiers(chunks: DataFrame) -> DataFrame:
    """(h): hashes that several different chunk contents share.

    This is the verification: chunks are grouped by hash *and* full content, so a
    hash left with more than one group is not an identifier by itself.
    """
    distinct = chunks.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    # only the hashes travel on, not the contents
    return distinct.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hasher=chunk_hash) -> DataFrame:
    """(doc_id, text_sha256, recipe, contents): recipe is the ordered list of chunk identifiers.

    ``contents`` is null unless some identifier of the text stands for several
    contents; then it lists those chunks in order.  Two texts are equal exactly
    when both columns are.
    """
    body = F.coalesce(named(text), F.lit(""))
    chunks = docs.select(F.explode(chunk_array(body)).alias("chunk")).select(hasher(F.col("chunk")).alias("h"), "chunk")
    clash = materialize(shared_identifiers(chunks), "chunk-clash")
    base = [named(doc_id).alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("text_sha256")]
    ids = F.transform(chunk_array(body), hasher).alias("recipe")
    none = F.lit(None).cast("array<string>").alias("contents")
    if clash.isEmpty():
        return docs.select(*base, ids, none)
    # Rare: texts with such a chunk carry the chunk's content in their key.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *base, chunk_array(body).alias("all"))
    parts = numbered.select("row", "doc_id", "text_sha256", F.posexplode_outer("all").alias("pos", "chunk"))
    parts = parts.withColumn("h", hasher(F.col("chunk"))).join(clash.withColumn("shared", F.lit(True)), "h", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "h", F.when(F.col("shared"), F.col("chunk")).alias("content")))
    items = parts.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(item)).alias("items"))
    shown = F.array_compact(F.transform("items", lambda x: x["content"]))
    return items.select(
        "doc_id", "text_sha256", F.transform("items", lambda x: x["h"]).alias("recipe"), F.when(F.size(shown) > 0, shown).alias("contents")
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hasher=chunk_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(recipes(docs, doc_id, text, hasher), "recipes")
    groups = rows.groupBy("recipe", "contents").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Most texts are alone; only the recipes of real groups meet their rows again, and rows of a hot recipe don't move.
    whole = lambda: F.struct("recipe", F.coalesce("contents", F.array().cast("array<string>")).alias("contents")).alias("key")
    several = groups.where("group_size > 1").select(whole(), "keep_id", "group_size", F.col("group_size").alias("uses"))
    found = join_by_key(rows.select("doc_id", "text_sha256", whole()), several, "key", "uses", rows.count())
    return found.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.coalesce("keep_id", "doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) whose text no row with a larger doc_id repeats; one of rows that repeat both.

    Rows with a null doc_id stay.
    """
    rows = materialize(exact_groups(docs.select(named(doc_id), named(text)), doc_id, text), "exact-rows")
    mark = F.sha2(text_bytes(text), 256)
    left = rows_marked(docs, rows.where("NOT kept").select("doc_id", F.col("text_sha256").alias("mark")).distinct(), doc_id, mark, "left_anti")
    kept = rows.where("kept AND doc_id IS NOT NULL AND group_size > 1").groupBy("doc_id", F.col("text_sha256").alias("mark"))
    return once_each(left, kept.agg(F.count(F.lit(1)).alias("n")).where("n > 1"), doc_id, mark)
