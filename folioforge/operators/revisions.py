"""Node rows with revision kinds: views, inventory, settlement and decisions.

A node table has paragraph_id, ord, kind, text and style; kind is ``text``,
``insert``, ``delete``, ``move_to``, ``move_from`` or ``opaque``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paragraphs import fingerprint

ADDED, REMOVED = ("insert", "move_to"), ("delete", "move_from")


def joined(piece: Column, order: str = "ord", sep: str = "") -> Column:
    """Pieces of a group in document order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("piece"))))
    return F.array_join(F.transform(rows, lambda x: x["piece"]), sep)


def final_view(nodes: DataFrame) -> DataFrame:
    """Visible text with all changes applied; opaque content shows a placeholder."""
    piece = F.when(F.col("kind") == "opaque", F.concat(F.lit("[opaque:"), "style", F.lit("]"))).otherwise(F.col("text"))
    shown = nodes.where(~F.col("kind").isin(*REMOVED))
    return shown.groupBy("paragraph_id").agg(joined(piece).alias("final_text"), F.count(F.lit(1)).alias("n_nodes"))


def original_view(nodes: DataFrame) -> DataFrame:
    """Text before any change; opaque content contributes nothing."""
    shown = nodes.where(~F.col("kind").isin(*ADDED, "opaque"))
    return shown.groupBy("paragraph_id").agg(joined(F.col("text")).alias("original_text"), F.count(F.lit(1)).alias("n_nodes"))


def clean_view(nodes: DataFrame, sep: str = "\n") -> DataFrame:
    """Final view, one line per node, with a paragraph marker."""
    shown = nodes.where(~F.col("kind").isin(*REMOVED))
    body = shown.groupBy("paragraph_id").agg(joined(F.col("text"), sep=sep).alias("body"))
    return body.select("paragraph_id", F.concat(F.lit("--- "), F.col("paragraph_id").cast("string"), F.lit(" ---\n"), "body").alias("clean_text"))


def style_view(nodes: DataFrame) -> DataFrame:
    """Final view with every node wrapped in its style."""
    piece = F.concat(F.lit("["), "style", F.lit("]"), "text", F.lit("[/"), "style", F.lit("]"))
    shown = nodes.where(~F.col("kind").isin(*REMOVED))
    return shown.groupBy("paragraph_id").agg(joined(piece).alias("styled_text"))


def skeleton(nodes: DataFrame) -> DataFrame:
    """Structure without text: the ordered kinds and styles of a paragraph."""
    return nodes.groupBy("paragraph_id").agg(joined(F.concat_ws(":", "kind", "style"), sep="|").alias("skeleton"))


def revision_inventory(nodes: DataFrame) -> DataFrame:
    """Every revision with its key ``paragraph|kind|ord|fingerprint``."""
    changed = nodes.where(F.col("kind").isin(*ADDED, *REMOVED))
    key = F.concat_ws("|", F.col("paragraph_id").cast("string"), "kind", F.col("ord").cast("string"), fingerprint(F.col("text")))
    return changed.select("paragraph_id", "ord", "kind", F.col("style").alias("author"), F.length("text").alias("n_chars"), key.alias("revision_key"))


def settle_all(nodes: DataFrame, accept: bool) -> DataFrame:
    """Accept (or reject) every revision: unwrapped nodes become text, the others go."""
    gone, kept = (REMOVED, ADDED) if accept else (ADDED, REMOVED)
    kind = F.when(F.col("kind").isin(*kept), F.lit("text")).otherwise(F.col("kind"))
    return nodes.where(~F.col("kind").isin(*gone)).withColumn("kind", kind)


def settle_some(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions (paragraph_id, ord, decision): accept, reject; anything else leaves the revision."""
    d = decisions.select("paragraph_id", "ord", "decision")
    both = nodes.join(d, ["paragraph_id", "ord"], "left")
    drop = ((F.col("decision") == "accept") & F.col("kind").isin(*REMOVED)) | ((F.col("decision") == "reject") & F.col("kind").isin(*ADDED))
    done = F.col("decision").isin("accept", "reject") & F.col("kind").isin(*ADDED, *REMOVED)
    kept = both.where(~F.coalesce(drop, F.lit(False)))
    return kept.withColumn("kind", F.when(F.coalesce(done, F.lit(False)), F.lit("text")).otherwise(F.col("kind"))).drop("decision")


def base_style(nodes: DataFrame, document: str = "document") -> DataFrame:
    """(document, paragraph_id, base_style, base_chars, visible_chars): style with the most characters of the final view, ties to the first seen.

    Deleted text doesn't count, inserted text does.  A paragraph without such text has
    the base style of the one before it in its document, the first ones Normal.
    visible_chars is the text outside all revisions.
    """
    shown = F.col("kind").isin("text", *ADDED)
    sums = nodes.groupBy(document, "paragraph_id", "style").agg(F.sum(F.when(shown, F.length("text"))).alias("chars"), F.min(F.when(shown, F.col("ord"))).alias("first"), F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("plain"))
    best = F.max_by("style", F.when(F.col("first").isNotNull(), F.struct(F.col("chars"), -F.col("first"))))
    rows = sums.groupBy(document, "paragraph_id").agg(best.alias("own"), F.coalesce(F.max("chars"), F.lit(0)).alias("base_chars"), F.sum("plain").alias("visible_chars"))
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy(document).orderBy("paragraph_id"))
    return rows.select(document, "paragraph_id", F.coalesce(carried, F.lit("Normal")).alias("base_style"), "base_chars", "visible_chars")


def style_regions(nodes: DataFrame) -> DataFrame:
    """Consecutive nodes of one style merged into indexed regions."""
    w = Window.partitionBy("paragraph_id").orderBy("ord")
    starts = nodes.withColumn("new", (~F.col("style").eqNullSafe(F.lag("style").over(w))).cast("int"))
    numbered = starts.withColumn("region", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("paragraph_id", "region").agg(
        F.min("style").alias("style"), F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_nodes"), joined(F.col("text")).alias("text")
    )


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status of every item (item_id) under decisions (item_id, decision): published, not_attempted or pending."""
    status = (
        F.when(F.col("decision").isin("accept", "reject"), "published").when(F.col("decision") == "defer", "not_attempted").otherwise("pending")
    )
    joined_rows = items.join(decisions, "item_id", "left")
    return joined_rows.select("item_id", F.coalesce("decision", F.lit("none")).alias("decision"), status.alias("status"))


def decision_violations(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(item_id, code): decisions for unknown items, duplicate decisions, and items left undecided."""
    unknown = decisions.join(items, "item_id", "left_anti").select("item_id", F.lit("revision-not-found").alias("code"))
    twice = decisions.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("duplicate-decision").alias("code"))
    pending = items.join(decisions, "item_id", "left_anti").select("item_id", F.lit("decision-pending").alias("code"))
    return unknown.unionByName(twice).unionByName(pending)
