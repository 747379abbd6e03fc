"""Comments of word packages: entries, their anchors and metadata, deletion of some, removal of all.

Defined results: comment ids are unique in a part, of repeated ones the first entry
counts; an entry without paragraphs is no comment; markers are matched by kind and
id, so a bookmark of the same id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collab import MAIN
from .nodes import KEYS, alone, attributes, shown
from .units import glued

# The part that holds comments, and what marks a comment in a text.
COMMENTS = "word/comments.xml"
MARKERS = ("comment-start", "comment-end", "commentReference")
TAGS = ("commentRangeStart", "commentRangeEnd", "commentReference")


def local(attrs: Column, name: str) -> Column:
    """Value of the attribute of this local name, '' without it."""
    found = F.filter(F.map_entries(attrs), lambda x: F.regexp_extract(x["key"], "([^:]*)$", 1) == name)
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def _entries(nested: DataFrame) -> DataFrame:
    rows = nested.where((F.col("part") == COMMENTS) & (F.col("name") == "comment") & (F.col("parent_name") == "comments") & F.col("kind").isin("open", "alone"))
    one = rows.select("doc_id", "seq", attributes(F.col("token")).alias("a")).select("doc_id", "seq", local(F.col("a"), "id").alias("comment_id"), local(F.col("a"), "author").alias("author"), local(F.col("a"), "date").alias("date"))
    return one.groupBy("doc_id", "comment_id").agg(F.min_by(F.struct("author", "date"), "seq").alias("m")).select("doc_id", "comment_id", "m.*")


def _markers(nodes: DataFrame) -> DataFrame:
    rows = nodes.where(F.col("kind").isin(*MARKERS) & F.col("cls").isin("anchor", "inline"))
    return rows.select("doc_id", "part", "paragraph_id", "seq", "kind", local(F.col("attrs"), "id").alias("comment_id"))


def listing(nested: DataFrame, paragraphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, comment_id, paragraph_id, author, date, text, anchor_paragraphs: one row for every paragraph of a comment.

    ``text`` is that of the whole comment; ``anchor_paragraphs`` are the paragraphs
    of the main part in which it begins, in order.
    """
    held = paragraphs.where(F.col("part") == COMMENTS).select(*KEYS, "paragraph_id", F.col("entry_id").alias("comment_id"))
    words = nodes.where((F.col("part") == COMMENTS) & (F.col("cls") == "text") & shown(nodes, ("delete",)))
    texts = words.join(held, [*KEYS, "paragraph_id"]).groupBy("doc_id", "comment_id").agg(glued(F.col("text"), "seq").alias("text"))
    starts = _markers(nodes).where((F.col("part") == MAIN) & (F.col("kind") == "comment-start"))
    at = F.transform(F.array_sort(F.collect_list(F.struct("seq", "paragraph_id"))), lambda x: x["paragraph_id"])
    anchors = starts.groupBy("doc_id", "comment_id").agg(at.alias("anchor_paragraphs"))
    by = ["doc_id", "comment_id"]
    rows = held.drop("part").join(_entries(nested), by, "left").join(texts, by, "left").join(anchors, by, "left")
    none = F.array().cast("array<string>")
    return rows.select(*by, "paragraph_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("author", "date", "text")], F.coalesce("anchor_paragraphs", none).alias("anchor_paragraphs"))


def violations(nested: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, comment_id, code): comments that nothing refers to, and markers of comments that aren't there."""
    marks = _markers(nodes).groupBy("doc_id", "comment_id").agg(F.collect_set("kind").alias("kinds"))
    both = _entries(nested).select("doc_id", "comment_id", F.lit(True).alias("known")).join(marks, ["doc_id", "comment_id"], "full")
    code = F.when(F.col("known").isNull(), "comment-not-found").when(F.col("kinds").isNull(), "comment-without-anchor").when(F.size("kinds") < len(MARKERS), "comment-anchor-incomplete")
    return both.select("doc_id", "comment_id", code.alias("code")).where("code IS NOT NULL")


def deleted(paragraphs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes left, tombstones (doc_id, part, paragraph_id), status) after deleting comments ``wanted(doc_id, comment_id)``.

    status: doc_id, comment_id, code (comment-not-found, or null), n_paragraphs that
    went, anchor_paragraphs that lost markers.
    """
    wanted = wanted.select("doc_id", "comment_id").distinct()
    held = paragraphs.where(F.col("part") == COMMENTS).select(*KEYS, "paragraph_id", F.col("entry_id").alias("comment_id"))
    gone = held.join(wanted, ["doc_id", "comment_id"])
    counts = gone.groupBy("doc_id", "comment_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    marks = _markers(nodes).join(counts.select("doc_id", "comment_id"), ["doc_id", "comment_id"])
    first = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "paragraph_id"))), lambda x: x["paragraph_id"])
    touched = marks.groupBy("doc_id", "comment_id").agg(F.array_distinct(first).alias("anchor_paragraphs"))
    status = wanted.join(counts, ["doc_id", "comment_id"], "left").join(touched, ["doc_id", "comment_id"], "left")
    status = status.select("doc_id", "comment_id", F.when(F.col("n_paragraphs").isNull(), "comment-not-found").alias("code"), F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("anchor_paragraphs", F.array().cast("array<string>")).alias("anchor_paragraphs"))
    tombs = gone.select(*KEYS, "paragraph_id")
    left = nodes.join(tombs, [*KEYS, "paragraph_id"], "left_anti").join(marks.select(*KEYS, "seq"), [*KEYS, "seq"], "left_anti")
    return left.select(*nodes.columns), tombs, status


def cleared(nested: DataFrame) -> DataFrame:
    """Tokens of parts without comments: no markers in any part, and an empty root in the part of comments."""
    marker = alone() & F.col("name").isin(*TAGS)
    inside = (F.col("part") == COMMENTS) & F.when(F.col("kind") == "close", F.col("opener_name") != "comments").otherwise(F.col("parent").isNotNull())
    return nested.where(~(marker | F.coalesce(inside, F.lit(False))))
