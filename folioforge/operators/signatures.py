"""Semantic signatures of packages, their comparison under a consumer's rules, and verification of written output.

A signature is rows (doc_id, dimension, item, n): what a package says, not how its
bytes lie.  Revision marks are known by kind, author and date, never by their
ids, which consumers renumber; order and file layout don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nodes as N

# What each consumer must keep exactly, and where it may add.
RULES = {
    "word-windows-m365": {"exact": ("visible_text", "deleted_text", "revision_marks", "comments", "relationships"), "relaxed": ("bookmarks", "comment_parts")},
    "strict": {"exact": ("visible_text", "deleted_text", "revision_marks", "comments", "comment_parts", "bookmarks", "relationships"), "relaxed": ()},
}
DIMENSIONS = RULES["strict"]["exact"]


def signature_items(nested: DataFrame, members: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Signature rows from nested tokens of the word parts, member names (doc_id, part) and relationships.

    Texts are one item each, the hash of all text of the parts in order of their
    names; bookmarks count once per name.
    """
    words = nested.where(F.col("kind").isin("text", "cdata") & F.col("parent_name").isin("t", "delText"))
    glue = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "token"))), lambda x: x["token"]), "")
    kind = F.when(F.col("parent_name") == "t", "visible_text").otherwise("deleted_text").alias("dimension")
    texts = words.groupBy("doc_id", kind).agg(F.sha2(glue.cast("binary"), 256).alias("item"), F.lit(1).cast("long").alias("n"))
    tags = nested.where(N.element()).withColumn("a", N.attributes(F.col("token")))
    value = lambda name: F.coalesce(F.col("a")[name], F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in N.REVISIONS.items() for x in pair])[F.col("name")]
    marks = tags.where(F.col("name").isin(*N.REVISIONS)).select("doc_id", F.lit("revision_marks").alias("dimension"), F.concat_ws(":", names, value("w:author"), value("w:date")).alias("item"))
    bookmarks = tags.where("name = 'bookmarkStart'").select("doc_id", F.lit("bookmarks"), value("w:name").alias("item")).distinct()
    # a comment's text is that of the tokens inside its element
    chained = N.with_chain(nested.where("part = 'word/comments.xml'"), N.KEYS, ["comment"], F.struct("seq", "token"))
    top = F.try_element_at("chain", F.lit(-1))
    inside = chained.where(top.isNotNull()).select("doc_id", top["seq"].alias("c"), top["token"].alias("head"), "seq", F.when(F.col("kind").isin("text", "cdata") & (F.col("parent_name") == "t"), F.col("token")).alias("token"))
    said = inside.groupBy("doc_id", "c", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("seq", "token")))), lambda x: x["token"]), "").alias("text"))
    head = N.attributes(F.col("head"))
    comments = said.select("doc_id", F.lit("comments"), F.concat_ws(":", F.coalesce(head["w:id"], F.lit("")), F.coalesce(head["w:author"], F.lit("")), "text"))
    low = F.lower("part")
    parts = members.where(low.contains("comment") | low.contains("people")).select("doc_id", F.lit("comment_parts"), "part")
    listed = marks.union(bookmarks).union(comments).union(parts)
    if links is not None:
        listed = listed.union(links.select("doc_id", F.lit("relationships"), F.concat_ws(":", "rel_id", "type", "target")))
    return texts.unionByName(listed.groupBy("doc_id", "dimension", "item").agg(F.count(F.lit(1)).alias("n")))


def signature_digests(items: DataFrame) -> DataFrame:
    """(doc_id, dimension, digest): one hash per dimension, whatever the order of its items."""
    pairs = F.array_sort(F.collect_list(F.concat_ws("*", F.col("n").cast("string"), "item")))
    return items.groupBy("doc_id", "dimension").agg(F.sha2(F.array_join(pairs, "\n").cast("binary"), 256).alias("digest"))


def retention_violations(before: DataFrame, after: DataFrame, consumer: str = "strict") -> DataFrame:
    """(doc_id, dimension, code, n_items): changed where an exact dimension differs, lost where a relaxed one lacks items.

    Of relaxed relationships only targets outside the package have to stay, under
    any id.  Dimensions under no rule are ignored.
    """
    rule = RULES[consumer]
    both = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), ["doc_id", "dimension", "item"], "full")
    exact = both.where(F.col("dimension").isin(*rule["exact"]) & ~F.col("a").eqNullSafe(F.col("b"))).groupBy("doc_id", "dimension").agg(F.lit("changed").alias("code"), F.count(F.lit(1)).alias("n_items"))
    if not rule["relaxed"]:
        return exact
    pair = F.regexp_replace("item", "^[^:]*:", "")
    outside = pair.contains("hyperlink") | pair.rlike(":(http|mailto)[^:]*(:.*)?$")

    def kept(items: DataFrame) -> DataFrame:
        rows = items.where(F.col("dimension").isin(*rule["relaxed"]) & ((F.col("dimension") != "relationships") | outside))
        return rows.select("doc_id", "dimension", F.when(F.col("dimension") == "relationships", pair).otherwise(F.col("item")).alias("item")).distinct()

    lost = kept(before).join(kept(after), ["doc_id", "dimension", "item"], "left_anti")
    return exact.union(lost.groupBy("doc_id", "dimension").agg(F.lit("lost").alias("code"), F.count(F.lit(1)).alias("n_items")))


def output_violations(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, part, paragraph_id, code): where re-read output differs from what was to be written.

    Both sides are rows of ``word_views``.  Codes: paragraph-missing,
    paragraph-added, final-text-differs, original-text-differs, revisions-differ.
    """
    keys = [*N.KEYS, "paragraph_id"]
    side = lambda df, p: df.select(*keys, F.col("final_text").alias(p + "f"), F.col("original_text").alias(p + "o"), F.col("n_revisions").alias(p + "n"))
    both = side(expected, "e").join(side(found, "x"), keys, "full")
    code = (
        F.when(F.col("xf").isNull(), "paragraph-missing").when(F.col("ef").isNull(), "paragraph-added").when(F.col("ef") != F.col("xf"), "final-text-differs")
        .when(F.col("eo") != F.col("xo"), "original-text-differs").when(F.col("en") != F.col("xn"), "revisions-differ")
    )
    return both.withColumn("code", code).where("code IS NOT NULL").select(*keys, "code")
