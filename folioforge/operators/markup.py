"""Tag scan, balance, visible text, hyperlinks and opaque content of markup pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns stay in the common subset of the Java and RE2 dialects.
COMMENT = r"(?s)<!--.*?-->"
TAG = r"</?[A-Za-z][A-Za-z0-9:]*[^<>]*>"
NAME = r"^</?([A-Za-z][A-Za-z0-9:]*)"
OPAQUE = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
LINK = r"(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
VOID = ("br", "hr", "img", "input", "meta", "link")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def visible_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags; white space runs become one space."""
    bare = F.regexp_replace(F.regexp_replace(without_comments(html), OPAQUE, " "), TAG, " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def tag_scan(pages: DataFrame) -> DataFrame:
    """(page_id, seq, name, closing, self_closing): the tag stream outside comments; no shuffle."""
    tags = F.regexp_extract_all(without_comments(F.col("html")), F.lit(TAG), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("seq", "tag"))
    return rows.select(
        "page_id", "seq", F.lower(F.regexp_extract("tag", NAME, 1)).alias("name"), F.startswith("tag", F.lit("</")).alias("closing"), F.endswith("tag", F.lit("/>")).alias("self_closing")
    )


def tag_balance(tags: DataFrame) -> DataFrame:
    """Names whose opening and closing tags differ in number, per page."""
    kept = tags.where(~F.col("self_closing") & ~F.col("name").isin(*VOID))
    counts = kept.groupBy("page_id", "name").agg(
        F.count_if(~F.col("closing")).alias("opened"), F.count_if(F.col("closing")).alias("closed")
    )
    return counts.where("opened <> closed")


def tag_depth(tags: DataFrame) -> DataFrame:
    """Deepest nesting per page from a running sum over the tag stream."""
    from pyspark.sql import Window

    kept = tags.where(~F.col("self_closing") & ~F.col("name").isin(*VOID))
    order = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(order)
    return kept.withColumn("depth", depth).groupBy("page_id").agg(F.max("depth").alias("max_depth"))


def hyperlinks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, href, label) of every anchor with a target."""
    found = F.regexp_extract_all(without_comments(F.col("html")), F.lit(LINK), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("seq", "anchor"))
    return rows.select("page_id", "seq", F.regexp_extract("anchor", LINK, 1).alias("href"), visible_text(F.regexp_extract("anchor", LINK, 2)).alias("label"))


def opaque_inventory(pages: DataFrame) -> DataFrame:
    """Number and characters of script and style elements per page."""
    found = F.regexp_extract_all(without_comments(F.col("html")), F.lit(OPAQUE), F.lit(0))
    return pages.select(
        "page_id", F.size(found).alias("n_opaque"), F.aggregate(F.transform(found, F.length), F.lit(0), lambda a, x: a + x).alias("opaque_chars")
    ).where("n_opaque > 0")
