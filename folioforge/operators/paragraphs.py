"""Paragraph rows, listings, summaries and content signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    """First twelve hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def explode_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, text): one row per newline-separated paragraph, in order; no shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))


def inventory(paragraphs: DataFrame) -> DataFrame:
    """Address, length and fingerprint of every paragraph."""
    return paragraphs.select(
        "doc_id",
        "pos",
        F.concat(F.lit("P"), F.col("pos").cast("string")).alias("paragraph_id"),
        F.length("text").alias("n_chars"),
        fingerprint(F.col("text")).alias("fingerprint"),
        (F.col("text") == "").alias("is_empty"),
    )


def listing(paragraphs: DataFrame, width: int = 60) -> DataFrame:
    """Short summaries: the first characters and the number of placeholders of each paragraph."""
    return paragraphs.select(
        "doc_id", "pos", F.substring("text", 1, width).alias("summary"), F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit("[0-9]+")).alias("n_numbers"),
    )


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraph count, characters, empty paragraphs and longest paragraph per document, computed in place."""
    parts = F.split(F.col(text), "\n")
    lengths = F.transform(parts, F.length)
    return docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"),
        F.size(parts).alias("n_paragraphs"),
        F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("n_chars"),
        F.size(F.filter(lengths, lambda x: x == 0)).alias("n_empty"),
        F.array_max(lengths).alias("longest"),
    )


def duplicate_signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal content: signature, members, first document."""
    signed = docs.where(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("signature"), F.col(doc_id).alias("doc_id"))
    groups = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first_doc"))
    return groups.where("members > 1")
