"""Driver tables and their projection onto the document model (synthetic, documented in the README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tasks import dealt

#: Line items that one task holds as cells.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nodes: user → insert, assistant → delete, anything else → text; the role is the style."""
    kind = F.when(F.col("role") == "user", "insert").when(F.col("role") == "assistant", "delete").otherwise("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("paragraph_id"), F.col("turn").alias("ord"), kind.alias("kind"), F.col("role").alias("style"), F.coalesce("text", F.lit("")).alias("text")
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables, line items as rows, three measures as columns."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    rows = dealt(items, ["l_orderkey"], items.count(), ROWS_A_TASK).select("l_orderkey", (F.row_number().over(w) - 1).alias("r"), "l_quantity", "l_extendedprice", "l_discount")
    cells = "stack(3, 0, l_quantity, 1, l_extendedprice, 2, l_discount) as (c, value)"
    return rows.selectExpr("l_orderkey as t", "r", cells).withColumn("span", F.lit(1))


def label_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxic → reject, else good quality → accept, else defer."""
    decision = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("defer")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), decision.alias("decision"))


def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as main parts of word packages (doc_id, part, xml): a turn is a paragraph that begins with its role.

    A user's text is inserted, an assistant's is deleted, any other lies in a text box.
    """
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    run = lambda x, tag="t": F.concat(F.lit(f"<w:r><w:{tag}>"), x, F.lit(f"</w:{tag}></w:r>"))
    wrap = lambda name, x: F.concat(F.lit(f"<w:{name} w:id=\""), F.col("turn").cast("string"), F.lit("\" w:author=\""), "role", F.lit("\">"), x, F.lit(f"</w:{name}>"))
    box = F.concat(F.lit("<w:r><w:pict><w:txbxContent><w:p>"), run(text), F.lit("</w:p></w:txbxContent></w:pict></w:r>"))
    content = F.when(F.col("role") == "user", wrap("ins", run(text))).when(F.col("role") == "assistant", wrap("del", run(text, "delText"))).otherwise(box)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<w:p>"), run(F.col("role")), content, F.lit("</w:p>")).alias("p"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "")
    parts = turns.groupBy("conv_id").agg(body.alias("body"))
    xml = F.concat(F.lit("<w:document><w:body>"), "body", F.lit("</w:body></w:document>"))
    return parts.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("word/document.xml").alias("part"), xml.alias("xml"))


def draft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of one role in a conversation as drafts of one paragraph (id, before, after)."""
    rows = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), "role", F.col("turn").cast("string")).alias("id"), F.lag("text").over(w).alias("before"), F.col("text").alias("after"))


def commented_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as main parts and parts of comments (doc_id, part, xml).

    A turn is a paragraph that says its role; a user's or assistant's has the markers
    of a comment, and the texts of all but users are comments.
    """
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turn = F.concat(F.lit(' w:id="'), F.col("turn").cast("string"), F.lit('"'))
    run = lambda x: F.concat(F.lit("<w:r><w:t>"), x, F.lit("</w:t></w:r>"))
    tag = lambda name: F.concat(F.lit(f"<w:{name}"), turn, F.lit("/>"))
    spoken = F.col("role").isin("user", "assistant")
    said = F.when(spoken, F.concat(tag("commentRangeStart"), run(F.col("role")), tag("commentRangeEnd"), F.lit("<w:r>"), tag("commentReference"), F.lit("</w:r>"))).otherwise(run(F.col("role")))
    entry = F.concat(F.lit("<w:comment"), turn, F.lit(' w:author="'), "role", F.lit('" w:date="2024-01-01T00:00:00Z"><w:p>'), run(text), F.lit("</w:p></w:comment>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<w:p>"), said, F.lit("</w:p>")).alias("p"), F.when(F.col("role") != "user", entry).otherwise("").alias("c"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p", "c"))).alias("r"))
    glue = lambda k: F.array_join(F.transform("r", lambda x: x[k]), "")
    main = F.struct(F.lit("word/document.xml").alias("part"), F.concat(F.lit("<w:document><w:body>"), glue("p"), F.lit("</w:body></w:document>")).alias("xml"))
    notes = F.struct(F.lit("word/comments.xml").alias("part"), F.concat(F.lit("<w:comments>"), glue("c"), F.lit("</w:comments>")).alias("xml"))
    return both.select(F.col("conv_id").cast("string").alias("doc_id"), F.explode(F.array(main, notes)).alias("x")).select("doc_id", "x.*")
