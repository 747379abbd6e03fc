"""Table-grid operations over cells (t, r, c, value, span); row and column numbers start at 0 and stay gapless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("t").agg(F.max("r").alias("last_r"))


def insert_row(cells: DataFrame, after: int) -> DataFrame:
    """A new empty row after ``after`` with the columns of that row; tables without that row stay."""
    moved = cells.withColumn("r", F.when(F.col("r") > after, F.col("r") + 1).otherwise(F.col("r")))
    new = cells.where(F.col("r") == after).withColumn("r", F.col("r") + 1).withColumn("value", F.lit(None).cast(cells.schema["value"].dataType)).withColumn("span", F.lit(1))
    return moved.unionByName(new)


def delete_row(cells: DataFrame, row: int) -> DataFrame:
    return cells.where(F.col("r") != row).withColumn("r", F.when(F.col("r") > row, F.col("r") - 1).otherwise(F.col("r")))


def insert_col(cells: DataFrame, after: int) -> DataFrame:
    moved = cells.withColumn("c", F.when(F.col("c") > after, F.col("c") + 1).otherwise(F.col("c")))
    new = cells.where(F.col("c") == after).withColumn("c", F.col("c") + 1).withColumn("value", F.lit(None).cast(cells.schema["value"].dataType)).withColumn("span", F.lit(1))
    return moved.unionByName(new)


def delete_col(cells: DataFrame, col: int) -> DataFrame:
    return cells.where(F.col("c") != col).withColumn("c", F.when(F.col("c") > col, F.col("c") - 1).otherwise(F.col("c")))


def merge_cells(cells: DataFrame, row: int, col: int, span: int) -> DataFrame:
    """Keep the first cell with the span; swallowed cells go, later ones move left."""
    here = F.col("r") == row
    kept = cells.where(~(here & F.col("c").between(col + 1, col + span - 1)))
    c = F.when(here & (F.col("c") >= col + span), F.col("c") - (span - 1)).otherwise(F.col("c"))
    width = F.when(here & (F.col("c") == col), F.lit(span)).otherwise(F.col("span"))
    return kept.withColumn("span", width).withColumn("c", c)


def split_cell(cells: DataFrame, row: int, col: int, parts: int) -> DataFrame:
    """The first part keeps the content with span 1, the others are empty; later cells move right."""
    here = F.col("r") == row
    moved = cells.withColumn("c", F.when(here & (F.col("c") > col), F.col("c") + parts - 1).otherwise(F.col("c")))
    moved = moved.withColumn("span", F.when(here & (F.col("c") == col), F.lit(1)).otherwise(F.col("span")))
    source = cells.where(here & (F.col("c") == col))
    new = source.withColumn("c", F.explode(F.sequence(F.lit(col + 1), F.lit(col + parts - 1))))
    return moved.unionByName(new.withColumn("value", F.lit(None).cast(cells.schema["value"].dataType)).withColumn("span", F.lit(1)))


def merge_violations(cells: DataFrame, row: int, col: int, span: int) -> DataFrame:
    """Tables where a merge would discard content, or where the row or the columns don't exist."""
    inside = (F.col("r") == row) & F.col("c").between(col, col + span - 1)
    got = cells.groupBy("t").agg(
        F.count_if(inside).alias("found"), F.count_if(inside & (F.col("c") > col) & F.col("value").isNotNull()).alias("lost")
    )
    code = F.when(F.col("found") < span, "invalid-table-reference").when(F.col("lost") > 0, "merge-would-discard-content")
    return got.select("t", code.alias("code"), "lost").where(F.col("code").isNotNull())


def render_rows(cells: DataFrame, columns: list[int]) -> DataFrame:
    """Grid render: one row per (t, r), one column per c, missing cells null."""
    return cells.groupBy("t", "r").agg(*[F.first(F.when(F.col("c") == c, F.col("value")), ignorenulls=True).alias(f"c{c}") for c in columns])
