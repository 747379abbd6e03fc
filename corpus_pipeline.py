"""The training-data pipeline: STAGES over ``documents``, and ``run`` that applies them.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.  ``run``
writes each stage's result as Parquet into the shared folder and reads it again
as the next one's input.  Stages are judged on whole texts: rejected documents
go, of equal texts the row with the largest doc_id stays, of each near-duplicate
component the smallest doc_id stays, and what is left is packed.

All stages: null texts are empty texts; a null doc_id is judged like any other
and never dropped as a copy; of rows that repeat both id and text, the
classifiers keep or drop all, the dedup stages keep one; an empty table stays
empty; columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import quality, toxicity
from folioforge.llm.common import materialize, named, read_table, split_remainder
from folioforge.llm.exact_dedup import drop_exact_copies
from folioforge.llm.near_dedup import drop_near_copies
from folioforge.llm.packing import pack_documents


def _accepted(spark: SparkSession, docs: DataFrame, sf_dir: str, module, label: int) -> DataFrame:
    """Rows of ``docs`` whose predicted label is ``label``, by a classifier fitted on its rows that are not held out."""
    model = module.fit(docs.where(split_remainder(3) != 1), read_table(spark, sf_dir, "labels"))
    names = tuple("_" * max(map(len, docs.columns)) + n for n in ("score", "predicted"))  # no column is called so
    scored = module.score_documents(docs, model, docs.columns, names=names)
    return scored.where(named(names[1]) == label).select(*map(named, docs.columns))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted good (score >= 0.5); without labels every score is 0.5, so all stay."""
    return _accepted(spark, docs, sf_dir, quality, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic (score < 0.7); without a confirmed toxic text every score is 0, so all stay."""
    return _accepted(spark, docs, sf_dir, toxicity, 0)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are one group."""
    return drop_exact_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id; texts without words are no copies of one another."""
    return drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; ties between bins of equal room don't change the number of bins."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: The classifiers and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
