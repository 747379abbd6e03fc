"""How many tasks a step is dealt to, by what its tasks must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, keys: list[str], size: int, each: int) -> DataFrame:
    """``df`` by ``keys`` over tasks of about ``each`` of its ``size``, at least one a core.

    What is later grouped, joined or ordered within ``keys`` stays where it is.  AQE
    merges no tasks of a number that was asked for, so none holds more as tables grow;
    rows of equal keys stay together.
    """
    return df.repartition(max(-(-size // each), df.sparkSession.sparkContext.defaultParallelism), *keys)
