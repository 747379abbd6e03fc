"""What one task holds doesn't grow with the tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from folioforge.operators import grid
from folioforge.sources import tables

DATA = os.environ.get("FOLIOFORGE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def most_rows(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_cells_of_more_line_items_go_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 200, raising=False)
    assert most_rows(tables.order_cells(spark, DATA)) < 3 * 3 * 200


def test_render_leaves_missing_cells_null(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.5), (1, 0, 2, None), (1, 1, 1, 2.5), (2, 0, 7, 3.5)], "t int, r int, c int, value double")
    got = grid.render_rows(cells, [0, 1, 2])
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1.5, None, None), (1, 1, None, 2.5, None), (2, 0, None, None, None)]
    assert "pivotfirst" not in got._jdf.queryExecution().toString()


def test_more_markup_goes_to_more_tasks(spark, monkeypatch):
    from folioforge.plans import structure

    monkeypatch.setattr(structure, "BYTES_A_TASK", 5_000, raising=False)
    monkeypatch.setattr(structure, "TOKENS_A_TASK", 100, raising=False)
    tokens = structure._page_tokens(spark, DATA)
    assert most_rows(tokens) < tokens.count() / 4
    rows = structure._pages(spark, DATA)
    assert most_rows(rows) < rows.count() / 4
    found = structure.markup_violations(spark, DATA)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of pages; tokens don't move


def test_units_of_both_ways_meet_without_a_broadcast(spark, monkeypatch):
    from folioforge.plans import structure

    seen, write = {}, structure.written
    monkeypatch.setattr(structure, "written", lambda df, name: seen.update({name: df}) or write(df, name))
    structure.units_round_trip(spark, DATA)
    plan = seen["styled-units"]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^\]]*pos#", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*pos#", plan)
