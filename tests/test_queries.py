"""Every registered query against its DuckDB equivalent, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from bulwark.plans.registry import ORACLES, QUERIES
from tools.check import connect, matches

# A window in one task over something unaggregated.
ONE_TASK_WINDOW = r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition"
# Offsets of file blocks: one short row per block.
SHORT_TABLE_WINDOWS = ("golden_records", "offline_records")


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in SHORT_TABLE_WINDOWS or not re.search(ONE_TASK_WINDOW, plan)
    ok, message = matches(df, con, name)
    assert ok, message


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert "bucket_start" in df.columns and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
