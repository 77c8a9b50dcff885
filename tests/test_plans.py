"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bulwark.operators import chain, history, messages, metrics
from bulwark.plans import fixtures as fx
from bulwark.sources import tables


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single|Round)", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, data_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "requests")
    tables.append_requests(fx.requests(spark, data_dir), path)
    return spark.read.parquet(path)


def test_history_prunes_days_and_columns_and_pushes_filters(stored):
    df = history.score_history(stored, "1", "2024-01-05 10:00:00", "2024-01-06 10:00:00", True, "toxicity")
    text = plan(df.select("id", "score_toxicity"))
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], Pushed", text, re.S).group(1)
    assert "dt" in partition_filters and "2024-01-05" in partition_filters and "2024-01-06" in partition_filters
    assert "EqualTo(tenant_id,1)" in text and "EqualTo(flag_toxicity,true)" in text
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "input_text" not in schema and "score_pii" not in schema


def test_day_pruning_keeps_the_result(spark, stored, data_dir):
    with_days = history.score_history(stored, "1", "2024-01-05 10:00:00", "2024-01-06 10:00:00")
    without = history.score_history(fx.requests(spark, data_dir), 1, "2024-01-05 10:00:00", "2024-01-06 10:00:00")
    assert with_days.count() == without.count() > 0


def test_bucket_metrics_shuffle_once_and_read_what_they_need(stored):
    df = metrics.time_buckets(stored, "2024-01-31 00:00:00", "7d")
    text = plan(df)
    assert exchanges(df) == 1 and "2024-01-24" in re.search(r"PartitionFilters: \[(.*?)\], Pushed", text, re.S).group(1)
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "input_text" not in schema and "latency_pii" not in schema


def test_replay_and_assembly_share_one_shuffle(spark, data_dir):
    assert exchanges(chain.assemble(chain.replay(fx.eval_calls(spark, data_dir)))) == 1
    assert exchanges(chain.decisions(chain.replay(fx.eval_calls(spark, data_dir)))) == 1


def test_feed_limits_each_tenant_before_the_shuffle(stored):
    text = plan(history.newest(stored.select("id", "tenant_id", "created_at")))
    assert text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
    assert text.count("WindowGroupLimit") == 2


def test_top_k_reads_do_not_sort_the_log(stored):
    assert "TakeOrderedAndProject" in plan(history.review_queue(stored, "1"))
    assert "TakeOrderedAndProject" in plan(history.page_after(stored, "2024-01-15 00:00:00", "5", 50))


def test_last_input_aggregates_before_the_shuffle(spark, data_dir):
    text = plan(messages.input_text(fx.conversations(spark, data_dir)))
    assert text.count("partial_max_by") >= 2 and "Window" not in text


def test_no_query_uses_local_checkpoint_or_broadcast_hints():
    import pathlib

    files = pathlib.Path(entry.ROOT, "bulwark").rglob("*.py")
    source = "".join(p.read_text() for p in files if "llm" not in p.parts)
    assert "localCheckpoint" not in source and "F.broadcast(" not in source and "crossJoin" not in source


@pytest.mark.parametrize("name, most", [("offline_evaluation", 18), ("guarded_requests", 22)])
def test_scoring_plans_shuffle_little(spark, data_dir, name, most):
    """Without broadcasts, as on large data."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, data_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < plan.count("Exchange hashpartitioning") <= most
