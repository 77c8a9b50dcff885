import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.operators import metrics, rollups

NOW = datetime(2024, 1, 8)


def log(spark, n, seed, latencies=400):
    """Requests of a hot and two small tenants over eight days, with unknown scores, latencies and times."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        at = None if i % 101 == 0 else NOW - timedelta(seconds=rng.randrange(8 * 86_400))
        tenant = "hot" if i % 3 else ("b" if i % 2 else "c")
        score = None if i % 11 == 0 or tenant == "c" else rng.random()
        made.append((i, at, tenant, rng.random() < 0.2, score, None if i % 13 == 0 else rng.randrange(latencies), rng.randrange(256)))
    df = spark.createDataFrame(made, "id long, created_at timestamp, tenant_id string, blocked boolean, s double, latency_total int, bits int")
    scores = {f"score_{s}": F.col("s") * (k + 1) for k, s in enumerate(rollups.SCORES)}
    flags = {f"flag_{n}": F.when(F.col("bits") % 5 != 0, F.col("bits").bitwiseAND(1 << (k % 8)) > 0) for k, n in enumerate(NAMES)}
    return df.withColumns({**scores, **flags}).drop("s", "bits")


def table(df):
    shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(tuple, df.select(*shown).collect()), key=str)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    whole = log(spark, 3000, 1).persist()
    path = str(tmp_path_factory.mktemp("rollups") / "minutes")
    for k in range(3):
        rollups.append(whole.where(F.col("id") % 3 == k), path)
    yield whole, path
    whole.unpersist()


@pytest.mark.parametrize("window,bucket,exact", [("7d", "1h", False), ("7d", "1d", True), ("24h", "5m", True), ("7d", "6h", True), ("6h", "15m", False)])
def test_any_width_equals_the_log(spark, written, window, bucket, exact):
    whole, path = written
    got = rollups.time_buckets(spark.read.parquet(path), NOW, window, bucket, exact_buckets=exact, digits=None)
    want = metrics.time_buckets(whole, NOW, window, bucket, exact_buckets=exact, digits=None)
    assert got.dtypes == want.dtypes
    assert table(got) == table(want)


def test_one_tenant_and_merged_rows(spark, written):
    whole, path = written
    held = spark.read.parquet(path)
    once = rollups.merged(held)
    assert once.count() == once.select("tenant_id", "minute").distinct().count() < held.count()
    got = rollups.time_buckets(once, NOW, "7d", "1h", tenant_id="b")
    assert table(got) == table(metrics.time_buckets(whole, NOW, "7d", "1h", tenant_id="b"))
    assert once.agg(F.sum("request_count")).first()[0] == 3000


def test_reads_days_of_the_window_and_shuffles_once(spark, written):
    plan = rollups.time_buckets(spark.read.parquet(written[1]), NOW, "24h")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and plan.count("Exchange") == 1


def test_stream_shows_open_buckets_and_late_rows(spark, tmp_path):
    whole = log(spark, 600, 2).persist()
    parts = [whole.where("id >= 200"), whole.where("id < 100"), whole.where("id >= 100 and id < 200")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rollups.append_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rollups.time_buckets(spark.read.parquet(str(tmp_path / "out")), NOW, "7d", "1h", digits=None)
    assert table(got) == table(metrics.time_buckets(whole, NOW, "7d", "1h", digits=None))


def test_empty_log(spark):
    none = log(spark, 5, 3).limit(0)
    assert rollups.minute_rollups(none).count() == 0
    assert rollups.time_buckets(rollups.minute_rollups(none), NOW).count() == 0
