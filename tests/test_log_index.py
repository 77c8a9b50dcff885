import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulwark.operators import history
from bulwark.sources import log_index, snapshots, tables

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_slots(monkeypatch):
    monkeypatch.setattr(log_index, "SLOTS", 4)


def rows(spark, first, n, days=4):
    """Requests with ties in time, unknown times and two tenants, the first with most rows."""
    rng = random.Random(first)
    made = []
    for i in range(first, first + n):
        at = None if i % 97 == 0 else START + timedelta(minutes=rng.randrange(days * 1440))
        made.append((f"r{i:06d}", at, "b" if i % 7 == 0 else "a"))
    return spark.createDataFrame(made, "id string, created_at timestamp, tenant_id string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("indexed")
    log, index = str(place / "log"), str(place / "index")
    before = log_index.SLOTS
    log_index.SLOTS = 4
    for part in range(3):
        tables.append_requests(rows(spark, 1 + part * 400, 400), log)
        if part < 2:
            log_index.refresh(spark, log, index)
    yield log, index
    log_index.SLOTS = before


def shown(df):
    return [(r.id, r.created_at) for r in df.select("id", "created_at").collect()]


@pytest.mark.parametrize("tenant", [None, "a", "b"])
@pytest.mark.parametrize("limit", [7, 200])
def test_pages_equal_those_of_a_full_pass(spark, indexed, tenant, limit):
    whole = history.for_tenant(spark.read.parquet(indexed[0]), tenant)
    n = whole.count()
    assert log_index.total(spark, *indexed, tenant).first()[0] == n
    last = -(-n // limit)
    for page in {1, 2, last // 2 + 1, last, last + 1}:
        got = shown(log_index.page(spark, *indexed, page, limit, tenant))
        assert got == shown(history.page(whole, page, limit)), page


def test_deep_page_reads_the_hours_it_covers(spark, tmp_path):
    log, index = str(tmp_path / "log"), str(tmp_path / "index")
    many = spark.range(40_000).select(
        F.col("id").cast("string"),
        (F.lit(START) + F.make_dt_interval(secs=F.col("id") * 20)).alias("created_at"),
        F.lit("a").alias("tenant_id"),
    )
    tables.append_requests(many, log)
    log_index.refresh(spark, log, index)
    page = log_index.page(spark, log, index, page=700, limit=50)
    read = page._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"created_at#\d+ >= 2024-01-0", read) and re.search(r"created_at#\d+ < 2024-01-0", read)
    days = {p.split("/")[-2] for p in page.inputFiles()}
    ids = [int(r.id) for r in page.collect()]
    assert ids == list(range(40_000 - 699 * 50 - 1, 40_000 - 700 * 50 - 1, -1))
    assert len(days) == 1
    hours = spark.read.parquet(log).where(F.col("id").isin([str(i) for i in ids]))
    assert hours.select(F.date_trunc("hour", "created_at")).distinct().count() <= 2


def test_lookup_reads_files_that_hold_the_ids(spark, tmp_path):
    log, index = str(tmp_path / "log"), str(tmp_path / "index")
    tables.append_requests(rows(spark, 1, 2000, days=10), log)
    log_index.refresh(spark, log, index)
    whole = spark.read.parquet(log)
    one = whole.where("id = 'r000500'").select("id", "tenant_id", F.col("_metadata.file_path").alias("f")).first()
    wanted = spark.createDataFrame([("r000500", one.tenant_id), ("r000501", "other"), ("none", "a")], "id string, tenant_id string")
    found = log_index.lookup(spark, log, index, wanted)
    assert [r.id for r in found.collect()] == ["r000500"]
    assert [p.split("/")[-1] for p in found.inputFiles()] == [one.f.split("/")[-1]]
    assert len(whole.inputFiles()) >= 10


def test_lookup_of_all_and_of_files_not_covered(spark, indexed, monkeypatch):
    whole = spark.read.parquet(indexed[0])
    wanted = whole.select("id", "tenant_id").unionByName(whole.select("id", F.lit("x").alias("tenant_id")))
    assert log_index.lookup(spark, *indexed, wanted).count() == 1200
    monkeypatch.setattr(log_index, "PUSHED_IDS", 3)
    assert log_index.lookup(spark, *indexed, wanted.where("id >= 'r000900'")).count() == whole.where("id >= 'r000900'").count()
    nothing = log_index.lookup(spark, *indexed, wanted.limit(0))
    assert nothing.count() == 0 and nothing.columns[:2] == ["id", "tenant_id"]


def test_refresh_folds_and_forgets_lost_files(spark, tmp_path):
    log, index = str(tmp_path / "log"), str(tmp_path / "index")
    for part in range(4):
        tables.append_requests(rows(spark, 1 + part * 50, 50, days=1), log)
        if part == 3:
            # A day that is written anew has other files; entries of the old ones count no longer.
            old = spark.read.parquet(log).drop("dt").collect()
            kept = spark.createDataFrame([r for r in old if r.id != "r000007"], spark.read.parquet(log).drop("dt").schema)
            kept.withColumn("dt", F.to_date("created_at")).write.mode("overwrite").partitionBy("dt").parquet(log)
        log_index.refresh(spark, log, index, fold=3)
    version = snapshots.newest(spark, index)[1]
    assert [f["level"] for f in version["folders"]] == [1, 0]
    assert log_index.refresh(spark, log, index) is None
    assert log_index.total(spark, log, index).first()[0] == 199
    wanted = spark.createDataFrame([("r000007", "a"), ("r000007", "b"), ("r000008", "a")], "id string, tenant_id string")
    assert [r.id for r in log_index.lookup(spark, log, index, wanted).collect()] == ["r000008"]
    gone = log_index.vacuum(spark, index, keep=1)
    assert len(gone) == 3
    assert shown(log_index.page(spark, log, index, 2, 50)) == shown(history.page(spark.read.parquet(log), 2, 50))


def test_page_bounds(spark, indexed):
    for page, limit in ((0, 50), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            log_index.page(spark, *indexed, page, limit)
