from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulwark.operators import history
from bulwark.sources import log_index, merge, snapshots, tables

START = datetime(2024, 1, 1, 12)
REVIEW = "review_id long, request_id string, tenant_id string, label string, reviewed_at timestamp, dt date"


def requests(spark, ids):
    """Request i lies on day i % 5; every eleventh has no time."""
    rows = [(f"r{i}", None if i % 11 == 0 else START + timedelta(days=i % 5, minutes=i), "a", i % 2 == 0) for i in ids]
    return spark.createDataFrame(rows, "id string, created_at timestamp, tenant_id string, reviewed boolean")


def review(n, i, label, day=None, tenant="a"):
    at = None if i % 11 == 0 else START + timedelta(days=i % 5 if day is None else day)
    return (n, f"r{i}", tenant, label, START + timedelta(days=9, minutes=n), at and at.date())


REVIEWS = [
    review(1, 1, "false_positive"), review(2, 6, "correct_flag"), review(3, 6, "false_negative"),
    review(4, 16, "wrong label"), review(5, 21, "correct_flag", tenant="b"), review(6, 11, "correct_flag"),
]


@pytest.fixture
def log(spark, tmp_path):
    place = str(tmp_path / "log")
    tables.append_requests(requests(spark, range(60)), place)
    return place


def shown(df):
    return sorted(map(tuple, df.select("id", "created_at", "tenant_id", "reviewed", "review_label", "reviewed_at").collect()), key=str)


def files(spark, log):
    return {"/".join(f.split("/")[-2:]) for f in spark.read.parquet(log).inputFiles()}


def expected(spark, log, rows):
    whole = spark.read.parquet(log)
    return shown(spark.createDataFrame(history.apply_reviews(whole, rows).collect(), history.apply_reviews(whole, rows).schema))


def test_days_without_reviews_keep_their_files(spark, log):
    rows = spark.createDataFrame(REVIEWS, REVIEW)
    want, before = expected(spark, log, rows), files(spark, log)
    days = merge.merge_reviews(spark, log, rows)
    assert days == ["dt=2024-01-02", "dt=__HIVE_DEFAULT_PARTITION__"]
    after = files(spark, log)
    assert {f for f in before if not f.startswith(tuple(days))} == {f for f in after if not f.startswith(tuple(days))}
    assert not {f for f in before & after if f.startswith(tuple(days))}
    assert shown(spark.read.parquet(log)) == want
    assert merge._names(spark, log) == sorted({f.split("/")[0] for f in after} | {"_SUCCESS"})
    labels = {r.id: r.review_label for r in spark.read.parquet(log).where("review_label IS NOT NULL").collect()}
    assert labels == {"r1": "false_positive", "r6": "false_negative", "r11": "correct_flag"}


def test_days_by_index_and_nothing_to_do(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(log_index, "SLOTS", 4)
    index = str(tmp_path / "index")
    log_index.refresh(spark, log, index)
    rows = spark.createDataFrame(REVIEWS, REVIEW).drop("dt")
    with pytest.raises(ValueError):
        merge.merge_reviews(spark, log, rows)
    assert merge.merge_reviews(spark, log, rows.where("request_id = 'none'"), index) == []
    assert merge.merge_reviews(spark, log, rows.where("request_id = 'r6'"), index) == ["dt=2024-01-02"]
    found = log_index.lookup(spark, log, index, rows.where("review_id = 3").withColumnRenamed("request_id", "id"))
    assert [r.review_label for r in found.collect()] == ["false_negative"]


@pytest.mark.parametrize("after", range(7))
def test_a_merge_that_dies_is_finished(spark, log, monkeypatch, after):
    """Ended before the journal nothing changed; ended at any later move the next call ends it."""
    rows = spark.createDataFrame(REVIEWS, REVIEW)
    want, untouched = expected(spark, log, rows), shown(spark.read.parquet(log))
    moves = []

    class Died(Exception):
        pass

    move, write = merge._move, snapshots.write_text

    def dying(spark, source, target):
        if len(moves) == after - 1:
            raise Died
        moves.append(target)
        move(spark, source, target)

    def no_journal(*_):
        raise Died

    monkeypatch.setattr(merge, "_move", dying)
    if after == 0:
        monkeypatch.setattr(snapshots, "write_text", no_journal)
    try:
        merge.merge_reviews(spark, log, rows)
    except Died:
        pass
    monkeypatch.setattr(merge, "_move", move)
    monkeypatch.setattr(snapshots, "write_text", write)
    merge.recover(spark, log)
    assert shown(spark.read.parquet(log)) == (untouched if after == 0 else want)
    assert not [n for n in merge._names(spark, log) if n.startswith(merge.STAGE)]


def test_files_appended_meanwhile_stay(spark, log, monkeypatch):
    rows = spark.createDataFrame(REVIEWS, REVIEW)
    write = snapshots.write_text

    def late(spark, path, text):
        tables.append_requests(requests(spark, [101, 106]), log)
        write(spark, path, text)

    monkeypatch.setattr(snapshots, "write_text", late)
    merge.merge_reviews(spark, log, rows)
    ids = [r.id for r in spark.read.parquet(log).select("id").collect()]
    assert sorted(ids) == sorted([f"r{i}" for i in range(60)] + ["r101", "r106"])
