"""The stored score cache: a log of writes, snapshots, folding, merging and splitting."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bulwark.operators import cache
from bulwark.sources import snapshots

SCHEMA = "tenant_id long, cache_key string, evaluator string, score double, metadata string, written_at timestamp, error string"
START = datetime(2024, 1, 1)


def fresh(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def many(spark, n, first=0, at=START, score=0.5):
    keys = spark.range(first, first + n).select(F.lit(1).cast("long").alias("tenant_id"), F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    return keys.select("*", F.lit("pii").alias("evaluator"), F.lit(score).alias("score"), F.lit("m").alias("metadata"),
                       F.lit(at).alias("written_at"), F.lit(None).cast("string").alias("error"))


def entries(frame):
    return {(r["tenant_id"], r["cache_key"], r["evaluator"]): tuple(r)[3:] for r in frame.collect()}


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cache, "BUCKET_ROWS", 40)
    monkeypatch.setattr(cache, "FOLDED", 3)
    monkeypatch.setattr(cache, "LOG_ROWS", 30)


def written_back(spark, batches, ttl):
    """The cache by repeated ``write_back``."""
    held = None
    for rows in batches:
        new = fresh(spark, rows)
        if held is None:
            held = spark.createDataFrame([], SCHEMA.replace("error string", "expires_at timestamp"))
        held = spark.createDataFrame(cache.write_back(held, new, ttl).collect(), held.schema)
    return held


@pytest.mark.parametrize("seed", [1, 2])
def test_log_equals_repeated_write_back(spark, tmp_path, small, seed):
    """With gaps longer than the time to live, failures, several evaluators, folds, merges and splits."""
    rng, batches, path = random.Random(seed), [], str(tmp_path / "cache")
    for b in range(9):
        now = START + timedelta(seconds=b * 400)
        rows = {}
        for _ in range(rng.randrange(5, 60)):
            key = (rng.randrange(2), f"k{rng.randrange(90)}", rng.choice(["pii", "toxicity"]))
            rows[key] = (*key, rng.random(), f"b{b}", now + timedelta(seconds=rng.randrange(300)), rng.choice([None, None, "boom"]))
        batches.append(list(rows.values()))
    for rows in batches:
        cache.store(fresh(spark, rows), path, ttl_seconds=900)
    _, version = snapshots.newest(spark, path)
    assert len(version["buckets"]) > 1 and any(b["folder"] for b in version["buckets"])
    as_of = max(r[5] for r in batches[-1])
    want = entries(cache.live(written_back(spark, batches, 900), as_of))
    got = entries(cache.live(cache.read(spark, path), as_of))
    assert got == want
    cache.compact(spark, path)
    assert entries(cache.live(cache.read(spark, path), as_of)) == want
    # Some keys only.
    some = spark.createDataFrame([(f"k{i}",) for i in range(0, 95, 9)], "cache_key string")
    keys = {r[0] for r in some.collect()}
    assert entries(cache.live(cache.read(spark, path, some), as_of)) == {k: v for k, v in want.items() if k[1] in keys}


def test_a_write_costs_its_own_rows(spark, tmp_path):
    """The same batch writes as much into a cache that holds a hundred times its keys."""
    sizes = {}
    for held in (0, 1_000, 100_000):
        path = str(tmp_path / str(held))
        if held:
            cache.store(many(spark, held), path)
            cache.compact(spark, path)
        before = files(path)
        cache.store(many(spark, 1_000, first=500, at=START + timedelta(minutes=5), score=0.7), path)
        after = files(path)
        assert all(after[f] == size for f, size in before.items())  # nothing is rewritten
        sizes[held] = sum(size for f, size in after.items() if f not in before)
        assert cache.read(spark, path).where("score = 0.7").count() == 1_000
    assert sizes[100_000] < 1.2 * sizes[1_000] and sizes[100_000] < 1.2 * sizes[0]


def test_all_writes_of_a_long_run_stay_in_proportion(spark, tmp_path, small):
    path, rows = str(tmp_path / "cache"), 0
    for b in range(12):
        cache.store(many(spark, 20, first=20 * b), path, ttl_seconds=10**6)
        _, version = snapshots.newest(spark, path)
        assert len(version["deltas"]) <= 3 * 4
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "cache").glob("d*") if any(p.glob("*.parquet"))]).count()
    assert cache.read(spark, path).count() == 240
    assert rows <= 240 * 3


def test_readers_keep_their_snapshot(spark, tmp_path, small):
    path = str(tmp_path / "cache")
    cache.store(many(spark, 50), path)
    seen = cache.read(spark, path)
    cache.store(many(spark, 50, first=25, at=START + timedelta(minutes=1), score=0.9), path)
    cache.compact(spark, path)
    assert seen.count() == 50 and seen.where("score = 0.9").count() == 0
    now = cache.read(spark, path)
    assert now.count() == 75 and now.where("score = 0.9").count() == 50


def test_merging_reads_and_writes_touched_buckets_only(spark, tmp_path, small):
    path = str(tmp_path / "cache")
    cache.store(many(spark, 400), path, tidy=False)
    cache.compact(spark, path)
    _, first = snapshots.newest(spark, path)
    assert len(first["directory"]) == 2 ** first["depth"] and set(first["directory"]) == set(range(len(first["buckets"])))
    assert sum(b["rows"] for b in first["buckets"]) == 400 and max(b["rows"] for b in first["buckets"]) <= 2 * cache.BUCKET_ROWS
    cache.store(many(spark, 1, first=7, at=START + timedelta(minutes=1), score=0.9), path, tidy=False)
    cache.compact(spark, path)
    _, second = snapshots.newest(spark, path)
    assert sum(a != b for a, b in zip(first["buckets"], second["buckets"])) == 1
    key = many(spark, 1, first=7).select("cache_key")
    found = cache.read(spark, path, key)
    assert [r["score"] for r in found.collect()] == [0.9]
    assert len(found.inputFiles()) == 1


def test_expired_entries_leave_with_a_merge(spark, tmp_path, small):
    path = str(tmp_path / "cache")
    cache.store(many(spark, 50), path, ttl_seconds=60)
    cache.store(many(spark, 10, first=100, at=START + timedelta(hours=1)), path, ttl_seconds=60)
    cache.compact(spark, path)
    left = cache.read(spark, path)
    assert left.count() <= 60 and cache.live(left, START + timedelta(hours=1)).count() == 10


def test_tokens_make_a_repeated_batch_harmless(spark, tmp_path):
    path = str(tmp_path / "cache")
    for _ in range(2):
        cache.store(many(spark, 5), path, token=("job", 3))
    assert snapshots.numbers(spark, path) == [1]
    cache.store(many(spark, 5, first=5), path, token=("job", 4))
    cache.store(many(spark, 5, first=10), path, token=("other", 0))
    assert cache.read(spark, path).count() == 15


def test_empty_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read(spark, path) is None
    cache.store(fresh(spark, [(1, "a", "pii", None, None, START, None), (1, "b", "pii", 0.5, None, START, "boom")]), path)
    assert cache.read(spark, path).collect() == []
    cache.compact(spark, path)
    cache.store(fresh(spark, [(1, "a", "pii", 0.5, None, START, None)] * 3), path)
    assert len(cache.read(spark, path).collect()) == 1


def test_two_writers(spark, tmp_path):
    """The slower one looks again and both writes stand; a merge that was overtaken gives way."""
    path = str(tmp_path / "cache")
    cache.store(many(spark, 5), path)
    other = iter([True])

    def step(number, version):
        if next(other, False):
            cache.store(many(spark, 5, first=5), path)
        return {**version, "tokens": {"x": number}}

    assert snapshots.change(spark, path, step) == 3
    _, version = snapshots.newest(spark, path)
    assert version["tokens"] == {"x": 3} and cache.read(spark, path).count() == 10
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, 3, {})
    stale = dict(version, deltas=version["deltas"][:1])
    cache.compact(spark, path)
    cache._fold(spark, path, stale, stale["deltas"])
    assert cache.read(spark, path).count() == 10


def test_an_unfinished_version_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "UNFINISHED", 0.1)
    path = str(tmp_path / "cache")
    cache.store(many(spark, 5), path)
    (tmp_path / "cache" / snapshots.FOLDER / f"{2:012d}.json").write_text('{"schema":')
    assert cache.read(spark, path).count() == 5
    cache.store(many(spark, 5, first=5), path)
    assert snapshots.numbers(spark, path) == [1, 2, 3] and cache.read(spark, path).count() == 10


def test_vacuum_keeps_what_versions_name(spark, tmp_path, small):
    path = str(tmp_path / "cache")
    for b in range(4):
        cache.store(many(spark, 20, first=10 * b), path, ttl_seconds=10**6, tidy=False)
    cache.compact(spark, path)
    before = entries(cache.read(spark, path))
    assert cache.vacuum(spark, path, keep=2) == []
    gone = cache.vacuum(spark, path, keep=1)
    assert len(gone) == 4 and all(name.startswith("delta-") for name in gone)
    assert entries(cache.read(spark, path)) == before and len(before) == 50
