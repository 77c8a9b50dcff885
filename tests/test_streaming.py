import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bulwark import session
from bulwark.operators import cache
from bulwark.operators.scoring import Scorer
from bulwark.plans import stream_queries
from bulwark.streaming import jobs
from bulwark.streaming.health import alerts, rolling_health, snapshot

START = datetime(2024, 1, 1)
HEALTH = "ts timestamp, kind string, blocked boolean, errored boolean, latency_ms int"


def event(minute, kind="request", blocked=False, errored=False, latency=None):
    return (START + timedelta(minutes=minute), kind, blocked, errored, latency)


def window_from(spark, rows, minute):
    df = rolling_health(spark.createDataFrame(rows, HEALTH))
    return df.where(F.col("window_start") == F.lit(START + timedelta(minutes=minute))).collect()[0]


def test_fractions_and_nearest_rank(spark):
    rows = [event(0, latency=i) for i in range(1, 101)]
    rows += [event(1, "llm_call", errored=i == 0) for i in range(4)]
    rows += [event(2, "evaluator", errored=i == 0) for i in range(4)]
    w = window_from(spark, rows, 0)
    assert (w.request_count, w.p95_latency_ms, w.llm_error_rate, w.evaluator_failure_rate) == (100, 96, 0.25, 0.25)
    assert w.block_rate == 0.0


def test_block_rate_and_empty_kinds(spark):
    w = window_from(spark, [event(0, blocked=i == 0, latency=5) for i in range(4)], 0)
    assert (w.block_rate, w.llm_call_count, w.llm_error_rate) == (0.25, 0, 0.0)
    w = window_from(spark, [event(0, "llm_call")], 0)
    assert (w.request_count, w.p95_latency_ms) == (0, 0)


def test_events_leave_the_window(spark):
    rows = [event(0, latency=1), event(20, latency=2)]
    df = rolling_health(spark.createDataFrame(rows, HEALTH))
    assert df.count() == 30 and df.agg(F.max("request_count")).collect()[0][0] == 1


def test_snapshot_includes_both_ends_and_may_be_empty(spark):
    rows = [event(0, latency=7), event(15, blocked=True, latency=9), event(15.1, latency=1), event(-0.1, latency=1)]
    df = spark.createDataFrame(rows, HEALTH)
    s = snapshot(df, START + timedelta(minutes=15)).collect()[0]
    assert (s.request_count, s.block_rate, s.p95_latency_ms) == (2, 0.5, 9)
    empty = snapshot(df, START - timedelta(days=1)).collect()
    assert [tuple(r) for r in empty] == [(0, 0.0, 0, 0.0, 0, 0.0, 0)]


def checks(spark, rows, limits=None):
    df = alerts(rolling_health(spark.createDataFrame(rows, HEALTH)), limits)
    at = df.where(F.col("window_start") == F.lit(START)).orderBy("ord").collect()
    return [(r["check"], r.samples) for r in at]


def test_no_alert_below_ten_samples(spark):
    assert checks(spark, [event(0, "llm_call", errored=True) for _ in range(9)]) == []
    assert checks(spark, [event(0, "llm_call", errored=True) for _ in range(10)]) == [("error_rate", 10)]


def test_alert_is_strict_and_ordered(spark):
    half = [event(0, blocked=i % 2 == 0, latency=10_000) for i in range(10)]
    assert checks(spark, half) == []
    rows = [event(0, blocked=i < 6, latency=10_001) for i in range(10)]
    rows += [event(0, "evaluator", errored=True) for _ in range(10)] + [event(0, "llm_call", errored=True) for _ in range(10)]
    assert [c for c, _ in checks(spark, rows)] == [
        "error_rate", "block_rate", "p95_latency_ms", "evaluator_failure_rate",
    ]
    assert checks(spark, half, {"block_rate": 0.4}) == [("block_rate", 10)]


def test_health_stream_over_batches_equals_batch(spark, tmp_path):
    rows = [event(i / 4, ("request", "llm_call", "evaluator")[i % 3], i % 5 == 0, i % 7 == 0, i % 40) for i in range(400)]
    for b in range(4):
        part = spark.createDataFrame(rows[b * 100 : (b + 1) * 100], HEALTH)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(HEALTH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.to_parquet(jobs.health(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = START + timedelta(minutes=399 / 4) - timedelta(minutes=10)
    batch = rolling_health(spark.createDataFrame(rows, HEALTH)).where(F.col("window_end") <= F.lit(closed))
    assert streamed == {tuple(r) for r in batch.collect()} and streamed


def _ones(_, texts):
    return [1.0] * len(texts)


def test_score_once_drops_repeats_across_batches(spark, tmp_path):
    schema = "tenant_id long, text string, cache_key string, ts timestamp"
    rows = [(i % 2, f"t{i % 3}", f"{i % 2}-{i % 3}", START + timedelta(seconds=i)) for i in range(60)]
    for b in range(3):
        part = spark.createDataFrame(rows[b * 20 : (b + 1) * 20], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scorer = Scorer("one", ("text",), score_batch=_ones)
    jobs.score_once(source, scorer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = cache.read(spark, str(tmp_path / "out"))
    assert stored.count() == 6 and stored.select("cache_key").distinct().count() == 6


def test_tables_of_several_files_stream_like_one_file(spark, data_dir, tmp_path):
    for name, files in (("documents", 3), ("events", 2)):
        whole = spark.read.parquet(f"{data_dir}/{name}.parquet")
        whole.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (stream_queries.score_once_stream, stream_queries.request_log_stream):
        folder, file = ({tuple(r) for r in query(spark, d).collect()} for d in (str(tmp_path), data_dir))
        assert folder == file and folder


def test_parts_in_turn_are_written_by_their_own_tasks(spark, data_dir, tmp_path, monkeypatch):
    for name, query in (("documents", "score_once_retry_whole_stream"), ("events", "rate_limit_micro_batches"), ("events", "late_events")):
        at = tmp_path / query
        spark.read.parquet(f"{data_dir}/{name}.parquet").repartition(3).write.parquet(str(at / f"{name}.parquet"))
        monkeypatch.setattr(stream_queries, "scratch", lambda _, folder, at=at: str(at / folder))
        got = {tuple(r) for r in getattr(stream_queries, query)(spark, str(at)).collect()}
        monkeypatch.undo()
        assert got == {tuple(r) for r in getattr(stream_queries, query)(spark, data_dir).collect()} and got
        inbox = next(p for p in at.iterdir() if p.name.endswith("-input"))
        assert len(list(inbox.glob("part-*"))) >= 6  # of two parts and more, three files each


def test_score_once_keeps_failed_texts_and_only_those(spark, tmp_path):
    schema = "tenant_id long, text string, cache_key string, ts timestamp"
    rows = [(1, t, t, START) for t in ("a", "bb", "ccc", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def picky(_, texts):
        return [1.0 if len(t) < 3 else None for t in texts]

    jobs.score_once(source, Scorer("picky", ("text",), score_batch=picky), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.cache_key for r in cache.read(spark, str(tmp_path / "out")).collect()} == {"a", "bb"}
    failed = spark.read.schema(schema).parquet(str(tmp_path / "out-failed/batch=0"))
    assert {(r.tenant_id, r.text, r.cache_key) for r in failed.collect()} == {(1, "ccc", "ccc"), (1, None, None)}


def test_texts_on_their_way_are_written_small(spark, data_dir, tmp_path, monkeypatch):
    for module in (session, stream_queries):
        monkeypatch.setattr(module, "scratch", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    assert stream_queries.score_once_retry_whole_stream(spark, data_dir).count()
    for kind in ("moody-input-*", "texts-*", "moody-cache-*-failed/batch=0"):
        files = [f.name for folder in tmp_path.glob(kind) for f in folder.glob("part-*")]
        assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_feed_shows_own_and_unowned_events(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "request_id string, tenant_id string")
    assert {r.request_id for r in jobs.visible_to(df, "a").collect()} == {"1", "3"}
