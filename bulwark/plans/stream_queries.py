"""Streaming jobs run over the event tables until all input is taken, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bulwark.functions.text import cache_key
from bulwark.operators import cache, rollups
from bulwark.operators.scoring import Scorer
from bulwark.plans import fixtures as fx
from bulwark.plans.log_queries import buckets_sql, limited_sql
from bulwark.plans.registry import as_doubles, query, rounded, stamp_sql, stamped
from bulwark.session import SMALL, STATE_STORE, scratch
from bulwark.sources import events, tables
from bulwark.streaming import jobs, late
from bulwark.streaming.health import alerts, rolling_health

LIMITS = {"error_rate": 0.0, "block_rate": 0.002, "evaluator_failure_rate": 0.0, "p95_latency_ms": 150}


def stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data as a file stream, be it one file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A plain path has to be a folder; a pattern, here of this one name, may also be a file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@contextmanager
def stream_settings(spark, **more: str):
    """RocksDB state, and other settings by their names."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, **more}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_turn(spark, parts: Iterable[DataFrame], inbox: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part as one micro-batch: written by its own tasks, then taken by the stream, which goes on from its checkpoint.

    Nothing runs between two parts, so a watermark moves as if the parts had followed each other in one run.
    """
    with stream_settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for part in parts:
            part.write.mode("append").options(**SMALL).parquet(inbox)
            start(spark.readStream.schema(part.schema).parquet(inbox)).awaitTermination()


def drained(spark, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over all available input and read what it wrote."""
    path = scratch(spark, name)
    with stream_settings(spark):
        jobs.to_parquet(df, path, scratch(spark, f"{name}-checkpoint"), partition_by).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _health_sql(minutes: int, slide: int) -> str:
    steps = minutes // slide
    start = (
        f"time_bucket(INTERVAL '{slide}' MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL '{slide}' MINUTE"
    )

    def share(cond: str, kind: str) -> str:
        n = f"count(*) FILTER (WHERE kind = '{kind}')"
        return f"coalesce(count(*) FILTER (WHERE kind = '{kind}' AND {cond}) / nullif(CAST({n} AS DOUBLE), 0), 0)"

    latencies = "list(latency_ms) FILTER (WHERE kind = 'request' AND latency_ms IS NOT NULL)"
    return f""", h AS (
  SELECT window_start, window_start + INTERVAL '{minutes}' MINUTE AS window_end,
    count(*) FILTER (WHERE kind = 'request') AS request_count, {share("blocked", "request")} AS block_rate,
    count(*) FILTER (WHERE kind = 'llm_call') AS llm_call_count, {share("errored", "llm_call")} AS llm_error_rate,
    count(*) FILTER (WHERE kind = 'evaluator') AS evaluator_call_count,
    {share("errored", "evaluator")} AS evaluator_failure_rate,
    coalesce(list_sort({latencies})[CAST(floor(len({latencies}) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1], 0) AS p95_latency_ms
  FROM (SELECT *, {start} AS window_start FROM health_events CROSS JOIN range({steps}) r(i)) w GROUP BY window_start)
"""


_SHOWN_HEALTH = f"""
SELECT {stamp_sql("window_start")} AS window_start, {stamp_sql("window_end")} AS window_end, request_count,
  round(block_rate, 9) AS block_rate, llm_call_count, round(llm_error_rate, 9) AS llm_error_rate,
  evaluator_call_count, round(evaluator_failure_rate, 9) AS evaluator_failure_rate, p95_latency_ms FROM h"""
_CLOSED = " WHERE window_end <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM health_events)"


@query("rolling_health", _health_sql(15, 1) + _SHOWN_HEALTH, ("health_events",))
def health(spark, sf):
    return stamped(rounded(rolling_health(fx.health_events(spark, sf))))


@query("rolling_health_stream", _health_sql(15, 1) + _SHOWN_HEALTH + _CLOSED, ("health_events",))
def health_stream(spark, sf):
    source = _timed(fx.health_projection(stream(spark, sf, "events")))
    return stamped(rounded(drained(spark, jobs.health(source), "health")))


def _alerts_sql(closed: str = "") -> str:
    checks = (
        (0, "error_rate", "llm_error_rate", "llm_call_count"),
        (1, "block_rate", "block_rate", "request_count"),
        (2, "p95_latency_ms", "p95_latency_ms", "request_count"),
        (3, "evaluator_failure_rate", "evaluator_failure_rate", "evaluator_call_count"),
    )
    return _health_sql(360, 60) + " UNION ALL ".join(
        f"""SELECT {stamp_sql("window_start")} AS window_start, {stamp_sql("window_end")} AS window_end, {i} AS ord,
  '{name}' AS "check", round(CAST({value} AS DOUBLE), 9) AS value, CAST({LIMITS[name]} AS DOUBLE) AS "limit", {n} AS samples
FROM h WHERE {n} >= 10 AND {value} > {LIMITS[name]}{closed}"""
        for i, name, value, n in checks
    )


@query("health_alerts", _alerts_sql(), ("health_events",))
def health_alerts(spark, sf):
    return stamped(rounded(alerts(rolling_health(fx.health_events(spark, sf), "6 hours", "1 hour"), LIMITS)))


@query("health_alerts_stream", _alerts_sql(_CLOSED.replace("WHERE", "AND")), ("health_events",))
def health_alerts_stream(spark, sf):
    source = _timed(fx.health_projection(stream(spark, sf, "events")))
    breached = jobs.health_alerts(source, LIMITS, window="6 hours", slide="1 hour")
    return stamped(rounded(drained(spark, breached, "alerts")))


@query("rate_limit_stream", limited_sql(30))
def rate_limit_stream(spark, sf):
    log = fx.http_projection(stream(spark, sf, "events")).select("event_id", "identity", "arrival_ms")
    path = scratch(spark, "rate-limits")
    jobs.rate_limits(log, path, scratch(spark, "rate-limits-checkpoint"), limit=30).awaitTermination()
    return as_doubles(spark.read.parquet(f"{path}/decisions").drop("batch", "late"), "retry_after_s")


@query("rate_limit_micro_batches", limited_sql(30))
def rate_limit_micro_batches(spark, sf):
    """The log in four parts by time, one micro-batch each: windows go on from the state in between."""
    log = fx.http_log(spark, sf).select("event_id", "identity", "arrival_ms")
    first, last = log.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
    inbox, path = scratch(spark, "rate-limits-input"), scratch(spark, "rate-limits")
    quarter = F.least(F.floor((F.col("arrival_ms") - first) * 4 / (last - first + 1)), F.lit(3))
    checkpoint = scratch(spark, "rate-limits-checkpoint")
    parts = [log.where(quarter == part) for part in range(4)]
    in_turn(spark, parts, inbox, lambda source: jobs.rate_limits(source, path, checkpoint, limit=30))
    return as_doubles(spark.read.parquet(f"{path}/decisions").drop("batch", "late"), "retry_after_s")


@query(
    "bucket_metrics_stream",
    f"""
SELECT tenant_id, {stamp_sql("date_trunc('hour', created_at)")} AS bucket_start, count(*) AS request_count,
  count(*) FILTER (WHERE blocked) AS blocked_count, round(avg(score_toxicity), 9) AS avg_toxicity,
  round(count(*) FILTER (WHERE flag_pii) * CAST(1 AS DOUBLE) / count(*), 9) AS flag_rate_pii,
  CAST(round_even(round(quantile_cont(latency_total, 0.95), 6), 0) AS INTEGER) AS p95_latency_total
FROM requests WHERE date_trunc('hour', created_at) + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM events)
GROUP BY ALL""",
    ("requests",),
)
def bucket_metrics_stream(spark, sf):
    source = _timed(fx.requests_of(stream(spark, sf, "events")), "created_at")
    buckets = drained(spark, jobs.bucket_metrics(source, digits=None), "buckets")
    return stamped(
        rounded(buckets).select(
            "tenant_id", "bucket_start", "request_count", "blocked_count", "avg_toxicity", "flag_rate_pii",
            "p95_latency_total",
        )
    )


@query("rollup_buckets_stream", buckets_sql(9), ("requests",))
def rollup_buckets_stream(spark, sf):
    """Rollups kept by a stream: buckets that no watermark has closed show too."""
    source = _timed(fx.requests_of(stream(spark, sf, "events")), "created_at")
    path = scratch(spark, "rollup-stream")
    rollups.append_stream(source, path, scratch(spark, "rollup-checkpoint")).awaitTermination()
    return stamped(rounded(rollups.time_buckets(spark.read.parquet(path), fx.AS_OF, "30d", "1h", digits=None)))


@query(
    "late_events",
    """
SELECT 'late-events' AS query, CAST(count(*) AS BIGINT) AS dropped,
  (SELECT CAST(count(*) AS BIGINT) FROM events) AS kept FROM events
WHERE event_id % 10 = 0 AND ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10' MINUTE FROM events)""",
)
def late_events(spark, sf):
    """All events, then every tenth of them delivered twice, then every tenth under a new id, which is late.

    ``dropped`` is what the watermark dropped, ``kept`` how many of the first ids were written.
    """
    whole = _timed(fx.table(spark, sf, "events").select("event_id", "ts"))
    inbox, path, out, checkpoint = (scratch(spark, f"late-{n}") for n in ("input", "rows", "output", "checkpoint"))
    twice = whole.where("event_id % 10 = 0")
    parts = (whole, twice, twice.withColumn("event_id", -F.col("event_id") - 1))

    def once(source: DataFrame) -> StreamingQuery:
        writer = late.distinct_events(source).writeStream.format("parquet").queryName("late-events").option("path", out)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with late.counted(spark, path, "late-events"):
        in_turn(spark, parts, inbox, once)
    kept = spark.read.parquet(out).where("event_id >= 0").count()
    dropped = late.totals(late.late_rows(spark, path))
    return dropped.select("query", "dropped", F.lit(kept).cast("long").alias("kept"))


@query(
    "tenant_feed_stream",
    """
SELECT CAST(id AS VARCHAR) AS request_id, CASE WHEN id % 9 <> 0 THEN CAST(tenant_id AS VARCHAR) END AS tenant_id, blocked,
  score_pii, latency_total
FROM requests WHERE (tenant_id = 1 OR id % 9 = 0) AND id % 10 <> 3""",
    ("requests",),
)
def tenant_feed_stream(spark, sf):
    """Events as JSON lines, some without tenant and some cut off, fed to tenant 1."""
    i = F.col("id")
    log = fx.requests(spark, sf).withColumn("tenant_id", F.when(i % 9 != 0, F.col("tenant_id")))
    whole = events.event_rows(log)
    line = F.to_json(F.struct(*whole.columns))
    broken = F.col("request_id").cast("long") % 10 == 3
    path = scratch(spark, "feed-input")
    cut = F.substring_index(line, ",", 3)
    whole.select(F.when(broken, cut).otherwise(line).alias("value")).write.text(path)
    feed = jobs.tenant_feed(spark.readStream.text(path))
    delivered = drained(spark, feed, "feed", ("tenant_id",))
    seen = jobs.visible_to(delivered, "1")
    return seen.select("request_id", "tenant_id", "blocked", F.col("scores.pii").alias("score_pii"), "latency_total")


def _length_score(_, texts: list[str]) -> list[float]:
    return [(len(t) % 101) / 100 for t in texts]


LENGTH = Scorer("length", ("text",), score_batch=_length_score)


@query(
    "score_once_stream",
    """
SELECT DISTINCT doc_id % 4 AS tenant_id, concat('guard:', CAST(doc_id % 4 AS VARCHAR), ':scores:', sha256(concat(text, '|v1'))) AS cache_key,
  'length' AS evaluator, CAST(length(text) % 101 AS DOUBLE) / 100 AS score FROM documents""",
)
def score_once_stream(spark, sf):
    tenant = F.col("doc_id") % 4
    texts = stream(spark, sf, "documents").select(
        tenant.alias("tenant_id"),
        "text",
        cache_key(tenant, F.col("text"), "v1").alias("cache_key"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") % 3600)).alias("ts"),
    )
    path = scratch(spark, "score-cache")
    with stream_settings(spark):
        jobs.score_once(texts, LENGTH, path, scratch(spark, "score-checkpoint")).awaitTermination()
    return cache.read(spark, path).select("tenant_id", "cache_key", "evaluator", "score")


def _moody_score(_, texts: list[str], moods: list[str]) -> list[float]:
    if "down" in moods:
        raise ValueError("model is down")
    return _length_score(None, texts)


MOODY = Scorer("length", ("text", "mood"), score_batch=_moody_score)


@query(
    "score_once_retry_whole_stream",
    """
SELECT DISTINCT CAST(1 AS BIGINT) AS tenant_id, concat('guard:1:scores:', sha256(concat(text, '|v1'))) AS cache_key, 'length' AS evaluator,
  CAST(length(text) % 101 AS DOUBLE) / 100 AS score FROM documents""",
)
def score_once_retry_whole_stream(spark, sf):
    """The model is down for the first micro-batch, which has every third document; the second has all."""
    texts = fx.table(spark, sf, "documents").select(
        F.lit(1).cast("long").alias("tenant_id"),
        "text",
        cache_key(F.lit(1), F.col("text"), "v1").alias("cache_key"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") % 600)).alias("ts"),
        "doc_id",
    )
    inbox = scratch(spark, "moody-input")
    later = F.col("ts") + F.expr("INTERVAL 10 MINUTE")
    parts = [
        texts.where("doc_id % 3 = 0").withColumn("mood", F.lit("down")),
        texts.withColumns({"mood": F.lit("well"), "ts": later}),
    ]
    path, checkpoint = scratch(spark, "moody-cache"), scratch(spark, "moody-checkpoint")
    parts = [part.drop("doc_id") for part in parts]
    in_turn(spark, parts, inbox, lambda source: jobs.score_once(source, MOODY, path, checkpoint))
    return cache.read(spark, path).select("tenant_id", "cache_key", "evaluator", "score")


@query(
    "request_log_stream",
    """
SELECT strftime(created_at, '%Y-%m-%d') AS dt, count(*) AS n, count(*) FILTER (WHERE flag_relevance) AS off_topic
FROM requests GROUP BY 1""",
    ("requests",),
)
def request_log_stream(spark, sf):
    source = _timed(fx.requests_of(stream(spark, sf, "events")), "created_at")
    path = scratch(spark, "request-log-stream")
    tables.append_requests_stream(source, path, scratch(spark, "request-log-checkpoint")).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count("*").alias("n"), F.count_if("flag_relevance").alias("off_topic")
    )
