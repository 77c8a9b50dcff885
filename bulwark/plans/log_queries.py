"""Queries over the request log: metrics, history, tenants, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulwark.catalog import NAMES, SCORECARD_NAMES
from bulwark.functions.text import key_prefix, uuid_or_null
from bulwark.operators import history, metrics, rollups, tenancy
from bulwark.operators.distribution import nearest_ranks, quantiles
from bulwark.operators.ratelimit import replay_limits
from bulwark.plans import fixtures as fx
from bulwark.plans.oracle_sql import AS_OF_SQL
from bulwark.plans.registry import as_doubles, query, rounded, stamp_sql, stamped
from bulwark.session import scratch
from bulwark.sources import events, log_index, merge, tables, validation

ANY_FLAG = "(" + " OR ".join(f"flag_{n}" for n in NAMES) + ")"
SCORES = ", ".join(f"score_{n}" for n in NAMES)
ROUNDED_SCORES = ", ".join(f"round(score_{n}, 9) AS score_{n}" for n in NAMES)
FLAGS = ", ".join(f"flag_{n}" for n in NAMES)
FLAG_LIST = "array_to_string([x FOR x IN [" + ", ".join(
    f"CASE WHEN flag_{n} THEN '{n}' END" for n in NAMES
) + "] IF x IS NOT NULL], ',')"
P95 = "CAST(coalesce(round_even(round(quantile_cont(latency_total, 0.95), 6), 0), 0) AS INTEGER)"


def _rates(digits: int) -> str:
    return ", ".join(
        f"round(count(*) FILTER (WHERE flag_{n}) * CAST(1 AS DOUBLE) / count(*), {digits}) AS flag_rate_{n}"
        for n in NAMES
    )


def buckets_sql(digits: int, start: str = "date_trunc('hour', created_at)") -> str:
    return f"""
SELECT tenant_id, {stamp_sql(start)} AS bucket_start, count(*) AS request_count,
  count(*) FILTER (WHERE blocked) AS blocked_count,
  round(avg(score_toxicity), {digits}) AS avg_toxicity, round(avg(score_relevance), {digits}) AS avg_relevance,
  round(avg(score_hallucination), {digits}) AS avg_hallucination, {_rates(digits)},
  {P95} AS p95_latency_total
FROM requests WHERE created_at >= {AS_OF_SQL} - INTERVAL '30' DAY GROUP BY ALL"""


@query("time_bucket_metrics", buckets_sql(9), ("requests",))
def time_bucket_metrics(spark, sf):
    return stamped(rounded(metrics.time_buckets(fx.requests(spark, sf), fx.AS_OF, "30d", "1h", digits=None)))


@query(
    "time_bucket_metrics_exact_6h",
    buckets_sql(9, "time_bucket(INTERVAL '6' HOUR, created_at, TIMESTAMP '1970-01-01')"),
    ("requests",),
)
def time_bucket_metrics_exact(spark, sf):
    buckets = metrics.time_buckets(
        fx.requests(spark, sf), fx.AS_OF, "30d", "6h", exact_buckets=True, digits=None
    )
    return stamped(rounded(buckets))


def _rollups(spark, sf):
    """Rollups of the whole log, written in two batches that share minutes."""
    path = scratch(spark, "rollups")
    odd = F.col("id") % 2 == 1
    for part in (odd, ~odd):
        rollups.append(fx.requests(spark, sf).where(part), path)
    return spark.read.parquet(path)


@query("rollup_buckets", buckets_sql(9), ("requests",))
def rollup_buckets(spark, sf):
    return stamped(rounded(rollups.time_buckets(_rollups(spark, sf), fx.AS_OF, "30d", "1h", digits=None)))


@query(
    "rollup_buckets_exact_6h",
    buckets_sql(9, "time_bucket(INTERVAL '6' HOUR, created_at, TIMESTAMP '1970-01-01')"),
    ("requests",),
)
def rollup_buckets_exact(spark, sf):
    once = rollups.merged(_rollups(spark, sf))
    return stamped(rounded(rollups.time_buckets(once, fx.AS_OF, "30d", "6h", exact_buckets=True, digits=None)))


@query(
    "summary_24h",
    f"""
SELECT tenant_id, count(*) AS total_requests_24h, count(*) FILTER (WHERE blocked) AS blocked_requests_24h,
  round(count(*) FILTER (WHERE blocked) * CAST(1 AS DOUBLE) / count(*), 9) AS block_rate_24h,
  CAST(round(avg(latency_total), 0) AS INTEGER) AS avg_latency_24h_ms,
  count(*) FILTER (WHERE NOT reviewed AND {ANY_FLAG}) AS unreviewed_flags
FROM requests WHERE created_at >= {AS_OF_SQL} - INTERVAL '24' HOUR GROUP BY tenant_id""",
    ("requests",),
)
def summary_24h(spark, sf):
    return rounded(metrics.summary(fx.requests(spark, sf), fx.AS_OF, digits=None))


@query(
    "top_flag_reason",
    """, c AS (SELECT tenant_id, 0 AS ord, 'x' AS evaluator, 0 AS cnt FROM requests WHERE false"""
    + "".join(
        f" UNION ALL SELECT tenant_id, {i}, '{n}', count(*) FILTER (WHERE flag_{n}) FROM requests "
        f"WHERE created_at >= {AS_OF_SQL} - INTERVAL '24' HOUR GROUP BY tenant_id"
        for i, n in enumerate(NAMES)
    )
    + """)
SELECT tenant_id, CASE WHEN cnt > 0 THEN evaluator END AS top_flag_reason, CAST(cnt AS BIGINT) AS top_flag_count
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY cnt DESC, ord) AS rn FROM c) q WHERE rn = 1""",
    ("requests",),
)
def top_flag_reason(spark, sf):
    return metrics.top_flag(fx.requests(spark, sf), fx.AS_OF)


_HOURLY = f"""
SELECT tenant_id, date_trunc('hour', created_at) AS bucket_start, count(*) AS request_count,
  count(*) FILTER (WHERE blocked) AS blocked_count, {_rates(4)}
FROM requests WHERE created_at >= {AS_OF_SQL} - INTERVAL '30' DAY GROUP BY ALL"""


@query(
    "flag_rate_series",
    f", b AS ({_HOURLY}) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS evaluator, round(coalesce(avg(flag_rate_{n}), 0) * 100, 2) AS rate_pct FROM b"
        for n in SCORECARD_NAMES
    ),
    ("requests",),
)
def flag_rate_series(spark, sf):
    return metrics.flag_rate_series(metrics.time_buckets(fx.requests(spark, sf), fx.AS_OF, "30d"))


@query(
    "volume_series",
    f""", b AS ({_HOURLY})
SELECT tenant_id, {stamp_sql("bucket_start")} AS bucket_start, request_count AS requests, blocked_count AS blocked,
  round(flag_rate_toxicity * 100, 1) AS toxicity_pct, round(flag_rate_prompt_injection * 100, 1) AS injection_pct
FROM b""",
    ("requests",),
)
def volume_series(spark, sf):
    return stamped(metrics.volume_series(metrics.time_buckets(fx.requests(spark, sf), fx.AS_OF, "30d")))


def _histogram_sql(source: str, keys: str, column: str, bounds) -> str:
    parts = [(str(b), f"count(*) FILTER (WHERE {column} / CAST(1000 AS DOUBLE) <= {b})") for b in bounds]
    parts.append(("+Inf", "count(*)"))
    return " UNION ALL ".join(
        f"SELECT {keys}, '{le}' AS le, {expr} AS cumulative, count(*) AS n, "
        f"round(CAST(sum({column}) AS DOUBLE) / 1000, 6) AS sum_seconds FROM {source} "
        f"WHERE {column} IS NOT NULL GROUP BY {keys}"
        for le, expr in parts
    )


@query(
    "evaluator_latency_histogram",
    _histogram_sql("eval_calls", "evaluator, chain", "latency_ms", metrics.EVALUATOR_SECONDS),
    ("eval_calls",),
)
def evaluator_latency_histogram(spark, sf):
    return rounded(metrics.latency_histogram(fx.eval_calls(spark, sf), ["evaluator", "chain"]), 6)


@query(
    "model_latency_histogram",
    _histogram_sql("requests", "model", "latency_total", metrics.LLM_SECONDS),
    ("requests",),
)
def model_latency_histogram(spark, sf):
    hist = metrics.latency_histogram(
        fx.requests(spark, sf), ["model"], metrics.LLM_SECONDS, "latency_total"
    )
    return rounded(hist, 6)


_CALLS_SQL = """(SELECT id, model, CASE WHEN id % 2 = 0 THEN 'local' ELSE 'hosted' END AS provider, latency_total * 3 // 4 AS latency_llm,
  id % 41 = 0 AS failed FROM requests WHERE NOT blocked) c"""


def _llm_calls(spark, sf):
    """Model calls of requests that were not blocked, with the provider that answered."""
    i = F.col("id")
    return fx.requests(spark, sf).where(~F.col("blocked")).select(
        "id", "model", F.when(i % 2 == 0, "local").otherwise("hosted").alias("provider"),
        F.floor(F.col("latency_total") * 3 / 4).alias("latency_llm"), (i % 41 == 0).alias("failed"),
    )


@query(
    "llm_latency_histogram",
    _histogram_sql(_CALLS_SQL, "provider, model", "latency_llm", metrics.LLM_SECONDS),
    ("requests",),
)
def llm_latency_histogram(spark, sf):
    """Latency of the model call alone, by provider and model."""
    return rounded(metrics.latency_histogram(_llm_calls(spark, sf), ["provider", "model"], metrics.LLM_SECONDS, "latency_llm"), 6)


@query(
    "provider_error_counters",
    f"SELECT provider, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors FROM {_CALLS_SQL} GROUP BY provider",
    ("requests",),
)
def provider_error_counters(spark, sf):
    return metrics.counters(_llm_calls(spark, sf), ["provider"], {"calls": F.lit(True), "errors": F.col("failed")})


_SERVED = """CASE WHEN id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/v1/', model) AS path,
  CASE WHEN blocked THEN 400 WHEN id % 41 = 0 THEN 502 ELSE 200 END AS status_code"""


@query(
    "http_status_counters",
    f"SELECT method, path, status_code, count(*) AS requests FROM (SELECT {_SERVED} FROM requests) q GROUP BY ALL",
    ("requests",),
)
def http_status_counters(spark, sf):
    i = F.col("id")
    served = fx.requests(spark, sf).select(
        F.when(i % 3 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/v1/"), "model").alias("path"),
        F.when(F.col("blocked"), 400).when(i % 41 == 0, 502).otherwise(200).alias("status_code"),
    )
    return metrics.counters(served, ["method", "path", "status_code"], {"requests": F.lit(True)})


@query(
    "http_latency_histogram",
    _histogram_sql(
        "(SELECT 'POST' AS method, event_type AS path, CAST(floor(value * 20) AS BIGINT) AS ms FROM events) q",
        "method, path", "ms", metrics.HTTP_SECONDS,
    ),
)
def http_latency_histogram(spark, sf):
    served = fx.table(spark, sf, "events").select(
        F.lit("POST").alias("method"), F.col("event_type").alias("path"), F.floor(F.col("value") * 20).alias("ms")
    )
    return rounded(metrics.latency_histogram(served, ["method", "path"], metrics.HTTP_SECONDS, "ms"), 6)


@query(
    "llm_error_counters",
    """
SELECT model, count(*) FILTER (WHERE NOT blocked) AS calls, count(*) FILTER (WHERE NOT blocked AND id % 41 = 0) AS errors
FROM requests GROUP BY model""",
    ("requests",),
)
def llm_error_counters(spark, sf):
    sent = ~F.col("blocked")
    failed = sent & (F.col("id") % 41 == 0)
    return metrics.counters(fx.requests(spark, sf), ["model"], {"calls": sent, "errors": failed})


@query(
    "evaluator_counters",
    """
SELECT evaluator, count(*) FILTER (WHERE flag) AS flags, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
  count(*) FILTER (WHERE error = 'timeout') AS timeouts
FROM flagged_calls GROUP BY evaluator""",
    ("flagged_calls",),
)
def evaluator_counters(spark, sf):
    from bulwark.operators.chain import apply_thresholds, normalise_timeouts

    calls = apply_thresholds(normalise_timeouts(fx.eval_calls(spark, sf)))
    errored = F.col("error").isNotNull()
    return metrics.counters(
        calls,
        ["evaluator"],
        {"flags": F.col("flag"), "errors": errored, "timeouts": F.col("error") == "timeout"},
    )


# Window starts by recursion, one step per window of an identity.
_LIMITED = """WITH RECURSIVE log AS ({log}), wins AS (
  SELECT identity, min(arrival_ms) AS window_start FROM log GROUP BY identity
  UNION ALL
  SELECT w.identity, (SELECT min(l.arrival_ms) FROM log l
                      WHERE l.identity = w.identity AND l.arrival_ms >= w.window_start + 60000) AS window_start
  FROM wins w
  WHERE EXISTS (SELECT 1 FROM log l WHERE l.identity = w.identity AND l.arrival_ms >= w.window_start + 60000)
), placed AS (
  SELECT l.event_id, l.identity, l.arrival_ms, w.window_start,
         row_number() OVER (PARTITION BY l.identity, w.window_start ORDER BY l.arrival_ms, l.event_id) AS position
  FROM log l ASOF JOIN wins w ON l.identity = w.identity AND l.arrival_ms >= w.window_start
)
"""


def limited_sql(limit: int) -> str:
    from bulwark.plans.oracle_sql import TABLES

    return _LIMITED.format(log=TABLES["http_log"][1]) + f"""
SELECT event_id, identity, arrival_ms, window_start, position, position <= {limit} AS allowed,
  CASE WHEN position > {limit} THEN CAST(greatest(ceil((window_start + 60000 - arrival_ms) / 1000.0), 1) AS DOUBLE) END AS retry_after_s
FROM placed"""


@query("rate_limit_replay", limited_sql(30))
def rate_limit_replay(spark, sf):
    log = fx.http_log(spark, sf).select("event_id", "identity", "arrival_ms")
    return as_doubles(replay_limits(log, limit=30), "retry_after_s")


def _unknown_sql() -> str:
    from bulwark.plans.oracle_sql import TABLES

    named = f"""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN identity ELSE -1 END AS identity, arrival_ms
  FROM ({TABLES["http_log"][1]}) h WHERE event_id % 11 <> 0"""
    return _LIMITED.format(log=named) + f"""
SELECT event_id, CAST(CASE WHEN identity <> -1 THEN identity END AS DOUBLE) AS identity, CAST(arrival_ms AS DOUBLE) AS arrival_ms,
  CAST(window_start AS DOUBLE) AS window_start, CAST(position AS DOUBLE) AS position, CAST(position <= 5 AS DOUBLE) AS allowed FROM placed
UNION ALL SELECT event_id, CAST(CASE WHEN event_id % 7 <> 0 THEN identity END AS DOUBLE), NULL, NULL, NULL, NULL
FROM ({TABLES["http_log"][1]}) h WHERE event_id % 11 = 0"""


@query("rate_limit_unknown", _unknown_sql())
def rate_limit_unknown(spark, sf):
    """Callers without an identity share a window; events without a time pass undecided."""
    i = F.col("event_id")
    log = fx.http_log(spark, sf).select(
        "event_id", F.when(i % 7 != 0, F.col("identity")).alias("identity"), F.when(i % 11 != 0, F.col("arrival_ms")).alias("arrival_ms")
    )
    decided = replay_limits(log, limit=5).drop("retry_after_s").withColumn("allowed", F.col("allowed").cast("int"))
    return as_doubles(decided, "identity", "arrival_ms", "window_start", "position", "allowed")


@query(
    "http_counters",
    limited_sql(30).replace("SELECT event_id, identity, arrival_ms, window_start", ", limited AS (SELECT event_id, identity, arrival_ms, window_start", 1)
    + """)
SELECT identity, count(*) FILTER (WHERE allowed) AS status_200, count(*) FILTER (WHERE NOT allowed) AS status_429
FROM limited GROUP BY identity""",
)
def http_counters(spark, sf):
    log = replay_limits(fx.http_log(spark, sf).select("event_id", "identity", "arrival_ms"), limit=30)
    return metrics.counters(
        log, ["identity"], {"status_200": F.col("allowed"), "status_429": ~F.col("allowed")}
    )


@query(
    "outcome_report",
    """
SELECT CASE WHEN blocked THEN 'blocked' ELSE 'passed' END AS outcome, count(*) AS n,
  round(quantile_cont(latency_total, 0.5), 6) AS p50_ms, round(quantile_cont(latency_total, 0.95), 6) AS p95_ms,
  round(quantile_cont(latency_total, 0.99), 6) AS p99_ms
FROM requests GROUP BY 1""",
    ("requests",),
)
def outcome_report(spark, sf):
    outcome = F.when(F.col("blocked"), "blocked").otherwise("passed").alias("outcome")
    log = fx.requests(spark, sf).select(outcome, F.col("latency_total").alias("latency_ms"))
    return rounded(metrics.outcome_report(log), 6)


@query(
    "interpolated_percentiles",
    """
SELECT tenant_id, model, count(value) AS n, round(quantile_cont(value, 0.5), 9) AS p50,
  round(quantile_cont(value, 0.95), 9) AS p95, round(min(value), 9) AS p0, round(max(value), 9) AS p100
FROM (SELECT user_id % 4 AS tenant_id, concat('model-', CAST(user_id % 3 AS VARCHAR)) AS model, value FROM events) q
GROUP BY ALL""",
)
def interpolated_percentiles(spark, sf):
    values = fx.table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("tenant_id"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        "value",
    )
    return rounded(
        quantiles(values, ["tenant_id", "model"], "value", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    )


@query(
    "nearest_rank_p95",
    """
SELECT tenant_id, count(*) AS n, list_sort(list(latency_total))[CAST(floor(count(*) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95_ms
FROM requests GROUP BY tenant_id""",
    ("requests",),
)
def nearest_rank_p95(spark, sf):
    return nearest_ranks(fx.requests(spark, sf), ["tenant_id"], "latency_total", {"p95_ms": 0.95})


# History.


@query(
    "nested_requests",
    f"""
SELECT id, tenant_id, {FLAG_LIST} AS flags, {SCORES}, latency_total, blocked, block_reason, has_context, reviewed
FROM requests""",
    ("requests",),
)
def nested_requests(spark, sf):
    n = history.nested(fx.requests(spark, sf))
    return n.select(
        "id",
        "tenant_id",
        F.array_join("flags", ",").alias("flags"),
        *[F.col(f"scores.{e}").alias(f"score_{e}") for e in NAMES],
        F.col("latency_ms.total").alias("latency_total"),
        "blocked",
        "block_reason",
        "has_context",
        "reviewed",
    )


@query(
    "score_history",
    f"""
SELECT id, {stamp_sql("created_at")} AS created_at, {FLAG_LIST} AS flags, score_toxicity
FROM requests WHERE tenant_id = 1 AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND created_at <= TIMESTAMP '2024-01-20 00:00:00' AND {ANY_FLAG} AND flag_toxicity""",
    ("requests",),
)
def score_history(spark, sf):
    rows = history.score_history(
        fx.requests(spark, sf), 1, "2024-01-05 00:00:00", "2024-01-20 00:00:00", True, "toxicity"
    )
    nested = history.nested(rows)
    return stamped(
        nested.select(
            "id",
            "created_at",
            F.array_join("flags", ",").alias("flags"),
            F.col("scores.toxicity").alias("score_toxicity"),
        )
    )


@query(
    "request_lookup",
    """
SELECT id, tenant_id, model, block_reason FROM requests r
WHERE EXISTS (SELECT 1 FROM reviews v WHERE v.request_id = r.id AND (v.tenant_id + v.review_id % 2) % 4 = r.tenant_id)""",
    ("requests", "reviews"),
)
def request_lookup(spark, sf):
    """Odd review ids ask with another tenant's id, which finds nothing."""
    wanted = fx.reviews(spark, sf).select(
        F.col("request_id").alias("id"),
        ((F.col("tenant_id") + F.col("review_id") % 2) % 4).alias("tenant_id"),
    )
    found = history.by_ids(fx.requests(spark, sf), wanted)
    return found.select("id", "tenant_id", "model", "block_reason")


def _indexed_log(spark, sf):
    """The whole log stored in two appends; the index covers the first, the second is read directly."""
    log, index = scratch(spark, "indexed-log"), scratch(spark, "log-index")
    whole = fx.requests(spark, sf)
    tables.append_requests(whole.where("id % 3 <> 0"), log)
    log_index.refresh(spark, log, index)
    tables.append_requests(whole.where("id % 3 = 0"), log)
    return log, index


@query(
    "request_lookup_indexed",
    """
SELECT id, tenant_id, model, block_reason FROM requests r
WHERE EXISTS (SELECT 1 FROM reviews v WHERE v.request_id = r.id AND (v.tenant_id + v.review_id % 2) % 4 = r.tenant_id)""",
    ("requests", "reviews"),
)
def request_lookup_indexed(spark, sf):
    wanted = fx.reviews(spark, sf).select(
        F.col("request_id").cast("string").alias("id"),
        ((F.col("tenant_id") + F.col("review_id") % 2) % 4).cast("string").alias("tenant_id"),
    )
    found = log_index.lookup(spark, *_indexed_log(spark, sf), wanted)
    return found.select(F.col("id").cast("long"), F.col("tenant_id").cast("long"), "model", "block_reason")


@query(
    "history_page_indexed",
    f"""
SELECT CAST(id AS VARCHAR) AS id, {stamp_sql("created_at")} AS created_at, latency_total,
  (SELECT count(*) FROM requests WHERE tenant_id = 1) AS total
FROM requests WHERE tenant_id = 1 ORDER BY requests.created_at DESC, CAST(id AS VARCHAR) DESC LIMIT 50 OFFSET 100""",
    ("requests",),
)
def history_page_indexed(spark, sf):
    log, index = _indexed_log(spark, sf)
    log_index.refresh(spark, log, index)
    rows = log_index.page(spark, log, index, page=3, limit=50, tenant_id="1").select("id", "created_at", "latency_total")
    return stamped(rows.withColumn("total", log_index.total(spark, log, index, "1").scalar()))


@query(
    "review_queue",
    f"""
SELECT id, {stamp_sql("created_at")} AS created_at, tenant_id, {FLAG_LIST} AS flags
FROM requests WHERE tenant_id = 2 AND NOT reviewed AND {ANY_FLAG} ORDER BY created_at, id LIMIT 20""",
    ("requests",),
)
def review_queue(spark, sf):
    queue = history.review_queue(fx.requests(spark, sf), tenant_id=2)
    flags = F.array_join(history.flag_names(), ",").alias("flags")
    return stamped(queue.select("id", "created_at", "tenant_id", flags))


@query(
    "flagged_view",
    f"""
SELECT id, {stamp_sql("created_at")} AS created_at, model, CAST(NULL AS VARCHAR) AS input_redacted, blocked, block_reason,
  {ROUNDED_SCORES}, {FLAGS}, latency_total, reviewed, CAST(NULL AS VARCHAR) AS review_label
FROM requests WHERE {ANY_FLAG} OR blocked""",
    ("requests",),
)
def flagged_view(spark, sf):
    return stamped(rounded(history.flagged_view(fx.requests(spark, sf))))


@query(
    "history_page",
    f"""
SELECT id, {stamp_sql("created_at")} AS created_at, tenant_id, latency_total, (SELECT count(*) FROM requests) AS total
FROM requests ORDER BY requests.created_at DESC, id DESC LIMIT 50 OFFSET 100""",
    ("requests",),
)
def history_page(spark, sf):
    log = fx.requests(spark, sf).select("id", "created_at", "tenant_id", "latency_total")
    rows = history.page(log, page=3, limit=50)
    return stamped(rows.withColumn("total", history.total(log).scalar()))


@query(
    "history_page_after",
    f"""
SELECT id, {stamp_sql("created_at")} AS created_at, tenant_id FROM requests
WHERE created_at < TIMESTAMP '2024-01-15 12:00:00' OR (created_at = TIMESTAMP '2024-01-15 12:00:00' AND id < 5000)
ORDER BY requests.created_at DESC, id DESC LIMIT 200""",
    ("requests",),
)
def history_page_after(spark, sf):
    log = fx.requests(spark, sf).select("id", "created_at", "tenant_id")
    return stamped(history.page_after(log, "2024-01-15 12:00:00", 5000, 200))


@query(
    "newest_feed",
    f"""
SELECT id, tenant_id, {stamp_sql("created_at")} AS created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rank FROM requests) q
WHERE rank <= 100""",
    ("requests",),
)
def newest_feed(spark, sf):
    feed = history.newest(fx.requests(spark, sf).select("id", "tenant_id", "created_at"))
    return stamped(feed).withColumn("rank", F.col("rank").cast("long"))


@query(
    "reviews_applied",
    f"""
SELECT r.id, r.tenant_id, (v.request_id IS NOT NULL OR r.reviewed) AS reviewed, v.label AS review_label,
  {stamp_sql("v.reviewed_at")} AS reviewed_at
FROM requests r LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY reviewed_at DESC, review_id DESC) AS rn
  FROM reviews WHERE label IN ('correct_flag', 'false_positive', 'false_negative')) v
ON v.request_id = r.id AND v.tenant_id = r.tenant_id AND v.rn = 1""",
    ("requests", "reviews"),
)
def reviews_applied(spark, sf):
    applied = history.apply_reviews(fx.requests(spark, sf), fx.reviews(spark, sf))
    return stamped(applied.select("id", "tenant_id", "reviewed", "review_label", "reviewed_at"))


@query(
    "reviews_merged",
    f"""
SELECT r.id, r.tenant_id, (v.request_id IS NOT NULL OR r.reviewed) AS reviewed, v.label AS review_label,
  {stamp_sql("v.reviewed_at")} AS reviewed_at, strftime(r.created_at, '%Y-%m-%d') AS dt
FROM requests r LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY reviewed_at DESC, review_id DESC) AS rn
  FROM reviews WHERE label IN ('correct_flag', 'false_positive', 'false_negative')) v
ON v.request_id = r.id AND v.tenant_id = r.tenant_id AND v.rn = 1""",
    ("requests", "reviews"),
)
def reviews_merged(spark, sf):
    """Reviews written into the stored log, day by day; the index says which days."""
    log, index = _indexed_log(spark, sf)
    merge.merge_reviews(spark, log, fx.reviews(spark, sf).withColumns(
        {"request_id": F.col("request_id").cast("string"), "tenant_id": F.col("tenant_id").cast("string")}
    ), index)
    rows = spark.read.parquet(log).select(
        F.col("id").cast("long"), F.col("tenant_id").cast("long"), "reviewed", "review_label", "reviewed_at",
        F.col("dt").cast("string").alias("dt"),
    )
    return stamped(rows)


@query(
    "review_label_violations",
    "SELECT review_id, request_id, label FROM reviews WHERE label NOT IN ('correct_flag', 'false_positive', 'false_negative')",
    ("reviews",),
)
def review_label_violations(spark, sf):
    return history.review_violations(fx.reviews(spark, sf)).select("review_id", "request_id", "label")


# Stored tables.

_BROKEN = """
  SELECT * REPLACE (CASE WHEN id % 31 = 0 THEN score_toxicity + 1 ELSE score_toxicity END AS score_toxicity,
                    CASE WHEN id % 37 = 0 THEN NULL ELSE model END AS model) FROM requests"""


@query(
    "request_violations",
    f""", broken AS ({_BROKEN})
SELECT id, concat_ws(',', CASE WHEN NOT score_toxicity BETWEEN 0 AND 1 THEN 'score_toxicity_range' END,
                     CASE WHEN model IS NULL THEN 'model_null' END) AS violations
FROM broken WHERE NOT coalesce(score_toxicity BETWEEN 0 AND 1, true) OR model IS NULL""",
    ("requests",),
)
def request_violations(spark, sf):
    i = F.col("id")
    broken = fx.requests(spark, sf).withColumns(
        {
            "score_toxicity": F.when(i % 31 == 0, F.col("score_toxicity") + 1).otherwise(F.col("score_toxicity")),
            "model": F.when(i % 37 != 0, F.col("model")),
        }
    )
    _, bad = validation.split(broken, validation.request_checks(broken))
    return bad.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "duplicate_run_labels",
    "SELECT tenant_id, model AS label, count(*) AS n_rows FROM eval_runs_by_model GROUP BY ALL HAVING count(*) > 1".replace(
        "eval_runs_by_model", "(SELECT DISTINCT tenant_id, model, date_trunc('day', created_at) FROM requests) q"
    ),
    ("requests",),
)
def duplicate_run_labels(spark, sf):
    """Runs labelled by model only, so that a model's days collide."""
    label = F.substring_index("label", "/", 1).alias("label")
    return validation.duplicates(fx.eval_runs(spark, sf).select("tenant_id", label), ["tenant_id", "label"])


@query(
    "request_log_append",
    """
SELECT strftime(created_at, '%Y-%m-%d') AS dt, count(*) AS n, count(*) FILTER (WHERE blocked) AS blocked,
  round(sum(coalesce(score_pii, 0)), 6) AS pii FROM requests GROUP BY 1""",
    ("requests",),
)
def request_log_append(spark, sf):
    path = scratch(spark, "request-log")
    tables.append_requests(fx.requests(spark, sf), path)
    stored = spark.read.parquet(path)
    grouped = stored.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count("*").alias("n"),
        F.count_if("blocked").alias("blocked"),
        F.sum(F.coalesce("score_pii", F.lit(0.0))).alias("pii"),
    )
    return rounded(grouped, 6)


@query(
    "tenant_backfill",
    "SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE tenant_id END AS tenant_id FROM requests",
    ("requests",),
)
def tenant_backfill(spark, sf):
    tenant = F.when(F.col("id") % 7 != 0, F.col("tenant_id")).alias("tenant_id")
    partial = fx.requests(spark, sf).select("id", tenant)
    return tenancy.backfill_tenant(partial, fx.tenants(spark))


@query(
    "scored_request_events",
    f"""
SELECT CASE WHEN blocked THEN 'request_blocked' ELSE 'request_passed' END AS event_type,
  CAST(id AS VARCHAR) AS request_id, CAST(tenant_id AS VARCHAR) AS tenant_id, model, blocked, block_reason,
  {FLAG_LIST} AS flags, score_pii, score_faithfulness, latency_total FROM requests""",
    ("requests",),
)
def scored_request_events(spark, sf):
    """Events written as JSON and parsed back."""
    parsed = events.parse_events(events.event_json(fx.requests(spark, sf)))
    return parsed.select(
        "event_type",
        "request_id",
        "tenant_id",
        "model",
        "blocked",
        "block_reason",
        F.array_join("flags", ",").alias("flags"),
        F.col("scores.pii").alias("score_pii"),
        F.col("scores.faithfulness").alias("score_faithfulness"),
        "latency_total",
    )


# Tenants.

_RESOLVED = """
  SELECT l.event_id, l.ts, sha256(l.api_key) AS key_hash, k.tenant_id AS tenant_id, k.key_hash IS NOT NULL AS known, l.api_key
  FROM http_log l LEFT JOIN api_keys k
    ON k.key_hash = sha256(l.api_key) AND (k.revoked_at IS NULL OR l.ts < k.revoked_at)"""


@query(
    "tenant_resolution",
    f""", r AS ({_RESOLVED})
SELECT event_id, CAST(CASE WHEN api_key = 'h5' THEN 0 ELSE tenant_id END AS DOUBLE) AS tenant_id,
  CASE WHEN api_key = 'h5' THEN 'master' WHEN known THEN 'resolved' ELSE 'rejected' END AS auth_status FROM r""",
    ("http_log", "api_keys"),
)
def tenant_resolution(spark, sf):
    resolved = tenancy.resolve_tenants(
        fx.http_log(spark, sf), fx.api_keys(spark), fx.tenants(spark), master_key="h5"
    )
    return as_doubles(resolved, "tenant_id").select("event_id", "tenant_id", "auth_status")


@query(
    "tenant_resolution_open",
    f""", r AS ({_RESOLVED})
SELECT event_id, coalesce(tenant_id, 0) AS tenant_id, CASE WHEN known THEN 'resolved' ELSE 'default' END AS auth_status FROM r""",
    ("http_log", "api_keys"),
)
def tenant_resolution_open(spark, sf):
    resolved = tenancy.resolve_tenants(
        fx.http_log(spark, sf), fx.api_keys(spark), fx.tenants(spark), auth_required=False
    )
    return resolved.select("event_id", "tenant_id", "auth_status")


@query(
    "key_usage",
    f""", r AS ({_RESOLVED})
SELECT k.key_prefix, k.tenant_id, concat('tenant-', k.tenant_id) AS tenant_slug,
  CASE WHEN k.revoked_at IS NULL THEN 'active' ELSE 'revoked' END AS status,
  {stamp_sql("max(r.ts)")} AS last_used_at, count(r.event_id) AS n_calls
FROM api_keys k LEFT JOIN r ON r.known AND r.key_hash = k.key_hash GROUP BY ALL""",
    ("http_log", "api_keys"),
)
def key_usage(spark, sf):
    log = fx.http_log(spark, sf).select(F.sha2("api_key", 256).alias("key_hash"), "ts")
    return stamped(tenancy.key_usage(fx.api_keys(spark), fx.tenants(spark), log))


@query(
    "tenant_insert",
    """
SELECT 'model-0' AS slug, CAST(-1 AS BIGINT) AS n UNION ALL SELECT model, min(id) FROM requests WHERE model <> 'model-0' GROUP BY model""",
    ("requests",),
)
def tenant_insert(spark, sf):
    """Insert, do nothing on conflict: very many new rows with a few keys."""
    rows = fx.requests(spark, sf).select(F.col("model").alias("slug"), F.col("id").alias("n"))
    table = rows.where(F.col("slug") == "model-0").select("slug", F.lit(-1).cast("long").alias("n")).distinct()
    return tenancy.insert_if_absent(table, rows, "slug")


_UUID_TEXT = """CASE id % 5 WHEN 0 THEN h WHEN 1 THEN concat('{', upper(h), '}') WHEN 2 THEN concat('urn:uuid:', h)
  WHEN 3 THEN left(h, 31) ELSE 'none' END"""


@query(
    "public_identifiers",
    f""", i AS (SELECT id, md5(CAST(id AS VARCHAR)) AS h FROM requests), t AS (SELECT id, h, {_UUID_TEXT} AS given FROM i)
SELECT id, CASE WHEN id % 5 < 3 THEN concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) END AS uuid,
  concat('sk-', left(h, 17)) AS shown FROM t""",
    ("requests",),
)
def public_identifiers(spark, sf):
    """Request ids in the forms clients send, and the part of a key that may be shown."""
    h = F.md5(F.col("id").cast("string"))
    hashed = fx.requests(spark, sf).select("id", h.alias("h")).selectExpr("*", f"{_UUID_TEXT} AS given")
    key = F.concat(F.lit("sk-"), "h")
    return hashed.select("id", uuid_or_null(F.col("given")).alias("uuid"), key_prefix(key).alias("shown"))
