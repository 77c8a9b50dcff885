"""Dashboard aggregates over the request log and the call log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import NAMES, SCORECARD_NAMES
from bulwark.functions.flags import any_flag
from bulwark.functions.numeric import int_from_float, int_from_numeric, rate
from bulwark.operators.history import in_time

# Look-back windows, bucket truncation and histogram bounds in seconds.
LOOKBACK = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}
TRUNCATION = {"5m": "minute", "15m": "minute", "1h": "hour", "6h": "hour", "1d": "day"}
EXACT_WIDTH = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}
EVALUATOR_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
LLM_SECONDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
HTTP_SECONDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def since(requests: DataFrame, as_of, window: str = "24h") -> DataFrame:
    """Rows of the look-back window ending at ``as_of``; an unknown window means 24 hours."""
    kind = requests.schema["created_at"].dataType
    span = F.expr(f"INTERVAL {LOOKBACK.get(window, LOOKBACK['24h'])}")
    return in_time(requests, start=F.lit(as_of).cast(kind) - span)


def bucket_start(requests: DataFrame, bucket: str, exact: bool = False) -> Column:
    """Bucket of ``created_at``. Sub-hour buckets truncate to the minute and 6h to the hour,
    as the log's dashboard does; ``exact`` gives real widths."""
    kind = requests.schema["created_at"].dataType
    if exact:
        return F.window("created_at", EXACT_WIDTH.get(bucket, EXACT_WIDTH["1h"]))["start"]
    return F.date_trunc(TRUNCATION.get(bucket, "hour"), F.col("created_at")).cast(kind)


def bucket_aggregates(approx: bool = False, digits: int | None = 4) -> list[Column]:
    """The per-bucket measures, shared by batch and streaming."""

    def shown(x: Column) -> Column:
        return x if digits is None else F.round(x, digits)

    n = F.count("*")
    # Latency is an integer count of milliseconds, so the exact percentile's value map is
    # bounded by the latency range, however many rows a bucket holds.
    p95 = (
        F.percentile_approx("latency_total", 0.95, 10000).cast("double")
        if approx
        else F.percentile("latency_total", F.lit(0.95))
    )
    return [
        n.alias("request_count"),
        F.count_if("blocked").alias("blocked_count"),
        shown(F.avg("score_toxicity")).alias("avg_toxicity"),
        shown(F.avg("score_relevance")).alias("avg_relevance"),
        shown(F.avg("score_hallucination")).alias("avg_hallucination"),
        *[shown(rate(F.count_if(f"flag_{e}"), n)).alias(f"flag_rate_{e}") for e in NAMES],
        F.coalesce(int_from_float(p95), F.lit(0)).alias("p95_latency_total"),
    ]


def time_buckets(
    requests: DataFrame,
    as_of,
    window: str = "24h",
    bucket: str = "1h",
    tenant_id=None,
    exact_buckets: bool = False,
    approx: bool = False,
    digits: int | None = 4,
) -> DataFrame:
    """Per tenant and bucket: volume, blocks, average scores, flag rates and p95 latency."""
    scoped = since(requests, as_of, window)
    if tenant_id is not None:
        scoped = scoped.where(F.col("tenant_id") == F.lit(tenant_id))
    start = bucket_start(scoped, bucket, exact_buckets).alias("bucket_start")
    return scoped.groupBy("tenant_id", start).agg(*bucket_aggregates(approx, digits))


def summary(requests: DataFrame, as_of, tenant_id=None, digits: int | None = 4) -> DataFrame:
    """24-hour totals per tenant; with ``tenant_id``, always exactly one row."""
    scoped = since(requests, as_of, "24h")
    blocked, n = F.count_if("blocked"), F.count("*")
    block_rate = rate(blocked, n)
    measures = [
        n.alias("total_requests_24h"),
        blocked.alias("blocked_requests_24h"),
        (block_rate if digits is None else F.round(block_rate, digits)).alias("block_rate_24h"),
        F.coalesce(int_from_numeric(F.avg("latency_total")), F.lit(0)).alias("avg_latency_24h_ms"),
        F.count_if(~F.col("reviewed") & any_flag()).alias("unreviewed_flags"),
    ]
    if tenant_id is not None:
        return scoped.where(F.col("tenant_id") == F.lit(tenant_id)).agg(*measures)
    return scoped.groupBy("tenant_id").agg(*measures)


def flag_counts(requests: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """(keys, ord, evaluator, cnt): all evaluators counted in one pass, then turned to rows."""
    counted = requests.groupBy(*keys).agg(*[F.count_if(f"flag_{e}").alias(e) for e in NAMES])
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(e).alias("evaluator"), F.col(e).alias("cnt"))
            for i, e in enumerate(NAMES)
        ]
    )
    return counted.select(*keys, F.inline(entries))


def top_flag(requests: DataFrame, as_of, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """The evaluator with most flags in the last 24 hours, NULL when nothing was flagged."""
    counts = flag_counts(since(requests, as_of, "24h"), keys)
    seen = F.when(F.col("cnt") > 0, F.col("evaluator"))
    best = F.max_by(seen, F.struct(F.col("cnt"), -F.col("ord")))
    return counts.groupBy(*keys).agg(best.alias("top_flag_reason"), F.max("cnt").alias("top_flag_count"))


def flag_rate_series(buckets: DataFrame, names: Iterable[str] = SCORECARD_NAMES) -> DataFrame:
    """Unweighted mean of the bucket rates per evaluator, in percent; 0 without buckets."""
    names = list(names)
    means = buckets.agg(*[F.coalesce(F.avg(f"flag_rate_{e}"), F.lit(0.0)).alias(e) for e in names])
    entries = F.array(
        *[
            F.struct(F.lit(e).alias("evaluator"), F.round(F.col(e) * 100, 2).alias("rate_pct"))
            for e in names
        ]
    )
    return means.select(F.inline(entries))


def volume_series(buckets: DataFrame) -> DataFrame:
    """Requests, blocks and two flag rates in percent per bucket."""
    return buckets.select(
        "tenant_id",
        "bucket_start",
        F.col("request_count").alias("requests"),
        F.col("blocked_count").alias("blocked"),
        F.round(F.col("flag_rate_toxicity") * 100, 1).alias("toxicity_pct"),
        F.round(F.col("flag_rate_prompt_injection") * 100, 1).alias("injection_pct"),
    )


def latency_histogram(
    calls: DataFrame,
    keys: Sequence[str],
    bounds: Sequence[float] = EVALUATOR_SECONDS,
    latency_ms: str = "latency_ms",
) -> DataFrame:
    """Cumulative counts per upper bound in seconds, with the sum and the total count."""
    seconds = F.col(latency_ms) / F.lit(1000.0)
    timed = calls.where(F.col(latency_ms).isNotNull())
    counted = timed.groupBy(*keys).agg(
        *[F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("n"),
        (F.sum(F.col(latency_ms).cast("long")) / F.lit(1000.0)).alias("sum_seconds"),
    )
    entries = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative")))
    return counted.select(*keys, F.inline(F.array(*entries)), "n", "sum_seconds")


def counters(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Counts per key, one column per named condition."""
    return df.groupBy(*keys).agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def outcome_report(df: DataFrame, outcome: str = "outcome", latency: str = "latency_ms") -> DataFrame:
    """Count and latency p50, p95 and p99 per outcome (integer milliseconds)."""
    p = F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return (
        df.groupBy(outcome)
        .agg(F.count("*").alias("n"), p.alias("p"))
        .select(
            outcome,
            "n",
            F.col("p")[0].alias("p50_ms"),
            F.col("p")[1].alias("p95_ms"),
            F.col("p")[2].alias("p99_ms"),
        )
    )
