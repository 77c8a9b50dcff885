"""Rolling health of a deployment and threshold alerts, in batch and streaming."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.numeric import rate

# Default alert limits, smallest sample that can alert, nearest-rank quantile.
LIMITS = {
    "error_rate": 0.10,
    "block_rate": 0.50,
    "evaluator_failure_rate": 0.10,
    "p95_latency_ms": 10_000,
}
MIN_SAMPLES = 10
P95 = 0.95


def _nearest_rank(pairs: Column, p: float) -> Column:
    """``sorted[int(n * p)]`` from an array of (latency_ms, n) counts; 0 when empty.

    The array holds one entry per minute and distinct latency, however many requests there were.
    """
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # The rank travels in the accumulator: inside the lambda it would be computed per element.
    start = F.struct(
        F.lit(0).cast("long").alias("seen"),
        F.lit(None).cast("int").alias("value"),
        F.floor(total * F.lit(p)).alias("rank"),
    )

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["n"]
        first = a["value"].isNull() & (seen > a["rank"])
        value = F.when(first, x["latency_ms"]).otherwise(a["value"])
        return F.struct(seen.alias("seen"), value.alias("value"), a["rank"].alias("rank"))

    found = F.aggregate(F.sort_array(pairs), start, step, lambda a: a["value"])
    return F.coalesce(found, F.lit(0))


def _counted(events: DataFrame, *keys: Column) -> DataFrame:
    """Events collapsed per kind and, for requests, latency."""
    latency = F.when(F.col("kind") == "request", F.col("latency_ms"))
    return events.groupBy(*keys, "kind", latency.alias("latency_ms")).agg(
        F.count("*").alias("n"),
        F.count_if("blocked").alias("n_blocked"),
        F.count_if("errored").alias("n_errored"),
    )


def _totals() -> list[Column]:
    """Aggregates over collapsed events."""

    def total(kind: str, column: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    has_latency = (F.col("kind") == "request") & F.col("latency_ms").isNotNull()
    return [
        total("request").alias("request_count"),
        total("request", "n_blocked").alias("_blocked"),
        total("llm_call").alias("llm_call_count"),
        total("llm_call", "n_errored").alias("_llm_errors"),
        total("evaluator").alias("evaluator_call_count"),
        total("evaluator", "n_errored").alias("_failures"),
        F.collect_list(F.when(has_latency, F.struct("latency_ms", "n"))).alias("_latencies"),
    ]


def _measures() -> list[Column]:
    """Health columns from the totals."""
    return [
        F.col("request_count"),
        rate(F.col("_blocked"), F.col("request_count")).alias("block_rate"),
        F.col("llm_call_count"),
        rate(F.col("_llm_errors"), F.col("llm_call_count")).alias("llm_error_rate"),
        F.col("evaluator_call_count"),
        rate(F.col("_failures"), F.col("evaluator_call_count")).alias("evaluator_failure_rate"),
        _nearest_rank(F.col("_latencies"), P95).alias("p95_latency_ms"),
    ]


def snapshot(events: DataFrame, as_of, window: str = "15 minutes") -> DataFrame:
    """Health of the window that ends at ``as_of``, both ends included; always one row."""
    kind = events.schema["ts"].dataType
    end = F.lit(as_of).cast(kind)
    start = (end - F.expr(f"INTERVAL {window}")).cast(kind)
    recent = events.where((F.col("ts") >= start) & (F.col("ts") <= end))
    return _counted(recent).agg(*_totals()).select(*_measures())


def rolling_health(
    events: DataFrame,
    window: str = "15 minutes",
    slide: str = "1 minute",
    watermark: str | None = None,
) -> DataFrame:
    """Sliding-window health from (ts, kind, blocked, errored, latency_ms).

    Events first collapse to one-minute panes per kind and latency, so the 15-fold window
    assignment applies to panes and not to events, and state grows with distinct latencies.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    panes = _counted(events, F.window("ts", slide).alias("pane"))
    timed = panes.select("*", F.window_time("pane").alias("pane_time"))
    grouped = timed.groupBy(F.window("pane_time", window, slide).alias("w")).agg(*_totals())
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_measures()
    )


def alerts(health: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Breached limits of each window as rows (ord, check, value, limit, samples).

    A check needs enough samples of its own kind and breaches strictly above its limit.
    """
    limits = {**LIMITS, **(limits or {})}
    checks = (
        ("error_rate", "llm_error_rate", "llm_call_count"),
        ("block_rate", "block_rate", "request_count"),
        ("p95_latency_ms", "p95_latency_ms", "request_count"),
        ("evaluator_failure_rate", "evaluator_failure_rate", "evaluator_call_count"),
    )

    def breach(ord: int, name: str, value: str, samples: str) -> Column:
        limit = F.lit(float(limits[name]))
        hit = (F.col(samples) >= MIN_SAMPLES) & (F.col(value) > limit)
        row = F.struct(
            F.lit(ord).alias("ord"),
            F.lit(name).alias("check"),
            F.col(value).cast("double").alias("value"),
            limit.alias("limit"),
            F.col(samples).alias("samples"),
        )
        return F.when(hit, row)

    breaches = F.array_compact(F.array(*[breach(i, *c) for i, c in enumerate(checks)]))
    return health.select("window_start", "window_end", F.inline(breaches))
