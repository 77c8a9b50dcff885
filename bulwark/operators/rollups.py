"""Minute rollups of the request log: counts and sums that add up to buckets of any width.

One row per (tenant_id, minute) and write: how many requests, blocks and flags, the sum and number of each
shown score, and the latencies as exact sparse counts, one entry per distinct millisecond value
of that minute. Rows of the same minute from several writes add up, so a batch or micro-batch only appends, a
bucket shows before it is closed, and a late request counts once its batch is in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bulwark.catalog import NAMES
from bulwark.functions.numeric import int_from_float, rate
from bulwark.operators import metrics

#: Scores whose averages the buckets show.
SCORES = ("toxicity", "relevance", "hallucination")


def _sums(names: Sequence[str]) -> list[str]:
    return [
        "request_count", "blocked_count",
        *[f"sum_{s}" for s in SCORES], *[f"n_{s}" for s in SCORES], *[f"flagged_{n}" for n in names],
    ]


def minute_rollups(requests: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """Rollup rows of some requests, in two steps so that a busy minute counts its latencies in parts.

    Requests without a time make a row with a NULL minute.
    """
    by = ["tenant_id", "minute"]
    minute = F.date_trunc("minute", "created_at").cast(requests.schema["created_at"].dataType)
    per_latency = requests.withColumn("minute", minute).groupBy(*by, "latency_total").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("blocked").alias("blocked_count"),
        *[F.sum(f"score_{s}").alias(f"sum_{s}") for s in SCORES],
        *[F.count(f"score_{s}").alias(f"n_{s}") for s in SCORES],
        *[F.count_if(f"flag_{n}").alias(f"flagged_{n}") for n in names],
    )
    counted = F.struct(F.col("latency_total").alias("ms"), F.col("request_count").alias("n"))
    return per_latency.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _sums(names)],
        F.collect_list(F.when(F.col("latency_total").isNotNull(), counted)).alias("latencies"),
    )


def append(requests: DataFrame, path: str, names: Sequence[str] = NAMES) -> None:
    """Add a batch of requests to the rollups at ``path``, partitioned by day."""
    rows = minute_rollups(requests, names).withColumn("dt", F.to_date("minute"))
    rows.hint("rebalance", "dt").write.partitionBy("dt").mode("append").parquet(path)


def append_stream(requests: DataFrame, path: str, checkpoint: str, names: Sequence[str] = NAMES) -> StreamingQuery:
    """The same for a stream. Each micro-batch has a folder, which a repeated one overwrites."""

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = minute_rollups(batch, names).withColumn("dt", F.to_date("minute"))
        rows.hint("rebalance", "dt").write.partitionBy("dt").mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged(rollups: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """One row per tenant and minute of rollups from many writes: what compaction writes back."""
    by = ["tenant_id", "minute"]
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    parts = rollups.select(*by, *_sums(names), F.posexplode_outer("latencies"))
    per_latency = parts.groupBy(*by, F.col("col.ms").alias("ms")).agg(
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in _sums(names)], F.sum("col.n").alias("n")
    )
    return per_latency.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _sums(names)],
        F.collect_list(F.when(F.col("ms").isNotNull(), F.struct("ms", "n"))).alias("latencies"),
    )


def time_buckets(
    rollups: DataFrame,
    as_of,
    window: str = "24h",
    bucket: str = "1h",
    tenant_id=None,
    exact_buckets: bool = False,
    digits: int | None = 4,
    names: Sequence[str] = NAMES,
) -> DataFrame:
    """What ``metrics.time_buckets`` gives, from rollups of any number of writes and in one shuffle.

    The look-back starts at the whole minute of ``as_of`` less the window; with ``as_of`` on a whole minute the
    results are equal. Percentiles are exact: counts of equal latencies add up.
    """
    kind = rollups.schema["minute"].dataType
    at = rollups.withColumnRenamed("minute", "created_at")
    scoped = metrics.since(at, F.date_trunc("minute", F.lit(as_of).cast(kind)), window)
    if tenant_id is not None:
        scoped = scoped.where(F.col("tenant_id") == F.lit(tenant_id))
    start = metrics.bucket_start(scoped, bucket, exact_buckets).alias("bucket_start")
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    parts = scoped.select("tenant_id", start, *_sums(names), F.posexplode_outer("latencies"))
    p95 = F.percentile("col.ms", F.lit(0.95), F.col("col.n"))
    added = parts.groupBy("tenant_id", "bucket_start").agg(
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in _sums(names)], p95.alias("p95")
    )

    def shown(x: Column) -> Column:
        return x if digits is None else F.round(x, digits)

    def mean(score: str) -> Column:
        return F.col(f"sum_{score}") / F.nullif(F.col(f"n_{score}"), F.lit(0))

    return added.select(
        "tenant_id",
        "bucket_start",
        "request_count",
        "blocked_count",
        *[shown(mean(s)).alias(f"avg_{s}") for s in SCORES],
        *[shown(rate(F.col(f"flagged_{n}"), F.col("request_count"))).alias(f"flag_rate_{n}") for n in names],
        F.coalesce(int_from_float(F.col("p95")), F.lit(0)).alias("p95_latency_total"),
    )
