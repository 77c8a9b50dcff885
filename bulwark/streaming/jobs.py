"""Structured Streaming jobs. Each takes a streaming frame and a checkpoint location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bulwark.operators import cache
from bulwark.operators.metrics import EXACT_WIDTH, bucket_aggregates
from bulwark.operators.ratelimit import DEFAULT_LIMIT, WINDOW_MS, last_windows, replay_limits
from bulwark.operators.scoring import Scorer, score_all
from bulwark.session import SMALL, stored
from bulwark.sources import snapshots
from bulwark.sources.events import parse_events
from bulwark.streaming.health import alerts, rolling_health

WATERMARK = "10 minutes"


def to_parquet(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Append results to Parquet, taking all available input and stopping."""
    writer = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def health(events: DataFrame, watermark: str = WATERMARK, **window: str) -> DataFrame:
    """Rolling health of windows closed by the watermark."""
    return rolling_health(events, watermark=watermark, **window)


def health_alerts(events: DataFrame, limits=None, watermark: str = WATERMARK, **window: str) -> DataFrame:
    return alerts(health(events, watermark, **window), limits)


def bucket_metrics(
    requests: DataFrame,
    bucket: str = "1h",
    watermark: str = WATERMARK,
    approx: bool = False,
    digits: int | None = 4,
) -> DataFrame:
    """Bucket metrics per tenant, emitted once a bucket is closed."""
    width = EXACT_WIDTH.get(bucket, EXACT_WIDTH["1h"])
    grouped = (
        requests.withWatermark("created_at", watermark)
        .groupBy("tenant_id", F.window("created_at", width).alias("w"))
        .agg(*bucket_aggregates(approx, digits))
    )
    return grouped.withColumn("bucket_start", F.col("w.start")).drop("w")


def _open_windows(spark: SparkSession, state: str, folders: list[dict], horizon: int | None) -> DataFrame | None:
    """Each caller's newest window in the folders, without those that started by the horizon."""
    if not folders:
        return None
    rows = spark.read.parquet(*[f"{state}/{f['name']}" for f in folders])
    newest = F.max(F.struct("window_start", "count")).alias("w")
    return rows.where(F.col("window_start") > horizon).groupBy("identity").agg(newest).select("identity", "w.*")


def rate_limits(
    log: DataFrame,
    path: str,
    checkpoint: str,
    limit: int = DEFAULT_LIMIT,
    width_ms: int = WINDOW_MS,
    lateness_ms: int = 600_000,
) -> StreamingQuery:
    """Allow or reject each call of (event_id, identity, arrival_ms) as it arrives.

    A keyed state operator would put all calls of one caller in one task. Here each micro-batch is
    decided by the parallel replay, going on from the open windows of its own callers. Decisions go to
    ``path/decisions``, in one folder per micro-batch, so a repeated batch overwrites its own output.

    State in ``path/state`` is a log (``sources.snapshots``): a micro-batch adds one row per caller it
    holds, and nothing for the others. Folders of like size fold into one that keeps each caller's
    newest window. A window that ended more than ``lateness_ms`` before the newest one opened is
    forgotten: its row is not read, and a folder that has no younger one leaves the log and is deleted.
    An event from before that horizon may open a window of its own, and its ``late`` is true.
    """
    state = f"{path}/state"

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = snapshots.numbers(spark, state)
        if batch_id + 1 in known and snapshots.load(spark, state, batch_id + 1):
            return
        before = [n for n in known if n <= batch_id]
        version = snapshots.load(spark, state, before[-1]) if before else {"latest": None, "folders": []}
        latest, folders = version["latest"], version["folders"]
        held = _open_windows(spark, state, folders, None if latest is None else latest - width_ms - lateness_ms)
        if held is not None:
            callers = batch.select(F.col("identity").alias("_who")).distinct()
            held = stored(held.join(callers, F.col("identity").eqNullSafe(F.col("_who")), "left_semi"), "windows")
        late = F.lit(False) if latest is None else F.coalesce(F.col("arrival_ms") < latest - lateness_ms, F.lit(False))
        decided = replay_limits(batch, limit=limit, width_ms=width_ms, carried=held).withColumn("late", late)
        out = f"{path}/decisions/batch={batch_id}"
        decided.write.mode("overwrite").parquet(out)

        def added(rows: DataFrame, name: str, level: int) -> list[dict]:
            rows.write.mode("overwrite").parquet(f"{state}/{name}")
            newest = spark.read.parquet(f"{state}/{name}").agg(F.max("window_start")).first()[0]
            return [] if newest is None else [{"name": name, "level": level, "latest": newest}]

        folders = folders + added(last_windows(spark.read.parquet(out), held), f"delta-{batch_id:012d}", 0)
        latest = max((f["latest"] for f in folders), default=latest)
        horizon = None if latest is None else latest - width_ms - lateness_ms
        folders = [f for f in folders if f["latest"] > horizon]
        alike = snapshots.due(folders)
        if alike:
            rows = _open_windows(spark, state, alike, horizon)
            folders = [f for f in folders if f not in alike]
            folders += added(rows, f"fold-{batch_id:012d}", alike[0]["level"] + 1)
        snapshots.commit(spark, state, batch_id + 1, {"latest": latest, "folders": folders}, replace=True)
        snapshots.vacuum(spark, state, lambda v: {f["name"] for f in v["folders"]}, 2, ("delta-", "fold-"))

    return (
        log.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tenant_feed(raw: DataFrame) -> DataFrame:
    """Parsed events for the feed; malformed payloads are dropped."""
    return parse_events(raw)


def visible_to(events: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant sees its own events and those without a tenant."""
    return events.where((F.col("tenant_id") == F.lit(tenant_id)) | F.col("tenant_id").isNull())


def score_once(
    texts: DataFrame, scorer: Scorer, path: str, checkpoint: str, ttl_seconds: int = cache.TTL_SECONDS
) -> StreamingQuery:
    """Score each distinct text of a tenant once per time to live, into the cache at ``path``.

    ``texts`` has (tenant_id, cache_key, ts) and the columns the scorer reads. A text with a live
    entry is not scored again. A text whose scorer failed is kept beside the cache and tried again
    with the next micro-batch, with the newest row of its key; nothing is dropped for being late.
    The cache is what ``cache.cache_hits`` and ``scoring.score_cached`` read.
    """
    keys = ["tenant_id", "cache_key"]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wanted = batch.select(*keys, "ts", *scorer.requires)
        if batch_id:
            wanted = wanted.unionByName(spark.read.schema(wanted.schema).parquet(f"{path}-failed/batch={batch_id - 1}"))
        newest = F.max(F.struct("ts", *scorer.requires)).alias("row")
        distinct = stored(wanted.groupBy(*keys).agg(newest).select(*keys, "row.*"), "texts", **SMALL)
        held = cache.read(spark, path, distinct)
        if held is not None:
            alive = held.where(F.col("evaluator") == scorer.name).select(*keys, "expires_at")
            known = distinct.join(alive, keys).where(F.col("expires_at") > F.col("ts")).select(*keys)
            known = stored(known, "known")
            # Texts go through a join only if there is something to find.
            if not known.isEmpty():
                distinct = distinct.join(known, keys, "left_anti")
        scored = stored(score_all(distinct, [scorer], keep=[*keys, "ts"]), "scored")
        fresh = scored.select(
            *keys,
            F.lit(scorer.name).alias("evaluator"),
            F.col(f"score_{scorer.name}").alias("score"),
            F.lit(None).cast("string").alias("metadata"),
            F.col("ts").alias("written_at"),
            F.col(f"error_{scorer.name}").alias("error"),
        )
        cache.store(fresh, path, ttl_seconds, token=(checkpoint, batch_id))
        failed = fresh.where(F.col("error").isNotNull() | F.col("score").isNull())
        failed = failed.select(F.col("tenant_id").alias("_tenant"), F.col("cache_key").alias("_key"))
        same = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("cache_key").eqNullSafe(F.col("_key"))
        again = distinct.where(F.lit(False)) if failed.isEmpty() else distinct.join(failed, same, "left_semi")
        again = again.select(*keys, "ts", *scorer.requires)
        again.write.mode("overwrite").options(**SMALL).parquet(f"{path}-failed/batch={batch_id}")

    return (
        texts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
