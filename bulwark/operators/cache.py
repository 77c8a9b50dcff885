"""Score cache as a table: (tenant_id, cache_key, evaluator, score, metadata, written_at, expires_at).

Batch and streaming jobs share it. Stored, it is a log. A write appends one folder with its own rows,
however much the cache holds, and a version file that names it (``sources.snapshots``); a reader sees
the version that it started with. Reading folds the writes of each key in their order, by the rules of
:func:`write_back`. ``FOLDED`` folders of like size become one, and when the log holds more than half as
many rows as the base, both merge into a new base, so that a row is written a bounded number of
times (logarithmic in the size of the log) in all.

The base is kept in buckets by extendible hashing: the first bits of a key's hash choose a slot of the
directory, several slots may share a bucket, and a bucket beyond ``BUCKET_ROWS`` splits when it is
rewritten. So no task holds more than about one bucket, and looking up some keys reads only theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bulwark.catalog import INPUT_NAMES
from bulwark.functions.text import cache_key
from bulwark.session import stored
from bulwark.sources import snapshots

TTL_SECONDS = 3600
#: Rows of a bucket, about, before it splits.
BUCKET_ROWS = 1_000_000
#: Folders of like size that become one, and the factor between sizes.
FOLDED = 8
#: Rows of the log below which it isn't merged into the base.
LOG_ROWS = 10_000
HASH_BITS = 64
KEYS = ("tenant_id", "cache_key", "evaluator")
COLUMNS = ("tenant_id", "cache_key", "evaluator", "score", "metadata", "written_at", "expires_at")


def with_cache_key(payloads: DataFrame, config_version: str, prefix: str = "guard") -> DataFrame:
    key = cache_key(F.col("tenant_id"), F.col("input_text"), config_version, prefix)
    return payloads.withColumn("cache_key", key)


def live(cache: DataFrame, as_of) -> DataFrame:
    kind = cache.schema["expires_at"].dataType
    return cache.where(F.col("expires_at") > F.lit(as_of).cast(kind))


def wanted(payloads: DataFrame, evaluators: Sequence[str] = INPUT_NAMES) -> DataFrame:
    """One row per payload and evaluator."""
    return payloads.withColumn("evaluator", F.explode(F.array(*[F.lit(e) for e in evaluators])))


def cache_hits(requested: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """Requested (cache_key, evaluator) rows with a live entry; partial hits per evaluator.

    A text with very many copies makes one large join partition, which AQE splits, as the cache
    side holds one row per key and evaluator.
    """
    entries = live(cache, as_of).select("cache_key", "evaluator", "score", "metadata")
    found = requested.join(entries, ["cache_key", "evaluator"])
    return found.withColumns({"cached": F.lit(True), "latency_ms": F.lit(0)})


def cache_misses(requested: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    entries = live(cache, as_of).select("cache_key", "evaluator")
    return requested.join(entries, ["cache_key", "evaluator"], "left_anti")


def write_back(cache: DataFrame, fresh: DataFrame, ttl_seconds: int = TTL_SECONDS, as_of=None) -> DataFrame:
    """The cache after storing ``fresh`` results (with ``written_at`` and ``error``).

    Errored and NULL scores are not stored. The latest write of an evaluator wins, and any write
    renews the expiry of the key's entries that are still alive. Entries that have expired by
    ``as_of`` leave the cache.
    """
    keys = ["tenant_id", "cache_key", "evaluator"]
    columns = [*keys, "score", "metadata", "written_at", "expires_at"]
    newest_value = F.max_by(F.struct("score", "metadata", "written_at"), "written_at").alias("v")
    # Copies of a text collapse here with map-side combine; afterwards a key has at most one old
    # and one new row per evaluator, which bounds the windows below.
    fresh = (
        fresh.where(F.col("error").isNull() & F.col("score").isNotNull())
        .groupBy(*keys)
        .agg(newest_value)
        .select(*keys, "v.*", F.lit(None).cast(cache.schema["expires_at"].dataType).alias("expires_at"))
    )
    is_new = F.col("expires_at").isNull()
    of_key = Window.partitionBy("tenant_id", "cache_key")
    merged = cache.select(*columns).unionByName(fresh).select(
        "*",
        F.min(F.when(is_new, F.col("written_at"))).over(of_key).alias("first_write"),
        F.max(F.when(is_new, F.col("written_at"))).over(of_key).alias("last_write"),
    )
    # A key that had expired before the new writes starts over without its old entries.
    lapsed = F.coalesce(F.col("expires_at") <= F.col("first_write"), F.lit(False))
    renewed = F.col("last_write") + F.expr(f"INTERVAL '{ttl_seconds}' SECOND")
    kept = (
        merged.where(~lapsed)
        .withColumn("expires_at", F.coalesce(renewed, F.col("expires_at")))
        .groupBy(*keys)
        .agg(newest_value, F.max("expires_at").alias("expires_at"))
        .select(*keys, "v.*", "expires_at")
    )
    return kept if as_of is None else live(kept, as_of)


def _hash() -> Column:
    return F.xxhash64("cache_key")


def _slot(depth: int) -> Column:
    """The directory's slot of a key: the first ``depth`` bits of its hash."""
    return F.shiftrightunsigned(_hash(), HASH_BITS - depth).cast("int") if depth else F.lit(0)


def _bucket(version: dict) -> Column:
    """The bucket of a key by the directory."""
    directory = F.split(F.lit(",".join(map(str, version["directory"]))), ",").cast("array<int>")
    return F.element_at(directory, _slot(version["depth"]) + 1)


def _as_delta(good: DataFrame, ttl_seconds: int) -> DataFrame:
    """One row per key and evaluator of a write, with the first write of the key and its new expiry."""
    values = good.groupBy(*KEYS).agg(
        F.max_by(F.struct("score", "metadata", "written_at"), "written_at").alias("v"), F.min("written_at").alias("first")
    )
    of_key = Window.partitionBy("tenant_id", "cache_key")
    until = F.max("v.written_at").over(of_key) + F.expr(f"INTERVAL '{ttl_seconds}' SECOND")
    return values.select(
        *KEYS, "v.*", F.min("first").over(of_key).alias("first_write"), until.cast(good.schema["written_at"].dataType).alias("expires_at")
    )


def _folded(rows: DataFrame) -> DataFrame:
    """The cache's rows from all writes of (COLUMNS, first_write, seq).

    A key has one row per write and evaluator, and the log is merged before it holds many writes.
    """
    of_key = Window.partitionBy("tenant_id", "cache_key")
    earlier = of_key.orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    # A key that had expired before a write starts over without its older entries.
    lapsed = F.last("expires_at").over(earlier) <= F.col("first_write")
    lives = rows.withColumn("_restart", F.when(lapsed, F.col("seq"))).select(
        "*",
        F.max("_restart").over(of_key).alias("_since"),
        F.max(F.struct("seq", "expires_at")).over(of_key)["expires_at"].alias("_until"),
        F.max("seq").over(of_key).alias("_seq"),
    )
    newest = F.max_by(F.struct("score", "metadata", "written_at"), F.struct("written_at", "seq")).alias("v")
    return (
        lives.where(F.col("_since").isNull() | (F.col("seq") >= F.col("_since")))
        .groupBy(*KEYS).agg(newest, F.max("_until").alias("expires_at"), F.max("_seq").alias("seq"))
        .select(*KEYS, "v.*", "expires_at", "seq")
    )


def _schema(version: dict) -> StructType:
    """Columns of a folder: COLUMNS and ``first_write``."""
    return StructType.fromJson(version["schema"])


def _log(spark: SparkSession, path: str, version: dict, deltas: Sequence[dict]) -> DataFrame | None:
    """Rows of folders of the log, each with the number of its write."""
    plain, numbered = _schema(version), _schema(version).add("seq", "long")
    parts = []
    for d in deltas:
        folder = f"{path}/{d['folder']}"
        if d["seq"] is None:
            parts.append(spark.read.schema(numbered).parquet(folder))
        else:
            parts.append(spark.read.schema(plain).parquet(folder).withColumn("seq", F.lit(d["seq"]).cast("long")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _base(spark: SparkSession, path: str, version: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """Rows of the base, of some buckets or of all."""
    chosen = range(len(version["buckets"])) if buckets is None else buckets
    places = [f"{path}/{version['buckets'][b]['folder']}" for b in chosen if version["buckets"][b]["folder"]]
    if not places:
        return None
    return spark.read.schema(_schema(version).add("seq", "long")).parquet(*places)


def _writes(spark: SparkSession, path: str, version: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
    base, log = _base(spark, path, version, buckets), _log(spark, path, version, version["deltas"])
    if base is None or log is None:
        return base if log is None else log
    return base.unionByName(log)


def read(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame | None:
    """The stored cache, or None before its first write: COLUMNS, expired entries included.

    With ``keys`` (cache_key) only their entries: of the base, the buckets that hold them are read.
    """
    _, version = snapshots.newest(spark, path)
    if version is None:
        return None
    if keys is None:
        rows = _writes(spark, path, version)
    else:
        keys = keys.select("cache_key").distinct()
        # At most as many rows as there are buckets.
        buckets = [r[0] for r in keys.select(_bucket(version)).distinct().collect()]
        rows = _writes(spark, path, version, buckets)
        rows = None if rows is None else rows.join(keys, "cache_key", "left_semi")
    if rows is None:
        return spark.createDataFrame([], _schema(version)).select(*COLUMNS)
    return _folded(rows).select(*COLUMNS)


def _written(rows: DataFrame, path: str, kind: str) -> str:
    folder = snapshots.new_folder(kind)
    rows.write.option("parquet.bloom.filter.enabled#cache_key", "true").parquet(f"{path}/{folder}")
    return folder


def store(
    fresh: DataFrame, path: str, ttl_seconds: int = TTL_SECONDS, token: tuple[str, int] | None = None, tidy: bool = True
) -> None:
    """Add ``fresh`` results to the cache at ``path`` as one folder of their own rows.

    Storing the same results again changes nothing. With a ``token`` (name of a writer, number of its
    batch) a batch that was stored before isn't even written. ``tidy`` folds and merges the log when
    that is due; without it the caller runs :func:`compact` now and then.
    """
    spark = fresh.sparkSession
    if token is not None:
        _, version = snapshots.newest(spark, path)
        if version is not None and version["tokens"].get(token[0], -1) >= token[1]:
            return
    good = fresh.where(F.col("error").isNull() & F.col("score").isNotNull())
    delta = _as_delta(good, ttl_seconds)
    folder = _written(delta, path, "delta")
    # From the files that were just written.
    n, newest = spark.read.schema(delta.schema).parquet(f"{path}/{folder}").agg(F.count(F.lit(1)), F.max("written_at").cast("string")).first()

    def added(number: int, version: dict | None) -> dict | None:
        version = version or {"schema": delta.schema.jsonValue(), "depth": 0, "directory": [0], "buckets": [{"folder": None, "rows": 0, "depth": 0}],
                              "deltas": [], "tokens": {}, "newest": newest}
        known = {token[0]: token[1]} if token else {}
        deltas = [*version["deltas"], {"folder": folder, "rows": n, "seq": number}] if n else version["deltas"]
        return {**version, "deltas": deltas, "tokens": {**version["tokens"], **known}, "newest": max(filter(None, [version["newest"], newest]), default=None)}

    snapshots.change(spark, path, added)
    if tidy:
        _tidy(spark, path)


def _tier(rows: int) -> int:
    tier = 0
    while rows >= FOLDED:
        rows, tier = rows // FOLDED, tier + 1
    return tier


def _tidy(spark: SparkSession, path: str) -> None:
    """Merge the log into the base, or fold folders of like size, when that is due."""
    _, version = snapshots.newest(spark, path)
    deltas = version["deltas"]
    in_log, in_base = sum(d["rows"] for d in deltas), sum(b["rows"] for b in version["buckets"])
    if in_log > LOG_ROWS and 2 * in_log > in_base:
        compact(spark, path)
        return
    tiers = Counter(_tier(d["rows"]) for d in deltas)
    full = [t for t, n in tiers.items() if n >= FOLDED]
    if full:
        _fold(spark, path, version, [d for d in deltas if _tier(d["rows"]) == min(full)])


def _replaced(version: dict, gone: Sequence[dict]) -> list[dict] | None:
    """The log without the folders ``gone``; None if another writer has replaced them."""
    names = {d["folder"] for d in gone}
    left = [d for d in version["deltas"] if d["folder"] not in names]
    return left if len(left) == len(version["deltas"]) - len(names) else None


def _fold(spark: SparkSession, path: str, version: dict, deltas: Sequence[dict]) -> None:
    """Several folders of the log as one; every row keeps the number of its write."""
    folder = _written(_log(spark, path, version, deltas), path, "delta")

    def folded(number: int, now: dict) -> dict | None:
        left = _replaced(now, deltas)
        one = {"folder": folder, "rows": sum(d["rows"] for d in deltas), "seq": None}
        return None if left is None else {**now, "deltas": [one, *left]}

    snapshots.change(spark, path, folded)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the log into the buckets it touches, without what expired before the newest write.

    Buckets without a row in the log stay as they are; a bucket that has outgrown its size splits.
    """
    _, version = snapshots.newest(spark, path)
    if version is None or not version["deltas"]:
        return
    deltas = version["deltas"]
    bucket = _bucket(version)
    # At most as many rows as there are buckets.
    touched = sorted(r[0] for r in _log(spark, path, version, deltas).select(bucket).distinct().collect())
    kept = _folded(_writes(spark, path, version, touched))
    kept = stored(live(kept, version["newest"]).withColumn("first_write", F.col("written_at")), "compacted")
    rows = dict(kept.groupBy(bucket.alias("b")).agg(F.count(F.lit(1))).collect())
    merged = _split(version, {b: rows.get(b, 0) for b in touched})
    renewed = {b for b, x in enumerate(merged["buckets"]) if x["folder"] is None and x["rows"]}
    folder = snapshots.new_folder("base")
    if renewed:
        named = kept.withColumn("bucket", _bucket(merged))
        writer = named.repartition("bucket").sortWithinPartitions("bucket", "cache_key").write.option("parquet.bloom.filter.enabled#cache_key", "true")
        writer.partitionBy("bucket").parquet(f"{path}/{folder}")
        sizes = dict(named.groupBy("bucket").count().collect())
        for b in renewed:
            merged["buckets"][b] |= {"folder": f"{folder}/bucket={b}" if sizes.get(b) else None, "rows": sizes.get(b, 0)}

    def compacted(number: int, now: dict) -> dict | None:
        left = _replaced(now, deltas)
        if left is None or now["buckets"] != version["buckets"]:
            return None
        return {**now, "deltas": left, **{k: merged[k] for k in ("depth", "directory", "buckets")}}

    snapshots.change(spark, path, compacted)


def _split(version: dict, rows: dict[int, int]) -> dict:
    """Directory and buckets after ``rows`` (by bucket) replaced what the buckets held.

    A bucket beyond BUCKET_ROWS splits by the next bits of the hash; the directory doubles when a
    bucket knows as many bits as the directory.
    """
    depth, directory = version["depth"], list(version["directory"])
    buckets = [dict(b) for b in version["buckets"]]
    for b, n in rows.items():
        buckets[b] |= {"folder": None, "rows": n}
    queue = [b for b, n in rows.items() if n > BUCKET_ROWS]
    while queue:
        b = queue.pop()
        if buckets[b]["depth"] == depth:
            depth, directory = depth + 1, [x for x in directory for _ in range(2)]
        slots = [i for i, x in enumerate(directory) if x == b]
        half = dict(buckets[b], depth=buckets[b]["depth"] + 1, rows=buckets[b]["rows"] // 2)
        buckets[b] = half
        buckets.append(dict(half))
        for i in slots[len(slots) // 2 :]:
            directory[i] = len(buckets) - 1
        if half["rows"] > BUCKET_ROWS:
            queue += [b, len(buckets) - 1]
    return {**version, "depth": depth, "directory": directory, "buckets": buckets}


def _folders(version: dict) -> set[str]:
    of_base = {b["folder"].split("/")[0] for b in version.get("buckets", []) if b["folder"]}
    return of_base | {d["folder"] for d in version.get("deltas", [])}


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete what none of the last ``keep`` versions of the cache needs."""
    return snapshots.vacuum(spark, path, _folders, keep, ("delta-", "base-"))
