"""Index of the request log: which files hold an id, and how many requests each hour of a tenant has.

The log stays what ``tables.append_requests`` writes, Parquet partitioned by day. :func:`refresh` reads
the files that it does not know yet (id, tenant and time alone) and adds folders of its own:

* ``ids``: (id, tenant_id, file), dealt to ``SLOTS`` folders by the hash of the id;
* ``hours``: (tenant_id, hour, file, n), one row per tenant, hour (its first second since 1970) and file;
* ``files``: the files covered.

The version file of ``sources.snapshots`` names them, and folders of like size become one. Reads are
whole at any time: files that are not covered are read directly, and entries of files that the log
no longer has are ignored.

A read plans on the driver with what Spark's own file listing holds there too (names of files), with the
slots of the ids (at most ``SLOTS``) and with the hours of the log (one row per hour on the clock). Ids and
requests stay in the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.sources import snapshots

SLOTS = 64
#: Ids up to this number are also pushed to the scan, where min-max values and Bloom filters skip row groups.
PUSHED_IDS = 1_000
HOUR = 3_600


def _slot(id: Column) -> Column:
    return F.pmod(F.xxhash64(id.cast("string")), F.lit(SLOTS)).cast("int")


def _file(path: Column) -> Column:
    """Day folder and file name: a file's name within the log."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def _listed(spark: SparkSession, log: str) -> list[str]:
    return ["/".join(p.split("/")[-2:]) for p in spark.read.parquet(log).inputFiles()]


def _names(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in files], "file string")


def _read(spark: SparkSession, index: str, version: dict, kind: str) -> DataFrame | None:
    # Folders are read apart, since each has slot folders of its own.
    frames = [spark.read.parquet(f"{index}/{f['name']}/{kind}") for f in version["folders"]]
    return reduce(DataFrame.unionByName, frames) if frames else None


def _version(spark: SparkSession, index: str) -> dict:
    return snapshots.newest(spark, index)[1] or {"folders": []}


def _fresh(spark: SparkSession, listed: list[str], index: str, version: dict) -> list[str]:
    """Files of the log that the index does not cover."""
    covered = _read(spark, index, version, "files")
    if covered is None:
        return sorted(listed)
    return sorted(r.file for r in _names(spark, listed).join(covered, "file", "left_anti").collect())


def _scan(spark: SparkSession, log: str, files: list[str]) -> DataFrame:
    """The named files of the log, with its day column."""
    whole = spark.read.parquet(log)
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", log).parquet(*[f"{log}/{f}" for f in files])


def _hours(rows: DataFrame, file: Column) -> DataFrame:
    second = F.unix_seconds(F.col("created_at").cast("timestamp"))
    hour = (second - F.pmod(second, F.lit(HOUR))).alias("hour")
    return rows.groupBy("tenant_id", hour, file.alias("file")).agg(F.count(F.lit(1)).alias("n"))


def _write(index: str, name: str, ids: DataFrame, hours: DataFrame, files: DataFrame) -> None:
    dealt = ids.withColumn("slot", _slot(F.col("id"))).hint("rebalance", "slot").sortWithinPartitions("slot", "id")
    dealt.write.partitionBy("slot").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{index}/{name}/ids")
    hours.write.parquet(f"{index}/{name}/hours")
    files.write.parquet(f"{index}/{name}/files")


def refresh(spark: SparkSession, log: str, index: str, fold: int = 8) -> int | None:
    """Cover the files that came since the last refresh; the new version, or None without new files."""

    def step(number: int, version: dict | None) -> dict | None:
        version = version or {"folders": []}
        fresh = _fresh(spark, _listed(spark, log), index, version)
        if not fresh:
            return None
        rows = _scan(spark, log, fresh)
        file = _file(F.col("_metadata.file_path"))
        name = snapshots.new_folder("part")
        _write(index, name, rows.select("id", "tenant_id", file.alias("file")), _hours(rows, file), _names(spark, fresh))
        folders = [*version["folders"], {"name": name, "level": 0}]
        alike = snapshots.due(folders, fold)
        if alike:
            # Entries of files that are gone are left behind here.
            held = {"folders": alike}
            present = _read(spark, index, held, "files").join(_names(spark, _listed(spark, log)), "file", "left_semi")
            kept = [_read(spark, index, held, k).join(present, "file", "left_semi") for k in ("ids", "hours")]
            name = snapshots.new_folder("part")
            _write(index, name, kept[0].drop("slot"), kept[1], present)
            folders = [f for f in folders if f not in alike] + [{"name": name, "level": alike[0]["level"] + 1}]
        return {"folders": folders}

    return snapshots.change(spark, index, step)


def vacuum(spark: SparkSession, index: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` versions names."""
    return snapshots.vacuum(spark, index, lambda v: {f["name"] for f in v["folders"]}, keep, ("part-",))


def files_of(spark: SparkSession, log: str, index: str, wanted: DataFrame) -> list[str]:
    """Files of the log that hold one of the (id, tenant_id) pairs, and those not covered yet."""
    version = _version(spark, index)
    listed = _listed(spark, log)
    files = _fresh(spark, listed, index, version)
    ids = _read(spark, index, version, "ids")
    if ids is None:
        return files
    slots = [r[0] for r in wanted.select(_slot(F.col("id"))).distinct().collect()]
    hits = ids.where(F.col("slot").isin(slots)).join(wanted, ["id", "tenant_id"], "left_semi")
    present = set(listed)
    return sorted({*files, *(r.file for r in hits.select("file").distinct().collect() if r.file in present)})


def lookup(spark: SparkSession, log: str, index: str, wanted: DataFrame) -> DataFrame:
    """Requests of the (id, tenant_id) pairs in ``wanted``; another tenant's id gives no row.

    Reads the slots of the ids in the index, then only the files of the log that hold one of them and
    those not covered yet.
    """
    wanted = wanted.select("id", "tenant_id").distinct()
    rows = _scan(spark, log, files_of(spark, log, index, wanted))
    some = [r.id for r in wanted.select("id").limit(PUSHED_IDS + 1).collect()]
    if len(some) <= PUSHED_IDS:
        rows = rows.where(F.col("id").isin(some))
    return rows.join(wanted, ["id", "tenant_id"], "left_semi")


def hours(spark: SparkSession, log: str, index: str, tenant_id=None) -> DataFrame:
    """(hour, file, n) of the files the log has now, covered or not, of one tenant or of all."""
    version = _version(spark, index)
    listed = _listed(spark, log)
    fresh = _fresh(spark, listed, index, version)
    held = _read(spark, index, version, "hours")
    out = _hours(_scan(spark, log, fresh), _file(F.col("_metadata.file_path"))) if fresh or held is None else None
    if held is not None:
        held = held.join(_names(spark, listed), "file", "left_semi").select("tenant_id", "hour", "file", "n")
        out = held if out is None else out.unionByName(held)
    if tenant_id is not None:
        out = out.where(F.col("tenant_id") == F.lit(tenant_id))
    return out.select("hour", "file", "n")


def total(spark: SparkSession, log: str, index: str, tenant_id=None) -> DataFrame:
    """Number of requests, from the counts alone."""
    return hours(spark, log, index, tenant_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def page(spark: SparkSession, log: str, index: str, page: int = 1, limit: int = 50, tenant_id=None) -> DataFrame:
    """What ``history.page`` gives, newest first, reading only the hours that the page covers.

    Counts per hour say in which hours the page starts and ends and how many of their newest rows come
    before it; of the log, the files of those hours are read and sorted, however deep the page lies.
    Requests without a time come last.
    """
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1 and limit must be between 1 and 200")
    counted = hours(spark, log, index, tenant_id)
    # One row per hour on the clock: some 9,000 a year.
    by_hour = counted.groupBy("hour").agg(F.sum("n").alias("n")).orderBy(F.desc_nulls_last("hour")).collect()
    offset, seen, before, covered = (page - 1) * limit, 0, 0, []
    for row in by_hour:
        if seen + row.n > offset and seen < offset + limit:
            before = seen if not covered else before
            covered.append(row.hour)
        seen += row.n
    times = [h for h in covered if h is not None]
    of_hours = within = F.lit(False)
    if times:
        first, last = F.lit(min(times)), F.lit(max(times))
        of_hours = F.col("hour").between(first, last)
        kind = spark.read.parquet(log).schema["created_at"].dataType
        start, end = F.timestamp_seconds(first).cast(kind), F.timestamp_seconds(last + HOUR).cast(kind)
        within = (F.col("created_at") >= start) & (F.col("created_at") < end)
    if len(times) < len(covered):
        of_hours, within = of_hours | F.col("hour").isNull(), within | F.col("created_at").isNull()
    files = sorted(r.file for r in counted.where(of_hours).select("file").distinct().collect())
    rows = _scan(spark, log, files).where(within)
    if tenant_id is not None:
        rows = rows.where(F.col("tenant_id") == F.lit(tenant_id))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset - before).limit(limit)
