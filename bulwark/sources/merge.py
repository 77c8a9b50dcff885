"""Reviews applied to the stored request log, writing only the days they touch.

New files of those days are staged in a folder that readers skip. Then a journal says that the stage is
whole, and each day's folder is swapped by renames. A merge that died before the journal has changed
nothing; one that died after it is finished by :func:`recover`, which the next merge calls first. Files that were
appended to a day while it was staged move along unchanged. Readers that began before may
find files gone and have to read again; untouched days keep their files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.operators.history import apply_reviews
from bulwark.sources import log_index, snapshots

STAGE = "_merge-"
JOURNAL = "ready.json"
# Fixed value: the folder name of a NULL partition.
UNKNOWN_DAY = "__HIVE_DEFAULT_PARTITION__"


def _days(spark: SparkSession, log: str, reviews: DataFrame, index: str | None) -> list[str]:
    """Day folders that hold reviewed requests: by the reviews' ``dt``, else by the index."""
    if "dt" in reviews.columns:
        days = {f"dt={r.dt or UNKNOWN_DAY}" for r in reviews.select("dt").distinct().collect()}
        return [d for d in _names(spark, log) if d in days]
    if index is None:
        raise ValueError("reviews need the day of their request (dt), or the log an index")
    wanted = reviews.select(F.col("request_id").alias("id"), "tenant_id")
    return sorted({f.split("/")[0] for f in log_index.files_of(spark, log, index, wanted)})


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = snapshots.located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, to = snapshots.located(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(snapshots.located(spark, source)[1], to):
        raise OSError(f"{source} could not become {target}")


def _swap(spark: SparkSession, log: str, stage: str) -> None:
    """Put the staged days in place; may be called again at any point of itself."""
    read = json.loads(snapshots.read_text(spark, f"{stage}/{JOURNAL}"))
    for day, files in read.items():
        new, old, live = f"{stage}/new/{day}", f"{stage}/old/{day}", f"{log}/{day}"
        if not snapshots.exists(spark, new):
            continue
        if not snapshots.exists(spark, old):
            for name in _names(spark, live):
                if name not in files and not name.startswith(("_", ".")):
                    _move(spark, f"{live}/{name}", f"{new}/{name}")
            if snapshots.exists(spark, live):
                _move(spark, live, old)
        _move(spark, new, live)
    fs, place = snapshots.located(spark, stage)
    fs.delete(place, True)


def recover(spark: SparkSession, log: str) -> list[str]:
    """Finish merges whose journal is written and remove stages without one; returns the days put in place."""
    days: list[str] = []
    for name in _names(spark, log):
        if name.startswith(STAGE):
            stage = f"{log}/{name}"
            if snapshots.exists(spark, f"{stage}/{JOURNAL}"):
                days += _names(spark, f"{stage}/new")
                _swap(spark, log, stage)
            else:
                fs, place = snapshots.located(spark, stage)
                fs.delete(place, True)
    return days


def merge_reviews(spark: SparkSession, log: str, reviews: DataFrame, index: str | None = None) -> list[str]:
    """Apply ``reviews`` (see ``history.apply_reviews``) to the log at ``log``; the day folders written.

    One merge at a time. Reviews of requests that the log doesn't hold change nothing. With an index,
    refresh it afterwards; until then the new files are read directly.
    """
    if snapshots.exists(spark, f"{log}/_spark_metadata"):
        raise ValueError("a log that a stream writes lists its files itself; merge into a copy")
    recover(spark, log)
    days = _days(spark, log, reviews, index)
    if not days:
        return []
    whole = spark.read.parquet(log)
    touched = spark.read.schema(whole.schema).option("basePath", log).parquet(*[f"{log}/{d}" for d in days])
    read: dict[str, list[str]] = {d: [] for d in days}
    for file in touched.inputFiles():
        read[file.split("/")[-2]].append(file.split("/")[-1])
    kinds = {f.name: f.dataType for f in whole.schema.fields}
    typed = reviews.withColumns({c: F.col(c).cast(kinds[c]) for c in ("tenant_id", "reviewed_at") if c in kinds})
    typed = typed.withColumn("request_id", F.col("request_id").cast(kinds["id"]))
    applied = apply_reviews(touched, typed)
    rows = applied.select(*[F.col(c).cast(kinds[c]).alias(c) for c in whole.columns])
    stage = f"{log}/{STAGE}{uuid.uuid4().hex}"
    writer = rows.hint("rebalance", "dt").write.partitionBy("dt").option("parquet.bloom.filter.enabled#id", "true")
    writer.parquet(f"{stage}/new")
    snapshots.write_text(spark, f"{stage}/{JOURNAL}", json.dumps(read))
    _swap(spark, log, stage)
    return days
