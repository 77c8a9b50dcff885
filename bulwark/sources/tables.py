"""Stored tables: append-only request log, eval results and runs, scorecard reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bulwark.catalog import NAMES
from bulwark.schemas import EVAL_RESULTS, EVAL_RUNS, REQUESTS, conform, requests_schema


def append_requests(records: DataFrame, path: str, names: Sequence[str] = NAMES) -> None:
    """Append to the request log, partitioned by day.

    The rebalance hint gathers each day into files of a good size: AQE splits a busy day over
    tasks and merges quiet ones. Bloom filters on ``id`` let a lookup skip row groups.
    """
    rows = conform(records, requests_schema(names)).withColumn("dt", F.to_date("created_at"))
    writer = rows.hint("rebalance", "dt").write.partitionBy("dt").mode("append")
    writer.option("parquet.bloom.filter.enabled#id", "true").parquet(path)


def append_requests_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same sink for a stream: files per micro-batch, exactly once by the checkpoint."""
    rows = conform(records, REQUESTS).withColumn("dt", F.to_date("created_at"))
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("checkpointLocation", checkpoint)
        .partitionBy("dt")
        .trigger(availableNow=True)
        .start()
    )


def append_results(results: DataFrame, path: str) -> None:
    """Append eval results; offline rows carry a scores map and no request id."""
    rows = conform(results, EVAL_RESULTS).hint("rebalance", "eval_run_id")
    rows.write.mode("append").partitionBy("eval_run_id").parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    conform(runs, EVAL_RUNS).write.mode("append").parquet(path)


def scorecard_report(
    card: DataFrame,
    regression: DataFrame | None = None,
    run: str = "run_label",
    dataset_path: str = "",
    duration_s: float = 0.0,
) -> DataFrame:
    """One JSON document per run: label, dataset, record count, duration, summary, regression.

    A run has one row per evaluator, so the lists collected here are as short as the catalogue.
    """

    def as_map(*fields: str):
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("evaluator", F.struct(*fields)))))

    body = card.groupBy(run).agg(
        F.max("n").alias("n_records"),
        as_map("mean", "p50", "p95", "flag_rate", "flag_count", "n", "n_scored").alias("summary"),
    )
    if regression is not None:
        compared = regression.groupBy(run).agg(
            as_map("baseline_flag_rate", "current_flag_rate", "delta", "regressed").alias("regression")
        )
        body = body.join(compared, run, "left")
    else:
        body = body.withColumn("regression", F.lit(None).cast("string"))
    report = F.struct(
        F.col(run).alias("label"),
        F.lit(dataset_path).alias("dataset_path"),
        "n_records",
        F.lit(round(duration_s, 2)).alias("duration_s"),
        "summary",
        "regression",
    )
    return body.select(run, F.to_json(report, {"ignoreNullFields": "false"}).alias("value"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One line of JSON per run."""
    reports.select("value").write.mode("overwrite").text(path)
