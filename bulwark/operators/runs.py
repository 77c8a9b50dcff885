"""Evaluation runs: scorecards, baselines, flag-rate regression, run states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import SCORECARD_NAMES
from bulwark.functions.numeric import rate
from bulwark.operators.distribution import interpolated, running_totals
from bulwark.operators.stats import RATE_STEP


def scorecard(
    results: DataFrame,
    run: str = "run_label",
    records: DataFrame | None = None,
    evaluators: Sequence[str] = SCORECARD_NAMES,
) -> DataFrame:
    """Per run and evaluator: mean, p50, p95, flag count and rate, n and n_scored.

    ``results`` is long: (run, evaluator, score, flag). ``n`` counts all records of the run,
    also errored ones: from ``records`` (run, n), or else the most rows of any evaluator. Every
    evaluator is listed, without scores its mean and percentiles are NULL.
    """
    hist = (
        results.where(F.col("evaluator").isin(*evaluators))
        .groupBy(run, "evaluator", "score")
        .agg(F.count("*").alias("rows"), F.count_if("flag").alias("flags"))
        .withColumn("scored", F.when(F.col("score").isNotNull(), F.col("rows")).otherwise(0))
    )
    per = (
        running_totals(hist, [run, "evaluator"], "score", ["scored"])
        .groupBy(run, "evaluator")
        .agg(
            F.sum(F.col("score") * F.col("scored")).alias("_sum"),
            F.sum("scored").alias("n_scored"),
            F.sum("rows").alias("_rows"),
            F.sum("flags").alias("flag_count"),
            interpolated("score", "scored", 0.5).alias("p50"),
            interpolated("score", "scored", 0.95).alias("p95"),
        )
    )
    # From here on there is one row per run and evaluator.
    stats = F.map_from_entries(
        F.collect_list(
            F.struct(
                "evaluator", F.struct("_sum", "n_scored", "_rows", "flag_count", "p50", "p95").alias("v")
            )
        )
    )
    of_run = per.groupBy(run).agg(F.max("_rows").alias("_most"), stats.alias("_by"))
    if records is not None:
        of_run = records.select(run, F.col("n").alias("_n")).join(of_run, run, "left")
    else:
        of_run = of_run.withColumn("_n", F.col("_most"))
    names = F.explode(F.array(*[F.lit(e) for e in evaluators])).alias("evaluator")
    listed = of_run.select("*", names).withColumn("v", F.try_element_at("_by", F.col("evaluator")))
    count = F.coalesce(F.col("v.flag_count"), F.lit(0))
    return listed.select(
        run,
        "evaluator",
        (F.col("v._sum") / F.nullif(F.col("v.n_scored"), F.lit(0))).alias("mean"),
        F.col("v.p50").alias("p50"),
        F.col("v.p95").alias("p95"),
        rate(count, F.col("_n")).alias("flag_rate"),
        count.alias("flag_count"),
        F.col("_n").alias("n"),
        F.coalesce(F.col("v.n_scored"), F.lit(0)).alias("n_scored"),
    )


def baseline_scores(results: DataFrame, runs: DataFrame, tenant_id=None) -> DataFrame:
    """Scores of stored results in long form: (run_id, tenant_id, evaluator, score), NULLs dropped.

    ``results`` has (run_id, scores map); runs of other tenants are left out.
    """
    wanted = runs if tenant_id is None else runs.where(F.col("tenant_id") == F.lit(tenant_id))
    stored = results.where(F.col("scores").isNotNull())
    joined = stored.join(wanted.select("run_id", "tenant_id"), "run_id")
    exploded = joined.select("run_id", "tenant_id", F.explode("scores").alias("evaluator", "score"))
    return exploded.where(F.col("score").isNotNull())


def resolve_baseline(runs: DataFrame) -> DataFrame:
    """Each run with its baseline run id, or why there is no comparison.

    ``runs`` has (run_id, tenant_id, label, baseline_label, status, ...).
    """
    candidates = runs.select(
        "tenant_id",
        F.col("label").alias("baseline_label"),
        F.col("run_id").alias("_id"),
        F.col("status").alias("_status"),
    )
    joined = runs.join(candidates, ["tenant_id", "baseline_label"], "left")
    usable = F.col("_status") == "complete"
    return joined.select(
        *runs.columns,
        F.when(usable, F.col("_id")).alias("baseline_run_id"),
        F.when(F.col("baseline_label").isNull(), "no baseline requested")
        .when(F.col("_id").isNull(), "baseline not found")
        .when(~usable, F.concat(F.lit("baseline is "), F.col("_status")))
        .otherwise("compared")
        .alias("comparison"),
    )


def join_summaries(
    current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("evaluator",)
) -> DataFrame:
    """Flag rates of two scorecards side by side; an evaluator missing on a side has rate 0.0."""
    left = current.select(*keys, F.col("flag_rate").alias("_cur"))
    right = baseline.select(*keys, F.col("flag_rate").alias("_base"))
    return left.join(right, list(keys), "full_outer").select(
        *keys,
        F.coalesce("_base", F.lit(0.0)).alias("baseline_flag_rate"),
        F.coalesce("_cur", F.lit(0.0)).alias("current_flag_rate"),
    )


def _delta() -> Column:
    return F.col("current_flag_rate") - F.col("baseline_flag_rate")


def flag_rate_regression(joined: DataFrame, step: float = RATE_STEP) -> DataFrame:
    """Regressed when the flag rate rose by more than ``step``, the same rule for every evaluator."""
    return joined.withColumns(
        {
            "delta": _delta(),
            "regressed": _delta() > step,
            "status": F.when(_delta() > step, "regression")
            .when(_delta() < -step, "improved")
            .otherwise("stable"),
        }
    )


def gate(comparison: DataFrame) -> DataFrame:
    """One row for a build gate: fails on any regression (flag-rate rows) or any significant
    regression (statistical rows)."""
    if "regressed" in comparison.columns:
        bad = F.col("regressed")
    else:
        bad = F.col("significant") & (F.col("direction") == "regression")
    failed = F.coalesce(F.bool_or(bad), F.lit(False))
    return comparison.agg(
        failed.alias("failed"),
        F.count_if(bad).alias("n_regressions"),
        F.when(failed, 2).otherwise(0).alias("exit_code"),
    )


def recent_runs(runs: DataFrame, tenant_id=None, limit: int = 50) -> DataFrame:
    """The newest runs of a tenant."""
    scoped = runs if tenant_id is None else runs.where(F.col("tenant_id") == F.lit(tenant_id))
    return scoped.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def fold_states(events: DataFrame, table_columns: Sequence[str] = ()) -> DataFrame:
    """Latest state of each run from its append-only events.

    ``events``: (run_id, tenant_id, label, seq, ts, status, record_count, summary).
    """
    final = F.col("status").isin("complete", "failed")
    latest = F.max_by(F.struct("status", "record_count", "summary"), F.struct("ts", "seq"))
    return (
        events.groupBy("run_id", "tenant_id", "label", *table_columns)
        .agg(
            F.min("ts").alias("created_at"),
            F.max(F.when(final, F.col("ts"))).alias("completed_at"),
            latest.alias("s"),
        )
        .select(
            "run_id", "tenant_id", "label", *table_columns, "created_at",
            F.when(F.col("s.status") != "running", F.col("completed_at")).alias("completed_at"),
            F.col("s.status").alias("status"),
            F.coalesce("s.record_count", F.lit(0)).alias("record_count"),
            F.col("s.summary").alias("summary"),
        )
    )
