"""Constraint checks that split rows into good and quarantined ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.schemas import REVIEW_LABELS, RUN_MODES, RUN_STATES

REQUIRED = ("id", "created_at", "tenant_id", "model", "blocked", "has_context", "reviewed", "latency_total")


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the checks a row fails; a check that is NULL counts as passed."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def request_checks(df: DataFrame) -> dict[str, Column]:
    """Scores in [0, 1], required columns, flags not NULL, review label among the accepted ones."""
    have = set(df.columns)
    checks = {f"score_{n}_range": F.col(f"score_{n}").between(0, 1) for n in NAMES if f"score_{n}" in have}
    checks |= {f"flag_{n}_null": F.col(f"flag_{n}").isNotNull() for n in NAMES if f"flag_{n}" in have}
    checks |= {f"{c}_null": F.col(c).isNotNull() for c in REQUIRED if c in have}
    if "review_label" in have:
        checks["review_label"] = F.col("review_label").isin(*REVIEW_LABELS)
    return checks


def run_checks(df: DataFrame) -> dict[str, Column]:
    checks = {"status": F.col("status").isin(*RUN_STATES)}
    if "eval_mode" in df.columns:
        checks["eval_mode"] = F.col("eval_mode").isin(*RUN_MODES)
    return checks


def validate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(checks))


def split(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their violations)."""
    checked = validate(df, checks)
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def turn_gaps(messages: DataFrame) -> DataFrame:
    """Conversations whose turns are not numbered one by one: (conv_id, n_messages, first, last)."""
    counted = messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.min("turn").alias("first"), F.max("turn").alias("last")
    )
    return counted.where(F.col("n_messages") != F.col("last") - F.col("first") + 1)
