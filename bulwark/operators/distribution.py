"""Exact order statistics that never gather a key's values in one task.

Rows collapse to one per (key, value) with map-side combine. Those are range-partitioned by
(key, value) and written once to the checkpoint folder, so the partition of every value is
fixed. Prefix sums then come in two levels: inside a partition, and over the short table of
per-partition totals. A key that holds most of the data spreads over many partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.session import durable


def running_totals(
    hist: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]
) -> DataFrame:
    """Add ``before_<w>`` (sum over smaller values of the key) and ``total_<w>`` per weight.

    ``hist`` has one row per (keys, value).
    """
    placed = durable(
        hist.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    )
    before = (Window.unboundedPreceding, -1)
    of_key = Window.partitionBy(*[f"_{k}" for k in keys])
    parts = placed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p")).agg(
        *[F.sum(w).alias(w) for w in weights]
    )
    offsets = parts.select(
        *[f"_{k}" for k in keys],
        "_p",
        *[
            F.coalesce(F.sum(w).over(of_key.orderBy("_p").rowsBetween(*before)), F.lit(0)).alias(f"_offset_{w}")
            for w in weights
        ],
        *[F.sum(w).over(of_key).alias(f"total_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(*before)
    local = placed.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_local_{w}") for w in weights]
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys],
        F.col("_part") == F.col("_p"),
    )
    return local.join(offsets, same).select(
        *hist.columns,
        *[(F.col(f"_local_{w}") + F.col(f"_offset_{w}")).alias(f"before_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


def _at(value: Column, weight: str, rank: Column) -> Column:
    """Aggregate: the value at a 0-based rank, given running totals of ``weight``."""
    start = F.col(f"before_{weight}")
    return F.max(F.when((start <= rank) & (rank < start + F.col(weight)), value))


def interpolated(value: str, weight: str, p: float) -> Column:
    """Aggregate over running totals: linear interpolation at ``p * (n - 1)``."""
    n = F.col(f"total_{weight}")
    idx = F.lit(float(p)) * (n - 1)
    low = F.floor(idx)
    lo, hi = _at(F.col(value), weight, low), _at(F.col(value), weight, F.least(low + 1, n - 1))
    return lo + F.max(idx - low) * (hi - lo)


def nearest_rank(value: str, weight: str, p: float) -> Column:
    """Aggregate over running totals: the value at 0-based rank ``floor(n * p)``."""
    return _at(F.col(value), weight, F.floor(F.col(f"total_{weight}") * F.lit(float(p))))


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_totals(hist, keys, value, ["n"])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles per key, one column per name, plus ``n``; 0.0 never stands in for
    a key without values, as such a key gives no row."""
    return _ranked(df, keys, value).groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        *[interpolated(value, "n", p).alias(name) for name, p in probs.items()],
    )


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Nearest-rank quantiles per key (``sorted[int(n * p)]``)."""
    return _ranked(df, keys, value).groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        *[nearest_rank(value, "n", p).alias(name) for name, p in probs.items()],
    )
