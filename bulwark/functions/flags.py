"""Expressions over the wide flag and score columns of a request row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.catalog import FALLBACK_THRESHOLD, NAMES, Evaluator, lookup


def any_flag(names: Iterable[str] = NAMES) -> Column:
    """True when any evaluator flagged the row: one OR chain that Parquet scans can push down."""
    return reduce(lambda a, b: a | b, [F.col(f"flag_{n}") for n in names])


def flag_names(names: Iterable[str] = NAMES) -> Column:
    """Names of the raised flags as an array, in catalogue order."""
    return F.array_compact(F.array(*[F.when(F.col(f"flag_{n}"), F.lit(n)) for n in names]))


def crosses(score: Column, direction: Column, threshold: Column) -> Column:
    """Inclusive threshold test in the given direction; a NULL score never flags."""
    hit = F.when(direction == "above", score >= threshold).otherwise(score <= threshold)
    return F.coalesce(hit, F.lit(False))


def flagged(evaluator: Column, score: Column, config: Iterable[Evaluator]) -> Column:
    """Threshold test with direction and threshold taken from the catalogue."""
    config = tuple(config)
    return crosses(
        score,
        lookup(evaluator, config, "direction", "above"),
        lookup(evaluator, config, "threshold", FALLBACK_THRESHOLD),
    )
