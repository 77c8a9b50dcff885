"""Scores read from model outputs: label maps, toxicity dimensions, per-document consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Toxicity dimensions looked at unless configured otherwise.
TOXICITY_DIMENSIONS = ("toxicity", "severe_toxicity", "threat", "insult", "identity_attack")


def injection_probability(labels: Column, positive: str = "INJECTION") -> Column:
    """Probability of the injection label in a ``map<label, score>``, whatever its case; else 0.0."""
    hits = F.map_values(F.map_filter(labels, lambda k, _: F.upper(k) == positive))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0.0))


def toxicity(
    dimensions: Column, wanted: Sequence[str] = TOXICITY_DIMENSIONS, flag_on: str = "any"
) -> Column:
    """Worst configured dimension (``any``) or the mildest one (``all``); 0.0 if none is present."""
    values = F.map_values(F.map_filter(dimensions, lambda k, _: k.isin(*wanted)))
    picked = F.array_min(values) if flag_on == "all" else F.array_max(values)
    return F.coalesce(picked, F.lit(0.0))


def grounding(
    pairs: DataFrame, keys: Sequence[str], support: str = "consistency", contradiction: str | None = None
) -> DataFrame:
    """Hallucination and faithfulness of a request from its scored (document, output) pairs.

    ``support`` is the consistency (or entailment) of each pair. Hallucination is the largest
    contradiction, by default ``1 - support``; faithfulness is the largest support. Both come from
    one aggregation, so pairs are scored once. A failed pair could hide a contradiction: a request
    with any ``error`` has no scores and carries the first error by text. ``latency_ms`` is the sum
    over the request's pairs.
    """
    against = F.col(contradiction) if contradiction else F.lit(1.0) - F.col(support)
    have = set(pairs.columns)
    failed = F.bool_or(F.col("error").isNotNull()) if "error" in have else F.lit(False)
    grouped = pairs.groupBy(*keys).agg(
        F.max(against).alias("hallucination"),
        F.max(support).alias("faithfulness"),
        F.count(support).alias("num_docs"),
        *([F.min("error").alias("error"), failed.alias("_failed")] if "error" in have else []),
        *([F.sum("latency_ms").cast("int").alias("latency_ms")] if "latency_ms" in have else []),
    )
    if "error" not in have:
        return grouped
    whole = {c: F.when(~F.col("_failed"), F.col(c)) for c in ("hallucination", "faithfulness")}
    return grouped.withColumns(whole).drop("_failed")


def per_document(pairs: DataFrame, keys: Sequence[str], pos: str = "pos", value: str = "consistency") -> DataFrame:
    """The per-document scores of a request in document order; a request lists its own documents."""
    ordered = F.sort_array(F.collect_list(F.struct(pos, value)))
    return pairs.groupBy(*keys).agg(F.transform(ordered, lambda p: p[value]).alias("per_document"))
