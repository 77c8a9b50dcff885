"""Statistical comparison of two evaluation runs, and detector quality against labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS, SCORECARD_NAMES, Evaluator, lookup
from bulwark.functions.numeric import rate
from bulwark.functions.significance import mann_whitney_p
from bulwark.operators.distribution import running_totals

# Smallest sample tested, significance level, flag-rate step, effect-size bounds.
MIN_SAMPLE = 5
ALPHA = 0.05
RATE_STEP = 0.05
EFFECT_BOUNDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))


def two_samples(
    scores: DataFrame,
    keys: Sequence[str],
    is_current: Column,
    value: str = "score",
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per key: sample sizes, means, variances, the current sample's U and the tie term.

    One pass collapses the scores to distinct values; ranks come from exact running totals over
    those, so neither an evaluator nor a run is ever sorted in one task. ``counts`` names further
    conditions to count in the same pass. NULL scores belong to neither sample.
    """
    present = F.col(value).isNotNull()
    counts = dict(counts or {})
    hist = (
        scores.groupBy(*keys, value)
        .agg(
            F.count_if(present & is_current).alias("n_cur"),
            F.count_if(present & ~is_current).alias("n_base"),
            *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        )
        .withColumn("s_cur", F.col("n_cur") * F.col(value))
        .withColumn("s_base", F.col("n_base") * F.col(value))
    )
    ranked = running_totals(hist, keys, value, ["n_cur", "n_base", "s_cur", "s_base"])
    tied = (F.col("n_cur") + F.col("n_base")).cast("double")

    def variance(side: str) -> Column:
        mean = F.col(f"total_s_{side}") / F.nullif(F.col(f"total_n_{side}"), F.lit(0))
        squares = F.sum(F.col(f"n_{side}") * F.pow(F.col(value) - mean, 2))
        freedom = F.max(f"total_n_{side}") - 1
        # One distinct value has no spread; rounding in the mean must not invent any.
        constant = F.count_if(F.col(f"n_{side}") > 0) <= 1
        return F.when(freedom >= 1, F.when(constant, 0.0).otherwise(squares / freedom))

    def mean(side: str) -> Column:
        return F.max(f"total_s_{side}") / F.nullif(F.max(f"total_n_{side}"), F.lit(0))

    below = F.col("before_n_base") + F.col("n_base") / 2.0
    return ranked.groupBy(*keys).agg(
        F.max("total_n_cur").alias("n_current"),
        F.max("total_n_base").alias("n_baseline"),
        mean("cur").alias("mean_current"),
        mean("base").alias("mean_baseline"),
        variance("cur").alias("var_current"),
        variance("base").alias("var_baseline"),
        F.sum(F.col("n_cur") * below).alias("u"),
        F.sum(tied * tied * tied - tied).alias("ties"),
        *[F.sum(name).alias(name) for name in counts],
    )


def z_score(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Tie-corrected z of U with continuity correction; NULL when all values tie."""
    a, b = n1.cast("double"), n2.cast("double")
    n = a + b
    variance = a * b / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    top = F.greatest(u, a * b - u) - a * b / 2.0 - 0.5
    return F.when(variance > 0, top / F.sqrt(variance))


def cohens_d() -> Column:
    """Standardised mean difference with the pooled deviation, over :func:`two_samples` columns."""
    n1, n2 = F.col("n_current"), F.col("n_baseline")
    pooled = F.sqrt(
        ((n1 - 1) * F.col("var_current") + (n2 - 1) * F.col("var_baseline")) / (n1 + n2 - 2)
    )
    d = (F.col("mean_current") - F.col("mean_baseline")) / F.nullif(pooled, F.lit(0.0))
    return F.when(F.least(n1, n2) < 2, 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def effect_label(d: Column) -> Column:
    label = None
    for bound, name in EFFECT_BOUNDS:
        under = F.abs(d) < bound
        label = F.when(under, name) if label is None else label.when(under, name)
    return label.otherwise("large")


def compare_runs(
    scores: DataFrame,
    keys: Sequence[str] = ("evaluator",),
    config: Iterable[Evaluator] = EVALUATORS,
    alpha: float = ALPHA,
    baseline_flags: DataFrame | None = None,
    evaluators: Sequence[str] = SCORECARD_NAMES,
) -> DataFrame:
    """The comparison table: one row per key with U, p, effect, direction and flag-rate change.

    ``scores`` is long: (keys, side 'current' | 'baseline', score, flag). ``baseline_flags``
    (keys, flag_count) replaces the counted baseline flags by those of a stored scorecard. When
    ``keys`` is the evaluator alone, all evaluators are listed, also those without scores.
    """
    config = tuple(config)
    keys = list(keys)
    current = F.col("side") == "current"
    listed = scores.where(F.col("evaluator").isin(*evaluators))
    flags = {
        "current_flags": current & F.col("flag"),
        "baseline_flags": ~current & F.col("flag"),
    }
    joined = two_samples(listed, keys, current, counts=flags)
    if baseline_flags is not None:
        stored = baseline_flags.select(*keys, F.col("flag_count").alias("_stored"))
        joined = joined.join(stored, keys, "left").withColumn(
            "baseline_flags", F.coalesce("_stored", F.lit(0))
        )
    if keys == ["evaluator"]:
        names = scores.sparkSession.createDataFrame([(e,) for e in evaluators], "evaluator string")
        joined = names.join(joined, "evaluator", "left")
    zero = ("n_current", "n_baseline", "current_flags", "baseline_flags")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})

    n1, n2 = F.col("n_current"), F.col("n_baseline")
    enough = F.least(n1, n2) >= MIN_SAMPLE

    def per(n: Column) -> Column:
        return F.greatest(n, F.lit(1)).cast("double")

    measured = joined.withColumns(
        {
            "mann_whitney_u": F.when(enough, F.col("u")).otherwise(0.0),
            "z": F.when(enough, z_score(F.col("u"), n1, n2, F.col("ties"))),
            # NULL arguments spare the rows that are not tested.
            "p_value": F.coalesce(
                mann_whitney_p(
                    F.when(enough, F.col("u")),
                    F.when(enough, n1.cast("double")),
                    F.when(enough, n2.cast("double")),
                    F.when(enough, F.col("ties").cast("double")),
                ),
                F.lit(1.0),
            ),
            "cohens_d": F.when(enough, cohens_d()).otherwise(0.0),
            "flag_rate_delta": F.col("current_flags") / per(n1) - F.col("baseline_flags") / per(n2),
        }
    )
    effect = effect_label(F.col("cohens_d"))
    significant = (F.col("p_value") < alpha) & (effect != "negligible")
    above = lookup(F.col("evaluator"), config, "direction", "above") == "above"
    mean_delta = F.col("mean_current") - F.col("mean_baseline")
    tested = F.when(~significant, "stable").when(
        F.when(above, mean_delta > 0).otherwise(mean_delta < 0), "regression"
    )
    delta = F.col("flag_rate_delta")
    worse = F.when(above, delta > RATE_STEP).otherwise(delta < -RATE_STEP)
    better = F.when(above, delta < -RATE_STEP).otherwise(delta > RATE_STEP)
    # Small samples compare flag rates only; for quality evaluators the sign is inverted.
    fallback = F.when(worse, "regression").when(better, "improvement").otherwise("stable")
    return measured.select(
        *keys,
        "mann_whitney_u",
        "z",
        "p_value",
        "cohens_d",
        effect.alias("effect_size"),
        (significant & enough).alias("significant"),
        F.when(enough, tested.otherwise("improvement")).otherwise(fallback).alias("direction"),
        "flag_rate_delta",
        "n_current",
        "n_baseline",
    )


def auc(scored: DataFrame, keys: Sequence[str], positive: Column, value: str = "score") -> DataFrame:
    """Area under the ROC curve per key: U of the positives over the number of pairs."""
    s = two_samples(scored, keys, positive, value)
    pairs = F.col("n_current").cast("double") * F.col("n_baseline")
    return s.select(
        *keys,
        F.col("n_current").alias("n_positive"),
        F.col("n_baseline").alias("n_negative"),
        (F.col("u") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )


def quality_at(
    scored: DataFrame,
    keys: Sequence[str],
    positive: Column,
    thresholds: Sequence[float],
    value: str = "score",
) -> DataFrame:
    """Confusion counts, accuracy, precision and recall per key and threshold, in one pass."""
    labelled = scored.where(F.col(value).isNotNull())

    def counts(i: int, t: float) -> list[Column]:
        hit = F.col(value) >= t
        return [F.count_if(hit & positive).alias(f"tp{i}"), F.count_if(hit & ~positive).alias(f"fp{i}")]

    counted = labelled.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(positive).alias("n_positive"),
        *[c for i, t in enumerate(thresholds) for c in counts(i, t)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")
            )
            for i, t in enumerate(thresholds)
        ]
    )
    fn = F.col("n_positive") - F.col("tp")
    tn = F.col("n") - F.col("n_positive") - F.col("fp")
    return counted.select(*keys, "n", "n_positive", F.inline(entries)).select(
        *keys,
        "threshold",
        "tp",
        "fp",
        fn.alias("fn"),
        tn.alias("tn"),
        rate(F.col("tp") + tn, F.col("n")).alias("accuracy"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rate(F.col("tp"), F.col("n_positive")).alias("recall"),
    )
