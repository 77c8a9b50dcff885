"""Queries over evaluation runs: scorecards, baselines, statistics, detector quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS, SCORECARD_NAMES
from bulwark.functions.flags import flagged
from bulwark.operators import runs, stats
from bulwark.plans import fixtures as fx
from bulwark.plans.registry import query, rounded, stamp_sql, stamped
from bulwark.session import scratch
from bulwark.sources import tables

GRID = (0.1, 0.25, 0.5, 0.75, 0.9)


def _run_flags(spark, sf):
    scores = fx.run_scores(spark, sf)
    return scores.withColumn("flag", flagged(F.col("evaluator"), F.col("score"), EVALUATORS))


def _card(spark, sf):
    return runs.scorecard(_run_flags(spark, sf))


_CARD = """
SELECT run_label, evaluator, round(mean, 9) AS mean, round(p50, 9) AS p50, round(p95, 9) AS p95,
  round(flag_rate, 9) AS flag_rate, flag_count, n, n_scored FROM scorecard"""


@query("scorecard", _CARD, ("scorecard",))
def scorecard(spark, sf):
    return rounded(_card(spark, sf))


@query(
    "scorecard_reports",
    """
SELECT c.run_label, c.evaluator, round(c.mean, 9) AS mean, round(c.p95, 9) AS p95, c.flag_count, c.n_scored,
  c.n AS n_records, round(c.flag_rate - b.flag_rate, 9) AS delta
FROM scorecard c JOIN scorecard b ON b.evaluator = c.evaluator AND b.run_label = 'baseline'""",
    ("scorecard",),
)
def scorecard_reports(spark, sf):
    """Reports written as JSON and read back."""
    card = _card(spark, sf)
    base = card.where(F.col("run_label") == "baseline").select(
        "evaluator", F.col("flag_rate").alias("baseline_flag_rate")
    )
    joined = card.select("run_label", "evaluator", F.col("flag_rate").alias("current_flag_rate")).join(
        base, "evaluator"
    )
    reports = tables.scorecard_report(
        card, runs.flag_rate_regression(joined), dataset_path=sf, duration_s=1.234
    )
    path = scratch(spark, "reports")
    tables.write_reports(reports, path)
    schema = (
        "label string, n_records long, summary map<string, struct<mean: double, p95: double, "
        "flag_count: long, n_scored: long>>, regression map<string, struct<delta: double>>"
    )
    parsed = spark.read.schema(schema).json(path)
    rows = parsed.select(
        F.col("label").alias("run_label"), "n_records", F.explode("summary").alias("evaluator", "s"), "regression"
    )
    return rounded(
        rows.select(
            "run_label",
            "evaluator",
            F.col("s.mean").alias("mean"),
            F.col("s.p95").alias("p95"),
            F.col("s.flag_count").alias("flag_count"),
            F.col("s.n_scored").alias("n_scored"),
            "n_records",
            F.col("regression")[F.col("evaluator")]["delta"].alias("delta"),
        )
    )


_RESULTS = """
  SELECT run_label, record_index, tenant_id, evaluator, score FROM run_scores JOIN (
    SELECT id, tenant_id FROM requests) r ON r.id = record_index"""


def _eval_results(spark, sf):
    """Stored results: one row per record with its scores as a map."""
    scores = fx.run_scores(spark, sf)
    return scores.groupBy("run_label", "record_index").agg(
        F.map_from_entries(F.collect_list(F.struct("evaluator", "score"))).alias("scores")
    )


@query(
    "baseline_scores",
    """
SELECT run_label AS run_id, CASE WHEN run_label = 'baseline' THEN 0 ELSE 1 END AS tenant_id, evaluator,
  count(*) AS n, round(sum(score), 6) AS total
FROM run_scores WHERE score IS NOT NULL AND run_label = 'baseline' GROUP BY ALL""",
    ("run_scores",),
)
def baseline_scores(spark, sf):
    results = _eval_results(spark, sf).withColumnRenamed("run_label", "run_id")
    tenant = F.when(F.col("run_id") == "baseline", 0).otherwise(1).alias("tenant_id")
    stored_runs = results.select("run_id").distinct().select("run_id", tenant)
    scores = runs.baseline_scores(results, stored_runs, tenant_id=0)
    grouped = scores.groupBy("run_id", "tenant_id", "evaluator").agg(
        F.count("*").alias("n"), F.sum("score").alias("total")
    )
    return rounded(grouped, 6)


@query(
    "eval_result_append",
    """
SELECT run_label AS eval_run_id, count(DISTINCT record_index) AS n_records, count(score) AS n_scores,
  round(sum(score), 6) AS total FROM run_scores GROUP BY run_label""",
    ("run_scores",),
)
def eval_result_append(spark, sf):
    results = _eval_results(spark, sf).select(
        F.col("run_label").alias("eval_run_id"), "record_index", "scores"
    )
    path = scratch(spark, "eval-results")
    tables.append_results(results, path)
    values = F.filter(F.map_values("scores"), lambda s: s.isNotNull())
    stored = spark.read.parquet(path).withColumn("v", values)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    grouped = stored.groupBy("eval_run_id").agg(
        F.count("*").alias("n_records"),
        F.sum(F.size("v").cast("long")).alias("n_scores"),
        F.sum(total).alias("total"),
    )
    return rounded(grouped, 6)


@query(
    "eval_run_append",
    """
SELECT status, CAST(tenant_id AS VARCHAR) AS tenant_id, count(*) AS n, CAST(sum(record_count) AS BIGINT) AS records
FROM eval_runs GROUP BY ALL""",
    ("eval_runs",),
)
def eval_run_append(spark, sf):
    path = scratch(spark, "eval-runs")
    tables.append_runs(fx.eval_runs(spark, sf).withColumnRenamed("run_id", "id"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("status", "tenant_id").agg(
        F.count("*").alias("n"), F.sum(F.col("record_count").cast("long")).alias("records")
    )


@query(
    "baseline_resolution",
    """
SELECT r.run_id, r.tenant_id, r.label, CASE WHEN b.status = 'complete' THEN b.run_id END AS baseline_run_id,
  CASE WHEN b.run_id IS NULL THEN 'baseline not found' WHEN b.status <> 'complete' THEN concat('baseline is ', b.status)
       ELSE 'compared' END AS comparison
FROM eval_runs r LEFT JOIN eval_runs b ON b.tenant_id = r.tenant_id AND b.label = r.baseline_label""",
    ("eval_runs",),
)
def baseline_resolution(spark, sf):
    resolved = runs.resolve_baseline(fx.eval_runs(spark, sf))
    return resolved.select("run_id", "tenant_id", "label", "baseline_run_id", "comparison")


@query(
    "recent_runs",
    f"""
SELECT run_id, label, status, record_count, {stamp_sql("created_at")} AS created_at
FROM eval_runs WHERE tenant_id = 1 ORDER BY eval_runs.created_at DESC, run_id DESC LIMIT 50""",
    ("eval_runs",),
)
def recent_runs(spark, sf):
    newest = runs.recent_runs(fx.eval_runs(spark, sf), tenant_id=1)
    return stamped(newest.select("run_id", "label", "status", "record_count", "created_at"))


@query(
    "run_states",
    f"""
SELECT run_id, tenant_id, label, {stamp_sql("created_at")} AS created_at,
  CASE WHEN status <> 'running' THEN {stamp_sql("created_at + INTERVAL '1' HOUR")} END AS completed_at, status,
  CASE WHEN status = 'complete' THEN record_count ELSE 0 END AS record_count
FROM eval_runs""",
    ("eval_runs",),
)
def run_states(spark, sf):
    stored = fx.eval_runs(spark, sf)
    started = stored.select(
        "run_id", "tenant_id", "label", F.lit(0).alias("seq"), F.col("created_at").alias("ts"),
        F.lit("running").alias("status"), F.lit(None).cast("long").alias("record_count"),
        F.lit(None).cast("string").alias("summary"),
    )
    ended = stored.where(F.col("status") != "running").select(
        "run_id", "tenant_id", "label", F.lit(1).alias("seq"),
        (F.col("created_at") + F.expr("INTERVAL '1' HOUR")).alias("ts"), "status",
        F.when(F.col("status") == "complete", F.col("record_count")).alias("record_count"),
        F.lit("{}").alias("summary"),
    )
    return stamped(runs.fold_states(started.unionByName(ended)).drop("summary"))


def _summaries(spark, sf):
    card = _card(spark, sf)
    # An evaluator missing on one side counts as rate 0.
    current = card.where((F.col("run_label") == "current") & (F.col("evaluator") != "relevance"))
    baseline = card.where((F.col("run_label") == "baseline") & (F.col("evaluator") != "toxicity"))
    return runs.join_summaries(current, baseline)


_JOINED = """
  SELECT evaluator,
    max(CASE WHEN run_label = 'baseline' AND evaluator <> 'toxicity' THEN flag_rate ELSE 0 END) AS baseline_flag_rate,
    max(CASE WHEN run_label = 'current' AND evaluator <> 'relevance' THEN flag_rate ELSE 0 END) AS current_flag_rate
  FROM scorecard GROUP BY evaluator"""


@query(
    "summary_join",
    f""", j AS ({_JOINED})
SELECT evaluator, round(baseline_flag_rate, 9) AS baseline_flag_rate, round(current_flag_rate, 9) AS current_flag_rate FROM j""",
    ("scorecard",),
)
def summary_join(spark, sf):
    return rounded(_summaries(spark, sf))


@query(
    "flag_rate_regression",
    f""", j AS ({_JOINED}), d AS (SELECT *, current_flag_rate - baseline_flag_rate AS delta FROM j)
SELECT evaluator, round(baseline_flag_rate, 9) AS baseline_flag_rate, round(current_flag_rate, 9) AS current_flag_rate,
  round(delta, 9) AS delta, delta > 0.05 AS regressed,
  CASE WHEN delta > 0.05 THEN 'regression' WHEN delta < -0.05 THEN 'improved' ELSE 'stable' END AS status FROM d""",
    ("scorecard",),
)
def flag_rate_regression(spark, sf):
    return rounded(runs.flag_rate_regression(_summaries(spark, sf)))


@query(
    "build_gate",
    f""", j AS ({_JOINED})
SELECT bool_or(current_flag_rate - baseline_flag_rate > 0.05) AS failed,
  count(*) FILTER (WHERE current_flag_rate - baseline_flag_rate > 0.05) AS n_regressions,
  CASE WHEN bool_or(current_flag_rate - baseline_flag_rate > 0.05) THEN 2 ELSE 0 END AS exit_code FROM j""",
    ("scorecard",),
)
def build_gate(spark, sf):
    return runs.gate(runs.flag_rate_regression(_summaries(spark, sf)))


def _sides(spark, sf):
    return _run_flags(spark, sf).withColumnRenamed("run_label", "side")


# U by midranks: the rank sum of the current sample minus its minimum.
_SAMPLES = """
  SELECT evaluator, n_current, n_baseline, rank_sum - n_current * (n_current + 1) / CAST(2 AS DOUBLE) AS u, ties,
    mean_current, mean_baseline, var_current, var_baseline, current_flags, baseline_flags, direction
  FROM (
    SELECT evaluator, any_value(direction) AS direction,
      count(*) FILTER (WHERE run_label = 'current') AS n_current,
      count(*) FILTER (WHERE run_label = 'baseline') AS n_baseline,
      sum(midrank) FILTER (WHERE run_label = 'current') AS rank_sum,
      sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties,
      avg(score) FILTER (WHERE run_label = 'current') AS mean_current,
      avg(score) FILTER (WHERE run_label = 'baseline') AS mean_baseline,
      var_samp(score) FILTER (WHERE run_label = 'current') AS var_current,
      var_samp(score) FILTER (WHERE run_label = 'baseline') AS var_baseline,
      count(*) FILTER (WHERE flag AND run_label = 'current') AS current_flags,
      count(*) FILTER (WHERE flag AND run_label = 'baseline') AS baseline_flags
    FROM (
      SELECT *, rank() OVER (PARTITION BY evaluator ORDER BY score) + (t - 1) / CAST(2 AS DOUBLE) AS midrank
      FROM (SELECT *, count(*) OVER (PARTITION BY evaluator, score) AS t FROM run_flags WHERE score IS NOT NULL) c) r
    GROUP BY evaluator) q"""


@query(
    "mann_whitney",
    f"""
SELECT evaluator, n_current, n_baseline, round(u, 3) AS u, round(ties, 3) AS ties, round(mean_current, 9) AS mean_current,
  round(mean_baseline, 9) AS mean_baseline, round(var_current, 9) AS var_current, round(var_baseline, 9) AS var_baseline
FROM ({_SAMPLES}) s""",
    ("run_flags",),
)
def mann_whitney(spark, sf):
    listed = _sides(spark, sf).where(F.col("evaluator").isin(*SCORECARD_NAMES))
    samples = stats.two_samples(listed, ["evaluator"], F.col("side") == "current")
    return rounded(samples.withColumns({c: F.round(c, 3) for c in ("u", "ties")}))


_COMPARED = f""", s AS ({_SAMPLES}), m AS (
  SELECT *, CAST(n_current AS DOUBLE) * n_baseline AS nn, CAST(n_current + n_baseline AS DOUBLE) AS n,
    CASE WHEN least(n_current, n_baseline) < 2 THEN 0 ELSE coalesce((mean_current - mean_baseline) / nullif(sqrt(
      ((n_current - 1) * var_current + (n_baseline - 1) * var_baseline) / (n_current + n_baseline - 2)), 0), 0) END AS d
  FROM s), z AS (
  SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM m)"""


@query(
    "run_comparison",
    f"""{_COMPARED}
SELECT evaluator, round(u, 3) AS mann_whitney_u, round(z, 6) AS z, round(d, 9) AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size,
  z > 1.959963984540054 AND abs(d) >= 0.2 AS significant,
  CASE WHEN NOT (z > 1.959963984540054 AND abs(d) >= 0.2) THEN 'stable'
       WHEN CASE WHEN direction = 'above' THEN mean_current > mean_baseline ELSE mean_current < mean_baseline END THEN 'regression'
       ELSE 'improvement' END AS direction,
  round(current_flags / CAST(n_current AS DOUBLE) - baseline_flags / CAST(n_baseline AS DOUBLE), 9) AS flag_rate_delta,
  n_current, n_baseline FROM z""",
    ("run_flags",),
)
def run_comparison(spark, sf):
    """The p-value itself has no SQL equivalent; significance at 5% follows from |z|."""
    table = stats.compare_runs(_sides(spark, sf)).drop("p_value")
    return rounded(table.withColumns({"mann_whitney_u": F.round("mann_whitney_u", 3), "z": F.round("z", 6)}))


# 1 - 2 (integral of the normal density from 0 to z), by Simpson's rule in 2,000 steps.
_NORMAL_P = """, p AS (
  SELECT evaluator, greatest(0, least(1, coalesce(1 - 2 * (max(z) / 2000 / 3 * sum(
    CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 2000) * (z * i / 2000) / 2) / sqrt(2 * pi()))), 1))) AS p
  FROM z CROSS JOIN range(0, 2001) r(i) GROUP BY evaluator)"""


@query(
    "run_comparison_p_values",
    f"""{_COMPARED}{_NORMAL_P}
SELECT evaluator, round(p, 9) AS p_value, p < 0.05 AND abs(d) >= 0.2 AS significant,
  CASE WHEN NOT (p < 0.05 AND abs(d) >= 0.2) THEN 'stable'
       WHEN CASE WHEN direction = 'above' THEN mean_current > mean_baseline ELSE mean_current < mean_baseline END THEN 'regression'
       ELSE 'improvement' END AS direction
FROM z JOIN p USING (evaluator)""",
    ("run_flags",),
)
def run_comparison_p_values(spark, sf):
    return rounded(stats.compare_runs(_sides(spark, sf)).select("evaluator", "p_value", "significant", "direction"))


@query(
    "exact_comparison",
    """, g AS (
  SELECT id // 13 AS batch, id % 13 < 6 AS cur, (id * 7919) % 10007 AS score FROM requests
), s AS (
  SELECT a.batch, count(*) FILTER (WHERE b.score < a.score) AS u FROM g a JOIN g b ON a.batch = b.batch AND a.cur AND NOT b.cur GROUP BY a.batch
), n AS (SELECT batch, count(*) FILTER (WHERE cur) AS n1, count(*) FILTER (WHERE NOT cur) AS n2 FROM g GROUP BY batch
), ways AS (
  SELECT list_sum(list_transform(range(13), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i ELSE 0 END)) - 15 AS u
  FROM range(0, 8192) r(m) WHERE bit_count(m) = 6
), tail AS (SELECT v.upper, count(*) AS n FROM (SELECT DISTINCT greatest(u, 42 - u) AS upper FROM s) v JOIN ways w ON w.u >= v.upper GROUP BY 1)
SELECT batch, n1 AS n_current, n2 AS n_baseline, CASE WHEN n2 >= 5 THEN CAST(u AS DOUBLE) ELSE 0 END AS mann_whitney_u,
  CASE WHEN n2 >= 5 THEN round(least(1, 2 * t.n / CAST(1716 AS DOUBLE)), 9) ELSE 1 END AS p_value
FROM n LEFT JOIN s USING (batch) LEFT JOIN tail t ON t.upper = greatest(u, 42 - u) WHERE n1 = 6 AND n2 = 7""",
    ("requests",),
)
def exact_comparison(spark, sf):
    """Six against seven distinct scores: the exact distribution, counted by enumeration in SQL."""
    i = F.col("id")
    scores = fx.requests(spark, sf).select(
        F.floor(i / 13).alias("batch"),
        F.lit("toxicity").alias("evaluator"),
        F.when(i % 13 < 6, "current").otherwise("baseline").alias("side"),
        ((i * 7919) % 10007).cast("double").alias("score"),
        F.lit(False).alias("flag"),
    )
    table = stats.compare_runs(scores, ["batch", "evaluator"]).where("n_current = 6 AND n_baseline = 7")
    return rounded(table.select("batch", "n_current", "n_baseline", "mann_whitney_u", "p_value"))


@query(
    "statistical_gate",
    f"""{_COMPARED}, g AS (SELECT z > 1.959963984540054 AND abs(d) >= 0.2 AND
  CASE WHEN direction = 'above' THEN mean_current > mean_baseline ELSE mean_current < mean_baseline END AS bad FROM z)
SELECT bool_or(bad) AS failed, count(*) FILTER (WHERE bad) AS n_regressions,
  CASE WHEN bool_or(bad) THEN 2 ELSE 0 END AS exit_code FROM g""",
    ("run_flags",),
)
def statistical_gate(spark, sf):
    return runs.gate(stats.compare_runs(_sides(spark, sf)))


# Groups of four requests per side: below the sample size that is tested.
@query(
    "small_sample_comparison",
    """, g AS (
  SELECT record_index // 8 AS batch, evaluator, any_value(direction) AS way,
    count(score) FILTER (WHERE run_label = 'current') AS n1, count(score) FILTER (WHERE run_label = 'baseline') AS n2,
    count(*) FILTER (WHERE flag AND run_label = 'current') AS f1,
    count(*) FILTER (WHERE flag AND run_label = 'baseline') AS f2
  FROM run_flags GROUP BY ALL
), d AS (SELECT *, f1 / CAST(greatest(n1, 1) AS DOUBLE) - f2 / CAST(greatest(n2, 1) AS DOUBLE) AS delta FROM g)
SELECT batch, evaluator, n1 AS n_current, n2 AS n_baseline, round(delta, 9) AS flag_rate_delta, CAST(1 AS DOUBLE) AS p_value,
  CAST(0 AS DOUBLE) AS mann_whitney_u, 'negligible' AS effect_size, false AS significant,
  CASE WHEN CASE WHEN way = 'above' THEN delta > 0.05 ELSE delta < -0.05 END THEN 'regression'
       WHEN CASE WHEN way = 'above' THEN delta < -0.05 ELSE delta > 0.05 END THEN 'improvement'
       ELSE 'stable' END AS direction
FROM d""",
    ("run_flags",),
)
def small_sample_comparison(spark, sf):
    batch = F.floor(F.col("record_index") / 8).alias("batch")
    scores = _sides(spark, sf).select(batch, "evaluator", "side", "score", "flag")
    table = stats.compare_runs(scores, ["batch", "evaluator"])
    return rounded(
        table.select(
            "batch", "evaluator", "n_current", "n_baseline", "flag_rate_delta", "p_value",
            "mann_whitney_u", "effect_size", "significant", "direction",
        )
    )


# Detector quality: simple text statistics as detectors, labels as truth.
_DETECTORS = """
  SELECT doc_id, toxic, quality, detector, score FROM (
    SELECT l.doc_id, l.toxic, l.quality, 'shortness' AS detector, round(1 / (1 + d.n_chars / CAST(1000 AS DOUBLE)), 6) AS score
    FROM labels l JOIN documents d USING (doc_id)
    UNION ALL
    SELECT l.doc_id, l.toxic, l.quality, 'digit_share',
      round(length(regexp_replace(d.text, '[^0-9]', '', 'g')) / CAST(greatest(length(d.text), 1) AS DOUBLE), 6)
    FROM labels l JOIN documents d USING (doc_id)) q"""


def _detectors(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    joined = fx.table(spark, sf, "labels").join(docs, "doc_id")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    shares = F.array(
        F.struct(
            F.lit("shortness").alias("detector"),
            F.round(1 / (1 + F.col("n_chars") / F.lit(1000.0)), 6).alias("score"),
        ),
        F.struct(
            F.lit("digit_share").alias("detector"),
            F.round(digits / F.greatest(F.length("text"), F.lit(1)), 6).alias("score"),
        ),
    )
    return joined.select("doc_id", "toxic", "quality", F.inline(shares))


@query(
    "detector_auc",
    f"""WITH s AS ({_DETECTORS}), r AS (
  SELECT *, rank() OVER (PARTITION BY detector ORDER BY score)
    + (count(*) OVER (PARTITION BY detector, score) - 1) / CAST(2 AS DOUBLE) AS midrank FROM s)
SELECT detector, count(*) FILTER (WHERE quality = 0) AS n_positive, count(*) FILTER (WHERE quality <> 0) AS n_negative,
  round((sum(midrank) FILTER (WHERE quality = 0) - count(*) FILTER (WHERE quality = 0)
    * (count(*) FILTER (WHERE quality = 0) + 1) / CAST(2 AS DOUBLE))
    / (count(*) FILTER (WHERE quality = 0) * count(*) FILTER (WHERE quality <> 0)), 9) AS auc
FROM r GROUP BY detector""",
)
def detector_auc(spark, sf):
    return rounded(stats.auc(_detectors(spark, sf), ["detector"], F.col("quality") == 0))


@query(
    "detector_quality",
    f"WITH s AS ({_DETECTORS}), c AS ("
    + " UNION ALL ".join(
        f"""SELECT detector, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= {t} AND quality = 0) AS tp,
  count(*) FILTER (WHERE score >= {t} AND quality <> 0) AS fp, count(*) FILTER (WHERE score < {t} AND quality = 0) AS fn,
  count(*) FILTER (WHERE score < {t} AND quality <> 0) AS tn FROM s GROUP BY detector"""
        for t in GRID
    )
    + """)
SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy,
  round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 9) AS "precision",
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 9) AS recall FROM c""",
)
def detector_quality(spark, sf):
    return rounded(stats.quality_at(_detectors(spark, sf), ["detector"], F.col("quality") == 0, GRID))
