"""Queries that replay guardrail decisions over the call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.operators import chain
from bulwark.plans import fixtures as fx
from bulwark.plans.registry import as_doubles, query

SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _flagged(spark, sf):
    return chain.apply_thresholds(chain.normalise_timeouts(fx.eval_calls(spark, sf)))


def _replayed(spark, sf, enforce=True):
    return chain.replay(fx.eval_calls(spark, sf), enforce=enforce)


@query(
    "threshold_flags",
    """
SELECT e.request_id, e.evaluator, e.score,
  coalesce(CASE WHEN c.direction = 'above' THEN e.score >= c.threshold ELSE e.score <= c.threshold END, false) AS flag
FROM eval_calls e JOIN evaluator_config c USING (evaluator) WHERE e.evaluator <> 'topic_guardrail'""",
    ("eval_calls",),
)
def threshold_flags(spark, sf):
    from bulwark.catalog import default_config

    flagged = chain.apply_thresholds(fx.eval_calls(spark, sf), default_config())
    return flagged.select("request_id", "evaluator", "score", "flag")


@query("call_timeouts", "SELECT request_id, evaluator, score, latency_ms, error FROM normalised", ("normalised",))
def call_timeouts(spark, sf):
    calls = chain.normalise_timeouts(fx.eval_calls(spark, sf))
    return calls.select("request_id", "evaluator", "score", "latency_ms", "error")


@query(
    "blocking_calls",
    """
SELECT evaluator, count(*) FILTER (WHERE flag) AS flagged,
  count(*) FILTER (WHERE flag AND chain = 'input' AND NOT (evaluator = 'pii' AND action = 'redact')) AS blocking
FROM flagged_calls GROUP BY evaluator""",
    ("flagged_calls",),
)
def blocking_calls(spark, sf):
    calls = _flagged(spark, sf).withColumn("blocks", chain.blocks())
    return calls.groupBy("evaluator").agg(
        F.count_if("flag").alias("flagged"), F.count_if("blocks").alias("blocking")
    )


# Cached calls: some entries answer at once, and a blocking one stops everything not cached.
_CACHED = """
  SELECT f.*, (request_id + ord) % 13 = 0 AS cached,
         CASE WHEN (request_id + ord) % 13 = 0 THEN 0 ELSE latency_ms END AS took
  FROM flagged_calls f WHERE chain = 'input'"""


@query(
    "input_race",
    f""", c AS ({_CACHED}), first AS (
  SELECT * FROM (
    SELECT request_id, evaluator AS blocked_by, score AS blocker_score, cached AS stop_cached, took AS stop_ms, ord AS stop_ord,
      row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN cached THEN 0 ELSE 1 END, took, ord) AS rn
    FROM c WHERE flag AND evaluator <> 'pii') q WHERE rn = 1)
SELECT c.request_id, c.evaluator, c.score, c.flag, f.blocked_by, f.blocker_score
FROM c LEFT JOIN first f USING (request_id)
WHERE f.blocked_by IS NULL OR c.cached
   OR (NOT f.stop_cached AND (c.took < f.stop_ms OR (c.took = f.stop_ms AND c.ord <= f.stop_ord)))""",
    ("flagged_calls",),
)
def input_race(spark, sf):
    cached = (F.col("request_id") + F.col("ord")) % 13 == 0
    calls = _flagged(spark, sf).withColumn("cached", cached)
    raced = chain.input_race(calls)
    return raced.select("request_id", "evaluator", "score", "flag", "blocked_by", "blocker_score")


@query(
    "output_results",
    "SELECT request_id, evaluator, score, flag, latency_ms FROM flagged_calls WHERE chain = 'output'",
    ("flagged_calls",),
)
def output_results(spark, sf):
    results = chain.output_results(_flagged(spark, sf))
    return results.select("request_id", "evaluator", "score", "flag", "latency_ms")


_WIDE = ", ".join(
    [f"max(score) FILTER (WHERE evaluator = '{n}') AS score_{n}" for n in NAMES]
    + [f"CAST(max(latency_ms) FILTER (WHERE evaluator = '{n}') AS DOUBLE) AS latency_{n}" for n in NAMES]
    + [f"coalesce(bool_or(flag) FILTER (WHERE evaluator = '{n}'), false) AS flag_{n}" for n in NAMES]
)
_ASSEMBLED = f"""
  SELECT r.request_id, {_WIDE}, bool_or(flag AND chain = 'input') AS blocked, any_value(w.block_reason) AS block_reason
  FROM replayed r LEFT JOIN (
    SELECT request_id, concat(evaluator, '_detected') AS block_reason FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY latency_ms, ord) AS rn
      FROM replayed WHERE flag AND chain = 'input') q WHERE rn = 1) w USING (request_id)
  GROUP BY r.request_id"""


@query("assembled_results", _ASSEMBLED, ("replayed",))
def assembled_results(spark, sf):
    return as_doubles(chain.assemble(_replayed(spark, sf)), *[f"latency_{n}" for n in NAMES])


@query(
    "request_records",
    f""", a AS ({_ASSEMBLED})
SELECT CAST(a.request_id AS VARCHAR) AS id, r.model, CAST(r.tenant_id AS VARCHAR) AS tenant_id, a.blocked, a.block_reason,
  a.score_pii, a.score_relevance, a.latency_toxicity, a.flag_pii, a.flag_faithfulness,
  CASE WHEN r.id % 10 = 0 THEN 0 ELSE r.latency_total END AS latency_total, r.has_context, false AS reviewed
FROM a JOIN requests r ON r.id = a.request_id""",
    ("replayed", "requests"),
)
def request_records(spark, sf):
    attributes = fx.requests(spark, sf).select(
        F.col("id").alias("request_id"),
        "created_at",
        "tenant_id",
        "model",
        "has_context",
        F.when(F.col("id") % 10 != 0, F.col("latency_total")).alias("latency_total"),
    )
    records = chain.request_records(chain.assemble(_replayed(spark, sf)), attributes)
    return as_doubles(records, "latency_toxicity").select(
        "id", "model", "tenant_id", "blocked", "block_reason", "score_pii", "score_relevance",
        "latency_toxicity", "flag_pii", "flag_faithfulness", "latency_total", "has_context", "reviewed",
    )


def _decisions_sql(enforce: bool, can_strip: str = "true") -> str:
    source = "replayed" if enforce else "shadow"
    shadow = (
        ""
        if enforce
        else """, shadow AS (
  SELECT c.*, b.blocked_by, b.blocker_score FROM flagged_calls c LEFT JOIN blockers b USING (request_id)
  WHERE b.blocked_by IS NULL OR c.chain = 'output' OR c.latency_ms < b.stop_ms
     OR (c.latency_ms = b.stop_ms AND c.ord <= b.stop_ord))"""
    )
    stopped = "blocked_by IS NOT NULL" if enforce else "false"
    return f"""{shadow}, d AS (
  SELECT request_id, max(blocked_by) AS blocked_by, max(blocker_score) AS blocker_score,
    coalesce(bool_or(evaluator = 'pii' AND flag), false) AS redacted,
    coalesce(bool_or(evaluator = 'exfiltration' AND flag), false) AS stripped, request_id % 41 = 0 AS failed
  FROM {source} GROUP BY request_id)
SELECT request_id,
  CASE WHEN {stopped} THEN 'blocked' WHEN failed THEN 'llm_error' WHEN redacted THEN 'redacted'
       WHEN stripped AND {can_strip} THEN 'stripped' ELSE 'passed' END AS decision,
  CASE WHEN {stopped} THEN 400 WHEN failed THEN 502 ELSE 200 END AS status, blocked_by,
  CASE blocked_by WHEN 'prompt_injection' THEN 'prompt_injection_detected' WHEN 'topic_guardrail' THEN 'off_topic' END AS code,
  blocker_score,
  CASE blocked_by WHEN 'prompt_injection' THEN CAST(0.8 AS DOUBLE) WHEN 'topic_guardrail' THEN CAST(0.3 AS DOUBLE) END AS threshold
FROM d"""


def _llm_errors(spark, sf):
    log = fx.requests(spark, sf).select(F.col("id").alias("request_id"))
    return log.where(F.col("request_id") % 41 == 0)


@query("decisions", _decisions_sql(True), ("replayed",))
def decisions(spark, sf):
    return chain.decisions(_replayed(spark, sf), llm_errors=_llm_errors(spark, sf))


@query("streamed_decisions", _decisions_sql(True, "request_id % 2 = 1"), ("replayed",))
def streamed_decisions(spark, sf):
    """Every second answer was streamed; those cannot be stripped any more."""
    streamed = fx.requests(spark, sf).select(F.col("id").alias("request_id")).where("request_id % 2 = 0")
    return chain.decisions(_replayed(spark, sf), llm_errors=_llm_errors(spark, sf), unstrippable=streamed)


@query("shadow_decisions", _decisions_sql(False), ("flagged_calls", "blockers"))
def shadow_decisions(spark, sf):
    replayed = _replayed(spark, sf, enforce=False)
    return chain.decisions(replayed, enforce=False, llm_errors=_llm_errors(spark, sf))


@query(
    "threshold_sweep",
    " UNION ALL ".join(
        f"""SELECT e.evaluator, count(e.score) AS n_scored, CAST({t} AS DOUBLE) AS threshold,
  count(*) FILTER (WHERE CASE WHEN c.direction = 'above' THEN e.score >= {t} ELSE e.score <= {t} END) AS would_flag
FROM eval_calls e JOIN evaluator_config c USING (evaluator) GROUP BY e.evaluator"""
        for t in SWEEP
    ),
    ("eval_calls", "evaluator_config"),
)
def threshold_sweep(spark, sf):
    return chain.threshold_sweep(fx.eval_calls(spark, sf), SWEEP)
