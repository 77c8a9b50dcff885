"""Scoring of (input, output, context) records with every evaluator, offline and as in live traffic."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import Evaluator, default_config
from bulwark.functions.flags import crosses
from bulwark.operators.chain import TIMEOUT_SECONDS, replay
from bulwark.operators.detectors import exfiltration, pii
from bulwark.operators.detectors.models import grounding
from bulwark.operators.scoring import Scorer, score_all, score_pairs
from bulwark.schemas import EVAL_RESULTS, conform
from bulwark.session import stored

PATTERN_SCORES = ("score_pii", "score_exfiltration")


def _grounded(records: DataFrame, consistency: Scorer) -> DataFrame:
    """Hallucination and faithfulness per request, from pairs scored once.

    A request with a failed pair has neither score; both carry the error and the pairs' latency.
    """
    pairs = score_pairs(records, ["request_id"], consistency)
    per_request = grounding(pairs.withColumnRenamed("score", "consistency"), ["request_id"])
    names = ("hallucination", "faithfulness")
    return per_request.select(
        "request_id",
        *[F.col(n).alias(f"score_{n}") for n in names],
        *[F.col("error").alias(f"error_{n}") for n in names],
        *[F.col("latency_ms").alias(f"latency_{n}") for n in names],
    )


def _all_scores(
    records: DataFrame, models: Sequence[Scorer], consistency: Scorer | None, keep: Sequence[str], skip_when: Column | None = None
) -> DataFrame:
    """Scores, errors and latencies per request, with the columns ``keep`` but without any text."""
    scored = score_all(records, models, keep=["request_id", *keep], skip_when=skip_when)
    if consistency is not None and "context_documents" in records.columns:
        scored = scored.join(_grounded(records, consistency), "request_id", "left")
    return scored


def _value(df: DataFrame, e: Evaluator) -> Column:
    name = f"score_{e.name}"
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _hit(df: DataFrame, e: Evaluator) -> Column:
    return crosses(_value(df, e), F.lit(e.direction), F.lit(e.threshold))


def _stopped(df: DataFrame, config: Iterable[Evaluator]) -> Column:
    """Whether any input evaluator blocks; pii that redacts does not."""
    stoppers = [
        _hit(df, e)
        for e in config
        if e.enabled and e.chain == "input" and not (e.name == "pii" and e.action == "redact")
    ]
    return reduce(lambda a, b: a | b, stoppers, F.lit(False))


def score_patterns(records: DataFrame, allowed_domains: Sequence[str] = ()) -> DataFrame:
    """Add the scores that are plain expressions: pii and exfiltration."""
    found = F.transform(pii.entities(F.col("input_text")), lambda e: e["score"])
    leaks = F.when(F.size(exfiltration.matches(F.col("output_text"), allowed_domains)) > 0, 1.0).otherwise(0.0)
    return records.withColumns(
        {
            "score_pii": F.coalesce(F.array_max(found), F.lit(0.0)),
            "score_exfiltration": F.when(F.length("output_text") > 0, leaks),
        }
    )


def evaluate(
    records: DataFrame,
    models: Sequence[Scorer],
    consistency: Scorer | None = None,
    config: Iterable[Evaluator] | None = None,
    timeout_seconds: float = TIMEOUT_SECONDS,
    logged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Offline evaluation: scores map, flags, blocked_by, error and passed per record.

    ``records`` has (request_id, input_text, output_text[, context_documents, record_index, ...]).
    Calls go through the chain as in live traffic: one over the timeout has no score, and the first
    input evaluator that blocks cancels the input calls that had not finished, which then have no
    score. Output evaluators run on the raw output, also when the input is blocked. Errors of one
    record do not touch others. ``logged`` may replace measured latencies in the calls
    (request_id, evaluator, ..., latency_ms) before the chain is replayed.

    The records are stored once; texts then cross the network once per group of models.
    """
    config = tuple(config or default_config())
    base = stored(score_patterns(records), "records")
    scored = _all_scores(base, models, consistency, PATTERN_SCORES)
    calls = calls_of(scored, config)
    kept = replay(calls if logged is None else logged(calls), config, enforce=False, timeout_seconds=timeout_seconds)
    entry = F.struct("ord", "evaluator", "score", "flag", "error")
    per_record = (
        kept.groupBy("request_id")
        .agg(F.max("blocked_by").alias("blocked_by"), F.sort_array(F.collect_list(entry)).alias("_calls"))
        .select(
            "request_id",
            "blocked_by",
            F.map_from_entries(F.transform("_calls", lambda c: F.struct(c["evaluator"], c["score"]))).alias("scores"),
            F.transform(F.filter("_calls", lambda c: c["flag"]), lambda c: c["evaluator"]).alias("flags"),
            F.array_join(
                F.transform(
                    F.filter("_calls", lambda c: c["error"].isNotNull()),
                    lambda c: F.concat(c["evaluator"], F.lit(": "), c["error"]),
                ),
                "; ",
            ).alias("error"),
        )
    )
    results = base.select(*records.columns).join(per_record, "request_id", "left")
    blocked = F.col("blocked_by").isNotNull()
    return results.withColumns({"blocked": blocked, "passed": ~blocked & (F.size("flags") == 0)})


def result_rows(results: DataFrame, run_id: str) -> DataFrame:
    """Offline results as rows of the result table, for ``tables.append_results``.

    ``record_index`` numbers them in dataset order; offline rows have no request id.
    """
    rows = results.select(
        F.lit(run_id).alias("eval_run_id"),
        F.lit(None).cast("string").alias("request_id"),
        "record_index",
        "input_text",
        F.col("output_text").alias("actual_output"),
        "passed",
        "scores",
    )
    return conform(rows, EVAL_RESULTS)


def calls_of(scored: DataFrame, config: Iterable[Evaluator]) -> DataFrame:
    """Wide scores as evaluator calls in long form, for the decision replay."""
    have = set(scored.columns)

    def column(prefix: str, e: Evaluator, kind: str) -> Column:
        name = f"{prefix}_{e.name}"
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    calls = [
        F.struct(
            F.lit(e.name).alias("evaluator"),
            F.lit(e.chain).alias("chain"),
            F.lit(e.ord).alias("ord"),
            _value(scored, e).alias("score"),
            F.coalesce(column("latency", e, "int"), F.lit(0)).alias("latency_ms"),
            column("error", e, "string").alias("error"),
        )
        for e in config
        if e.enabled
    ]
    return scored.select("request_id", F.inline(F.array(*calls)))


def guard(
    payloads: DataFrame,
    models: Sequence[Scorer],
    consistency: Scorer | None = None,
    config: Iterable[Evaluator] | None = None,
    enforce: bool = True,
    cheap_first: bool = True,
) -> DataFrame:
    """Calls of logged traffic as the live guardrail would make them.

    Records are stored once. Input evaluators run first, and their scores, without any text, are
    written too, so that scoring outputs does not run input models again; outputs of blocked requests are not scored unless
    ``enforce`` is off. ``cheap_first`` spares the input models the records that patterns already
    block. The result feeds ``chain.replay``.
    """
    config = tuple(config or default_config())
    of_input = [s for s in models if s.chain == "input"]
    of_output = [s for s in models if s.chain != "input"]
    records = stored(score_patterns(payloads), "records")
    by_pattern = _stopped(records, config) if cheap_first else None
    inputs = score_all(records, of_input, skip_when=by_pattern, keep=["request_id", "score_pii"])
    known = [c for s in of_input for c in (f"score_{s.name}", f"error_{s.name}", f"latency_{s.name}")]
    verdicts = stored(inputs.select("request_id", *known, _stopped(inputs, config).alias("_stopped")), "verdicts")
    judged = records.join(verdicts, "request_id")
    if enforce:
        answered = {c: F.when(~F.col("_stopped"), F.col(c)) for c in ("output_text", "score_exfiltration")}
        judged = judged.withColumns(answered)
    judged = stored(judged, "judged")
    scored = _all_scores(judged, of_output, consistency, [*PATTERN_SCORES, *known])
    return calls_of(scored, config)
