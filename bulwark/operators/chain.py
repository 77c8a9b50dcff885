"""Replay of guardrail decisions over a log of evaluator calls.

Calls are in long form: (request_id, evaluator, chain, ord, score, latency_ms, error[, cached]).
(request_id, evaluator) is a key, so the rows of one request are at most as many as the
catalogue has evaluators, and every per-request step below works on that few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS, FALLBACK_THRESHOLD, NAMES, Evaluator, enabled_names, lookup
from bulwark.functions.flags import flagged
from bulwark.operators.messages import retain_text
from bulwark.schemas import conform, requests_schema

# Error code per blocking evaluator; any other gives "<name>_detected".
BLOCK_CODES = {
    "pii": "pii_detected",
    "prompt_injection": "prompt_injection_detected",
    "topic_guardrail": "off_topic",
}
TIMEOUT_SECONDS = 3.0


def apply_thresholds(calls: DataFrame, config: Iterable[Evaluator] = EVALUATORS) -> DataFrame:
    """Add ``flag``; calls of disabled evaluators are dropped."""
    config = tuple(config)
    live = calls.where(F.col("evaluator").isin(*enabled_names(config)))
    return live.withColumn("flag", flagged(F.col("evaluator"), F.col("score"), config))


def normalise_timeouts(calls: DataFrame, timeout_seconds: float = TIMEOUT_SECONDS) -> DataFrame:
    """A call over the timeout has no score, the timeout as latency and error 'timeout'; an
    errored call has no score."""
    limit = int(timeout_seconds * 1000)
    late = F.col("latency_ms") > limit
    return calls.withColumns(
        {
            "score": F.when(late | F.col("error").isNotNull(), None).otherwise(F.col("score")),
            "error": F.when(late, F.lit("timeout")).otherwise(F.col("error")),
            "latency_ms": F.when(late, F.lit(limit)).otherwise(F.col("latency_ms")),
        }
    )


def blocks(config: Iterable[Evaluator] = EVALUATORS) -> Column:
    """A flagged input call blocks, unless it is pii that redacts."""
    action = lookup(F.col("evaluator"), tuple(config), "action", "block")
    redacts = (F.col("evaluator") == "pii") & (action == "redact")
    return F.col("flag") & (F.col("chain") == "input") & ~redacts


def _finish(calls: DataFrame) -> Column:
    """Completion order: cached results first in catalogue order, then by latency."""
    cached = F.coalesce(F.col("cached"), F.lit(False)) if "cached" in calls.columns else F.lit(False)
    return F.struct(
        (~cached).cast("int").alias("ran"),
        F.when(cached, F.lit(0)).otherwise(F.col("latency_ms")).alias("latency"),
        F.col("ord").alias("ord"),
    )


def _raced(calls: DataFrame, config: tuple[Evaluator, ...]) -> DataFrame:
    """Add each call's ``finish`` and the request's first blocker to finish."""
    with_finish = calls.withColumn("finish", _finish(calls))
    blocker = F.when(blocks(config), F.struct("finish", "evaluator", "score"))
    return with_finish.withColumn("_first", F.min(blocker).over(Window.partitionBy("request_id")))


def _finished() -> Column:
    """Whether an input call completed before the first blocker cancelled it."""
    stop = F.col("_first.finish")
    before_stop = (stop["ran"] == 1) & (F.col("finish") <= stop)
    return stop.isNull() | (F.col("finish.ran") == 0) | before_stop


def _with_blocker(raced: DataFrame, columns: Sequence[str]) -> DataFrame:
    return raced.select(
        *columns,
        "finish",
        F.col("_first.evaluator").alias("blocked_by"),
        F.col("_first.score").alias("blocker_score"),
    )


def input_race(calls: DataFrame, config: Iterable[Evaluator] = EVALUATORS) -> DataFrame:
    """Input calls that finished, with ``finish`` (their order) and ``blocked_by``.

    The first blocker cancels what is still running. Cached results all stay; when one of them
    blocks, nothing else runs.
    """
    raced = _raced(calls.where(F.col("chain") == "input"), tuple(config))
    return _with_blocker(raced.where(_finished()), calls.columns)


def output_results(calls: DataFrame) -> DataFrame:
    """Output calls: all run, none cancels another."""
    return calls.where(F.col("chain") == "output")


def assemble(
    results: DataFrame, names: Sequence[str] = NAMES, with_blocker: bool = False
) -> DataFrame:
    """One wide row per request from its kept calls (input and output together).

    ``blocked`` is true for any flagged input call and ``block_reason`` names the first one to
    finish, also when it only redacted; the request's true outcome is :func:`decisions`.
    """
    finish = F.col("finish") if "finish" in results.columns else _finish(results)
    is_input_flag = F.col("flag") & (F.col("chain") == "input")

    def only(name: str, column: Column) -> Column:
        return F.max(F.when(F.col("evaluator") == name, column))

    first = F.min(F.when(is_input_flag, F.struct(finish.alias("f"), F.col("evaluator"))))
    return (
        results.groupBy("request_id")
        .agg(
            *[only(n, F.col("score")).alias(f"score_{n}") for n in names],
            *[only(n, F.col("latency_ms")).alias(f"latency_{n}") for n in names],
            *[F.coalesce(only(n, F.col("flag")), F.lit(False)).alias(f"flag_{n}") for n in names],
            F.bool_or(is_input_flag).alias("blocked"),
            first.alias("_first"),
            *([F.max("blocked_by").alias("blocked_by")] if with_blocker else []),
        )
        .withColumn("block_reason", F.concat(F.col("_first.evaluator"), F.lit("_detected")))
        .drop("_first")
    )


def request_records(
    assembled: DataFrame,
    attributes: DataFrame,
    names: Sequence[str] = NAMES,
    store_input_text: bool = True,
    enforce: bool = True,
    config: Iterable[Evaluator] = EVALUATORS,
) -> DataFrame:
    """Rows for the request log: assembled results joined with the request's own attributes.

    ``attributes`` is keyed by ``request_id``; a missing total latency is stored as 0. With a
    ``redacted_text`` the stored texts follow ``messages.retain_text``. The redaction counts only
    where it was used: pii was flagged with action redact, and the request was not stopped.
    """
    joined = attributes.join(assembled, "request_id", "left")
    if "redacted_text" in attributes.columns:
        redacts = any(e.name == "pii" and e.enabled and e.action == "redact" for e in config)
        used = F.lit(redacts) & F.coalesce(F.col("flag_pii"), F.lit(False))
        if enforce and "blocked_by" in assembled.columns:
            used &= F.col("blocked_by").isNull()
        joined = joined.withColumn("redacted_text", F.when(used, F.col("redacted_text")))
        joined = retain_text(joined, store_input_text)
    flags = {f"flag_{n}": F.coalesce(F.col(f"flag_{n}"), F.lit(False)) for n in names}
    filled = joined.withColumns(
        {
            **flags,
            "blocked": F.coalesce(F.col("blocked"), F.lit(False)),
            "latency_total": F.coalesce(F.col("latency_total"), F.lit(0)),
            "reviewed": F.lit(False),
        }
    ).withColumnRenamed("request_id", "id")
    return conform(filled, requests_schema(names))


def block_code(evaluator: Column) -> Column:
    code = None
    for name, value in BLOCK_CODES.items():
        code = F.when(evaluator == name, value) if code is None else code.when(evaluator == name, value)
    return code.otherwise(F.concat(evaluator, F.lit("_detected")))


def decisions(
    results: DataFrame,
    config: Iterable[Evaluator] = EVALUATORS,
    enforce: bool = True,
    llm_errors: DataFrame | None = None,
    unstrippable: DataFrame | None = None,
) -> DataFrame:
    """The outcome of each request: blocked, llm_error, redacted, stripped or passed.

    ``results`` are kept calls with ``blocked_by`` on the input ones. With ``enforce=False``
    (shadow mode) blockers are reported but do not block. ``llm_errors`` lists request ids whose
    model call failed, ``unstrippable`` those whose answer could not be replaced: it was streamed,
    or nothing was left of it without its links. Those pass unless they were redacted.
    """
    config = tuple(config)
    action = lookup(F.col("evaluator"), config, "action", "flag")

    def acted(name: str, wanted: str) -> Column:
        hit = (F.col("evaluator") == name) & F.col("flag") & (action == wanted)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    per_request = results.groupBy("request_id").agg(
        F.max("blocked_by").alias("blocked_by"),
        F.max("blocker_score").alias("blocker_score"),
        acted("pii", "redact").alias("redacted"),
        acted("exfiltration", "strip").alias("stripped"),
    )
    if llm_errors is None:
        failed = F.lit(False)
    else:
        marked = llm_errors.select("request_id", F.lit(True).alias("_failed"))
        per_request = per_request.join(marked, "request_id", "left")
        failed = F.coalesce(F.col("_failed"), F.lit(False))
    stripped = F.col("stripped")
    if unstrippable is not None:
        whole = unstrippable.select("request_id", F.lit(True).alias("_whole")).distinct()
        per_request = per_request.join(whole, "request_id", "left")
        stripped &= F.col("_whole").isNull()
    stopped = F.col("blocked_by").isNotNull() & F.lit(enforce)
    return per_request.select(
        "request_id",
        F.when(stopped, "blocked")
        .when(failed, "llm_error")
        .when(F.col("redacted"), "redacted")
        .when(stripped, "stripped")
        .otherwise("passed")
        .alias("decision"),
        F.when(stopped, 400).when(failed, 502).otherwise(200).alias("status"),
        "blocked_by",
        F.when(F.col("blocked_by").isNotNull(), block_code(F.col("blocked_by"))).alias("code"),
        "blocker_score",
        F.when(
            F.col("blocked_by").isNotNull(),
            lookup(F.col("blocked_by"), config, "threshold", FALLBACK_THRESHOLD),
        ).alias("threshold"),
    )


def replay(
    calls: DataFrame,
    config: Iterable[Evaluator] = EVALUATORS,
    enforce: bool = True,
    timeout_seconds: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """Calls that count for the log: the input race plus output calls of requests not blocked.

    Without enforcement the output chain runs for every request.
    """
    config = tuple(config)
    ready = apply_thresholds(normalise_timeouts(calls, timeout_seconds), config)
    raced = _raced(ready, config)
    ran_output = F.col("_first").isNull() | F.lit(not enforce)
    kept = F.when(F.col("chain") == "input", _finished()).otherwise(ran_output)
    return _with_blocker(raced.where(kept), ready.columns)


def threshold_sweep(
    calls: DataFrame, thresholds: Sequence[float], config: Iterable[Evaluator] = EVALUATORS
) -> DataFrame:
    """How often each evaluator would flag under alternative thresholds.

    All thresholds are counted in one pass over the calls and then turned to rows.
    """
    config = tuple(config)
    above = lookup(F.col("evaluator"), config, "direction", "above") == "above"

    def hits(t: float) -> Column:
        return F.count_if(F.when(above, F.col("score") >= t).otherwise(F.col("score") <= t))

    counted = calls.groupBy("evaluator").agg(
        F.count("score").alias("n_scored"),
        *[hits(t).alias(f"t{i}") for i, t in enumerate(thresholds)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("would_flag"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counted.select("evaluator", "n_scored", F.inline(entries))
