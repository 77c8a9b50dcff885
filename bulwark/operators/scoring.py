"""The batch scorer: score each distinct text once, fail open per row, join back to every copy."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS, Evaluator
from bulwark.functions.text import UNIT, sha256
from bulwark.operators.cache import live
from bulwark.operators.deadline import NotLoaded, Supervised

NEEDS_CONTEXT = ("hallucination", "faithfulness")


@dataclass(frozen=True)
class Scorer:
    """A detector plugged into the engine.

    Give ``expr`` (a column builder, stays in the plan) or ``load`` and ``score_batch`` (a model
    loaded once per Python worker, called with one list per required column). With ``timeout_ms`` a
    call that has not returned by then is ended: its row has no score, error ``timeout`` and the
    deadline as latency, and the others are scored.
    """

    name: str
    requires: tuple[str, ...] = ("input_text",)
    chain: str = "input"
    direction: str = "above"
    threshold: float = 0.8
    action: str = "flag"
    expr: Callable[..., Column] | None = None
    load: Callable[[], Any] | None = None
    score_batch: Callable[..., Sequence[Any]] | None = None
    returns: str = "double"
    version: str = ""  # change it with the model, workers keep one model per name and version
    timeout_ms: int | None = None  # a deadline: the model runs in a child process that is ended at it
    rows_per_call: int = 1  # with a deadline: rows that share a call and its deadline


def catalogue_with(*scorers: Scorer) -> tuple[Evaluator, ...]:
    """The catalogue extended by new scorers; wide results get their columns from it."""
    known = {e.name for e in EVALUATORS}
    extra = [s for s in scorers if s.name not in known]
    start = len(EVALUATORS)
    return EVALUATORS + tuple(
        Evaluator(start + i, s.name, s.chain, s.direction, s.threshold, s.action)
        for i, s in enumerate(extra)
    )


class LoadError(RuntimeError):
    """A model that could not be loaded; remembered, so a worker tries once."""


_models: dict[tuple[str, str], Any] = {}


def _model(scorer: Scorer) -> Any:
    key = (scorer.name, scorer.version)
    if scorer.load and key not in _models:
        try:
            _models[key] = scorer.load()
        except Exception as exc:
            _models[key] = LoadError(f"model not loaded: {exc}")
    model = _models.get(key)
    if isinstance(model, LoadError):
        raise model
    return model


def _called(scorer: Scorer, model: Any, columns: Sequence[list]) -> list:
    scores = list(scorer.score_batch(model, *columns))
    if len(scores) != len(columns[0]):
        raise ValueError(f"{len(scores)} scores for {len(columns[0])} rows")
    return scores


def _score_rows(scorer: Scorer, columns: Sequence[list]) -> tuple[list, list]:
    """Scores and errors of a batch; when the batch fails, each row is tried alone.

    A model that does not load fails every row without another try.
    """
    n = len(columns[0])
    try:
        model = _model(scorer)
    except LoadError as exc:
        return [None] * n, [str(exc)] * n
    try:
        return _called(scorer, model, columns), [None] * n
    except Exception:
        scores, errors = [], []
        for row in zip(*columns, strict=True):
            try:
                scores.append(_called(scorer, model, [[v] for v in row])[0])
                errors.append(None)
            except Exception as exc:  # a failing evaluator never fails the job
                scores.append(None)
                errors.append(str(exc))
        return scores, errors


_children: dict[tuple[str, str], Supervised] = {}


def _supervised_rows(scorer: Scorer, columns: Sequence[list]) -> tuple[list, list, list]:
    """Scores, errors and latencies from the worker's child process for this model."""
    n = len(columns[0])
    key = (scorer.name, scorer.version)
    child = _children.setdefault(key, Supervised(scorer.load, scorer.score_batch))
    try:
        failed = _models.get(key)
        if isinstance(failed, LoadError):
            raise failed
        return child.rows(columns, scorer.timeout_ms / 1000, scorer.rows_per_call)
    except (NotLoaded, LoadError) as exc:
        _models[key] = exc if isinstance(exc, LoadError) else LoadError(str(exc))
        return [None] * n, [str(exc)] * n, [0] * n


def _runner(scorers: Sequence[Scorer]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scores batches of distinct texts with every scorer that reads the same columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"_scored": batch["_scored"]}
            columns = [batch[c].tolist() for c in scorers[0].requires]
            for s in scorers:
                started = time.monotonic()
                if s.timeout_ms is not None:
                    scores, errors, each = _supervised_rows(s, columns)
                else:
                    scores, errors = _score_rows(s, columns)
                    each = int((time.monotonic() - started) * 1000 / max(len(batch), 1))
                kind = "float64" if s.returns == "double" else "object"
                out[f"score_{s.name}"] = pd.Series(scores, dtype=kind)
                out[f"error_{s.name}"] = pd.Series(errors, dtype="object")
                out[f"latency_{s.name}"] = each
            yield pd.DataFrame(out)

    return run


def skip_reason(scorer: Scorer, columns: Sequence[str], skip_when: Column | None = None) -> Column:
    """Why an evaluator does not run on a row, or NULL when it does."""
    reason = F.lit(None).cast("string")
    if scorer.name in NEEDS_CONTEXT and "context_documents" in columns:
        no_context = F.coalesce(F.size("context_documents"), F.lit(0)) <= 0
        reason = F.when(no_context, "no context_documents").otherwise(reason)
    if scorer.chain == "output" and "output_text" in columns:
        no_output = F.coalesce(F.length("output_text"), F.lit(0)) == 0
        reason = F.when(no_output, "no output_text").otherwise(reason)
    if skip_when is not None:
        reason = F.when(skip_when, "not needed").otherwise(reason)
    return reason


def _groups(scorers: Iterable[Scorer]) -> list[list[Scorer]]:
    """Scorers that read the same columns of the same rows share one pass."""
    groups: dict[tuple, list[Scorer]] = {}
    for s in scorers:
        groups.setdefault((s.requires, s.chain, s.name in NEEDS_CONTEXT), []).append(s)
    return list(groups.values())


def score_all(
    df: DataFrame,
    scorers: Iterable[Scorer],
    parallelism: int | None = None,
    skip_when: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``score_``, ``error_``, ``latency_`` and ``skipped_<name>`` of every scorer.

    Rows are keyed by the hash of the scored columns, and each distinct text reaches a model once.
    A text crosses the network once per group of scorers that read the same columns; the groups'
    results meet on the hashes alone, and the rows of ``df`` join them once. With ``keep`` only
    those columns of ``df`` take part in that join and in the result, so without the texts it is
    narrow. When copies of one text dominate, AQE splits the join, since the scored side has one
    row per combination of hashes. ``parallelism`` fixes the number of scoring tasks for slow
    models; rows where ``skip_when`` holds are not scored.
    """
    scorers = list(scorers)
    columns = df.columns
    keyed = df
    in_python = _groups(s for s in scorers if s.expr is None)
    for s in scorers:
        keyed = keyed.withColumn(f"skipped_{s.name}", skip_reason(s, columns, skip_when))
        if s.expr is not None:
            value = s.expr(*[F.col(c) for c in s.requires])
            keyed = keyed.withColumns(
                {
                    f"score_{s.name}": F.when(F.col(f"skipped_{s.name}").isNull(), value),
                    f"error_{s.name}": F.lit(None).cast("string"),
                    f"latency_{s.name}": F.lit(0),
                }
            )
    for i, group in enumerate(in_python):
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group[0].requires]
        runs = F.col(f"skipped_{group[0].name}").isNull()
        keyed = keyed.withColumn(f"_key{i}", F.when(runs, sha256(F.concat_ws(UNIT, *parts))))
    kept = [c for c in keyed.columns if c not in columns or keep is None or c in keep]
    if not in_python:
        return keyed.select(*kept)
    keys = [f"_key{i}" for i in range(len(in_python))]
    results = keyed.select(*keys).distinct() if len(keys) > 1 else None
    names: list[str] = []
    for key, group in zip(keys, in_python):
        # Equal hashes have equal texts, so this is one row per hash without sorting any text.
        distinct = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("_scored"), *group[0].requires).distinct()
        if parallelism:
            distinct = distinct.repartition(parallelism, "_scored")
        fields = ", ".join(
            f"score_{s.name} {s.returns}, error_{s.name} string, latency_{s.name} int" for s in group
        )
        scored = distinct.mapInPandas(_runner(group), f"_scored string, {fields}")
        names += [c for c in scored.columns if c != "_scored"]
        if results is None:
            results = scored.withColumnRenamed("_scored", f"_found{key}")
        else:
            results = results.join(scored, F.col(key) == F.col("_scored"), "left").drop("_scored")
    found = {key: f"_found{key}" for key in keys}
    if len(keys) > 1:
        results = results.withColumnsRenamed(found)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f)) for k, f in found.items()])
    else:
        same = F.col(keys[0]) == F.col(found[keys[0]])
    joined = keyed.select(*kept).join(results, same, "left")
    latencies = {c: F.coalesce(c, F.lit(0)) for c in names if c.startswith("latency_")}
    return joined.withColumns(latencies).drop(*keys, *found.values())


def score(
    df: DataFrame, scorer: Scorer, parallelism: int | None = None, skip_when: Column | None = None
) -> DataFrame:
    """Add ``score``, ``error``, ``latency_ms`` and ``skipped`` of one scorer."""
    names = {"score": "score", "error": "error", "latency": "latency_ms", "skipped": "skipped"}
    scored = score_all(df, [scorer], parallelism, skip_when)
    return scored.withColumnsRenamed({f"{k}_{scorer.name}": v for k, v in names.items()})


def score_cached(df: DataFrame, scorer: Scorer, cache: DataFrame, as_of) -> DataFrame:
    """Like :func:`score`, with live cache entries (by ``cache_key``) used instead of the model.

    A cached row has latency 0 and the entry's ``metadata``, from which a redacted text comes; rows
    that were scored have no metadata. The cache has one row per key and evaluator.
    """
    hits = live(cache, as_of).where(F.col("evaluator") == scorer.name)
    entries = hits.select("cache_key", F.col("score").alias("_hit"), "metadata", F.lit(True).alias("cached"))
    looked_up = df.join(entries, "cache_key", "left").withColumn(
        "cached", F.coalesce("cached", F.lit(False))
    )
    scored = score(looked_up, scorer, skip_when=F.col("cached"))
    return scored.withColumn("score", F.when(F.col("cached"), F.col("_hit")).otherwise(F.col("score"))).drop("_hit")


def score_pairs(
    payloads: DataFrame,
    keys: Sequence[str],
    scorer: Scorer,
    documents: str = "context_documents",
    output: str = "output_text",
) -> DataFrame:
    """Score every (context document, output) pair: (keys, pos, score, error)."""
    present = F.length(output) > 0
    pairs = payloads.where(present).select(
        *keys, output, F.posexplode(documents).alias("pos", "document")
    )
    return score(pairs, scorer).select(*keys, "pos", "score", "error", "latency_ms")
