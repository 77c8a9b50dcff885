"""Logged HTTP responses of a live evaluation run, normalised to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import SCORECARD_NAMES
from bulwark.functions.text import uuid_or_null
from bulwark.operators.chain import BLOCK_CODES


def _body_schema(envelope: str) -> str:
    return (
        "choices array<struct<message: struct<content: string>>>, "
        f"`{envelope}` struct<request_id: string, scores: map<string, double>, "
        "flags: array<string>, latency_ms: map<string, int>>, "
        "error struct<type: string, code: string, score: double, threshold: double>"
    )


def _evaluator_of(code: Column) -> Column:
    name = None
    for evaluator, block_code in BLOCK_CODES.items():
        hit = code == block_code
        name = F.when(hit, evaluator) if name is None else name.when(hit, evaluator)
    return name


def _score_map(names, only: Column | None = None, value: Column | None = None) -> Column:
    entries = []
    for n in names:
        score = F.lit(None).cast("double") if only is None else F.when(only == n, value)
        entries += [F.lit(n), score]
    return F.create_map(*entries)


def normalise_responses(
    log: DataFrame,
    envelope: str = "guard",
    names: tuple[str, ...] = SCORECARD_NAMES,
    error_chars: int | None = None,
) -> DataFrame:
    """Results from (record_index, status, body[, failure]).

    200 gives scores, flags and the answer; 400 only the blocking evaluator's score; anything
    else, or a call that failed, gives an error. A row passes when it has no flag and no block,
    so errors pass. ``envelope`` names the body's object with scores and flags. Errors hold the
    whole body unless ``error_chars`` cuts it.
    """
    failure = F.col("failure") if "failure" in log.columns else F.lit(None).cast("string")
    parsed = log.withColumn("_failure", failure).withColumn(
        "b", F.from_json("body", _body_schema(envelope))
    )
    replied = F.col("_failure").isNull()
    ok, refused = replied & (F.col("status") == 200), replied & (F.col("status") == 400)
    g = F.col(f"b.`{envelope}`")
    code = F.coalesce(F.col("b.error.code"), F.lit(""))
    blocker = _evaluator_of(code)
    none = F.array().cast("array<string>")
    flags = F.when(ok, F.coalesce(g["flags"], none)).when(refused & blocker.isNotNull(), F.array(blocker))
    scores = F.when(ok, F.coalesce(g["scores"], _score_map(names))).when(
        refused, _score_map(names, blocker, F.col("b.error.score"))
    )
    body = F.coalesce("body", F.lit(""))
    error = F.when(~replied, F.col("_failure")).when(
        ~ok & ~refused,
        F.concat(
            F.lit("HTTP "),
            F.col("status").cast("string"),
            F.lit(": "),
            body if error_chars is None else F.substring(body, 1, error_chars),
        ),
    )
    results = parsed.select(
        "record_index",
        scores.otherwise(_score_map(names)).alias("scores"),
        flags.otherwise(none).alias("flags"),
        F.coalesce(refused, F.lit(False)).alias("blocked"),
        F.when(refused, code).alias("block_reason"),
        F.when(ok, F.get(F.col("b.choices"), F.lit(0))["message"]["content"]).alias("actual_output"),
        F.when(ok, uuid_or_null(g["request_id"])).alias("request_id"),
        F.when(ok, g["latency_ms"]).alias("latency_ms"),
        error.alias("error"),
    )
    return results.withColumn("passed", (F.size("flags") == 0) & ~F.col("blocked"))
