"""Column contracts of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.catalog import NAMES

# Review labels, run states and run modes the tables accept.
REVIEW_LABELS = ("correct_flag", "false_positive", "false_negative")
RUN_STATES = ("running", "complete", "failed")
RUN_MODES = ("live", "offline", "replay")

_S, _B, _D, _I, _TS = (
    T.StringType(),
    T.BooleanType(),
    T.DoubleType(),
    T.IntegerType(),
    T.TimestampType(),
)


def requests_schema(names: Sequence[str] = NAMES) -> T.StructType:
    """The request log; a catalogue with more evaluators has more columns."""

    def each(prefix: str, kind: T.DataType) -> list[T.StructField]:
        return [T.StructField(f"{prefix}_{name}", kind) for name in names]

    return T.StructType(
        [
            T.StructField("id", _S),
            T.StructField("created_at", _TS),
            T.StructField("tenant_id", _S),
            T.StructField("model", _S),
            T.StructField("input_hash", _S),
            T.StructField("input_text", _S),
            T.StructField("input_redacted", _S),
            T.StructField("has_context", _B),
            T.StructField("blocked", _B),
            T.StructField("block_reason", _S),
            *each("score", _D),
            *each("latency", _I),
            T.StructField("latency_llm", _I),
            T.StructField("latency_total", _I),
            *each("flag", _B),
            T.StructField("reviewed", _B),
            T.StructField("review_label", _S),
            T.StructField("reviewed_at", _TS),
            T.StructField("reviewer_note", _S),
        ]
    )


REQUESTS = requests_schema()

EVAL_RUNS = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("tenant_id", _S),
        T.StructField("created_at", _TS),
        T.StructField("completed_at", _TS),
        T.StructField("label", _S),
        T.StructField("dataset_path", _S),
        T.StructField("baseline_run_id", _S),
        T.StructField("record_count", _I),
        T.StructField("status", _S),
        T.StructField("prompt_version_id", _S),
        T.StructField("model_version_id", _S),
        T.StructField("eval_mode", _S),
        T.StructField("tags", T.ArrayType(_S)),
        T.StructField("config_snapshot", _S),
        T.StructField("summary_json", _S),
        T.StructField("regression_json", _S),
        T.StructField("statistical_regression_json", _S),
    ]
)

EVAL_RESULTS = T.StructType(
    [
        T.StructField("eval_run_id", _S),
        T.StructField("request_id", _S),
        T.StructField("record_index", T.LongType()),
        T.StructField("input_text", _S),
        T.StructField("expected_output", _S),
        T.StructField("actual_output", _S),
        T.StructField("passed", _B),
        T.StructField("scores", T.MapType(_S, _D)),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the order and types of ``schema``; columns it lacks become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
