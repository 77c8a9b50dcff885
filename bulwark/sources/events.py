"""Scored-request events for the feed, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.functions.flags import flag_names

EVENT_SCHEMA = (
    "event_type string, request_id string, tenant_id string, model string, blocked boolean, "
    "block_reason string, flags array<string>, scores struct<"
    + ", ".join(f"{n}: double" for n in NAMES)
    + ">, latency_total int"
)


def event_rows(requests: DataFrame) -> DataFrame:
    """One event per scored request."""
    return requests.select(
        F.when(F.col("blocked"), "request_blocked").otherwise("request_passed").alias("event_type"),
        F.col("id").cast("string").alias("request_id"),
        F.col("tenant_id").cast("string").alias("tenant_id"),
        "model",
        "blocked",
        "block_reason",
        flag_names().alias("flags"),
        F.struct(*[F.col(f"score_{n}").alias(n) for n in NAMES]).alias("scores"),
        "latency_total",
    )


def event_json(requests: DataFrame) -> DataFrame:
    events = event_rows(requests)
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Events from JSON text; malformed payloads are dropped."""
    parsed = raw.select(
        F.from_json(
            "value",
            EVENT_SCHEMA + ", _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ).alias("e")
    ).select("e.*")
    return parsed.where(F.col("_bad").isNull()).drop("_bad")
