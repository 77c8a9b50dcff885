"""Rows that watermarks drop, as a table.

Spark counts, per stateful operator and micro-batch, the rows that came later than the watermark. The counts
are in the query's progress, which is kept in memory for some batches only. :class:`LateRows` writes
each count that is not zero to a folder as the progress arrives, so none is lost however long a query
runs. What is counted are the rows that reach the operator: events before a de-duplication, groups
of events (already added up per task) before an aggregation. :func:`distinct_events` in front makes the
count one of events. A micro-batch drops what was late by the watermark of the batch before it, so a row
counts as late from the second micro-batch after the one that moved the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from bulwark.sources import snapshots

SCHEMA = (
    "query string, run_id string, batch_id long, operator int, operator_name string, watermark string, dropped long"
)


def dropped_rows(progress: dict) -> list[dict]:
    """One row per operator of a micro-batch that dropped something; operators count from 0."""
    watermark = (progress.get("eventTime") or {}).get("watermark")
    return [
        {
            "query": progress.get("name"),
            "run_id": progress["runId"],
            "batch_id": progress["batchId"],
            "operator": i,
            "operator_name": state.get("operatorName"),
            "watermark": watermark,
            "dropped": state["numRowsDroppedByWatermark"],
        }
        for i, state in enumerate(progress.get("stateOperators") or [])
        if state.get("numRowsDroppedByWatermark")
    ]


class LateRows(StreamingQueryListener):
    """Writes one JSON file per micro-batch with late rows; a repeated one has the same name per run."""

    def __init__(self, spark: SparkSession, path: str, query: str | None = None) -> None:
        self.spark, self.path, self.query = spark, path, query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        rows = dropped_rows(progress)
        if rows and (self.query is None or progress.get("name") == self.query):
            lines = "".join(json.dumps(r) + "\n" for r in rows)
            snapshots.write_text(self.spark, f"{self.path}/{progress['runId']}-{progress['batchId']}.json", lines)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def counted(spark: SparkSession, path: str, query: str | None = None) -> Iterator[None]:
    """Count the late rows of the queries that run inside (of one, by its name) into ``path``.

    Leaving waits until the progress of all micro-batches has been delivered.
    """
    listener = LateRows(spark, path, query)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; without rows if nothing came late."""
    if not snapshots.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def distinct_events(events: DataFrame, id: str = "event_id", time: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Events once each, for sources that deliver some twice; later than the watermark they are dropped.

    State holds an id until the watermark passes its time, so it is bounded by the traffic in between.
    """
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([id])


def totals(rows: DataFrame) -> DataFrame:
    """Dropped rows per query and operator over all runs."""
    return rows.groupBy("query", "operator_name").agg(F.sum("dropped").alias("dropped"))
