from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bulwark.streaming import late

START = datetime(2024, 1, 1)


def _run(spark, batches, place, make, name):
    schema = "event_id long, ts timestamp"
    for part in batches:
        rows = [(i, START + timedelta(minutes=m)) for i, m in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(place / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
    writer = make(source).writeStream.format("parquet").queryName(name).option("path", str(place / "out"))
    writer.option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_late_rows_per_batch(spark, tmp_path):
    """Three batches move the watermark to minute 50; the fourth has 4 late events, the fifth 2, one event comes twice."""
    batches = [
        [(1, 0), (2, 60)],
        [(3, 59), (2, 60)],
        [(4, 58)],
        [(10, 1), (11, 1), (12, 2), (13, 50), (14, 51)],
        [(20, 3), (21, 49), (22, 61)],
    ]
    place = str(tmp_path / "late")
    with late.counted(spark, place, "late-test"):
        _run(spark, batches, tmp_path, late.distinct_events, "late-test")
    rows = late.late_rows(spark, place).orderBy("batch_id").collect()
    assert [(r.query, r.batch_id, r.operator, r.dropped) for r in rows] == [("late-test", 3, 0, 4), ("late-test", 4, 0, 2)]
    assert {r.operator_name for r in rows} == {"dedupeWithinWatermark"} and rows[0].watermark.startswith("2024-01-01T00:50")
    assert [r.dropped for r in late.totals(late.late_rows(spark, place)).collect()] == [6]
    kept = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [1, 2, 3, 4, 14, 22]


def test_nothing_late_and_other_queries(spark, tmp_path):
    place = str(tmp_path / "late")
    with late.counted(spark, place, "another"):
        _run(spark, [[(1, 0), (2, 60)], [(3, 59)], [(4, 1)]], tmp_path, late.distinct_events, "late-unnamed")
    assert late.late_rows(spark, place).count() == 0
    assert late.late_rows(spark, place).schema.names[0] == "query"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_progress_without_operators():
    assert late.dropped_rows({"runId": "r", "batchId": 1, "stateOperators": []}) == []
    one = {"runId": "r", "batchId": 2, "stateOperators": [{"numRowsDroppedByWatermark": 0}, {"operatorName": "x", "numRowsDroppedByWatermark": 5}]}
    assert [(r["operator"], r["dropped"], r["watermark"]) for r in late.dropped_rows(one)] == [(1, 5, None)]


def test_aggregation_counts_groups(spark, tmp_path):
    """What an aggregation drops was added up per task before: two late events of one window count as one."""
    place = str(tmp_path / "late")

    def windows(events):
        return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes")).count()

    with late.counted(spark, place):
        _run(spark, [[(1, 0), (2, 60)], [(3, 60)], [(4, 1), (5, 2), (6, 11)]], tmp_path, windows, "late-windows")
    assert [r.dropped for r in late.late_rows(spark, place).collect()] == [2]
