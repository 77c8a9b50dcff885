import json
import os

import pytest
from pyspark.sql import functions as F

from bulwark.schemas import REQUESTS
from bulwark.sources import events, golden, responses, tables, validation


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return path


def test_golden_defaults_and_dense_index(spark, folder):
    path = write(folder, "g.jsonl", [
        "# comment", "", '{"input": "a"}', "   ", '  {"input": "b", "model": null, "expected_blocked": true}  ',
        "  # indented comment", '{"input": "c", "model": "m", "context_documents": ["d1", "d2"], "extra": 1}',
    ])
    rows = golden.read_golden(spark, path).orderBy("record_index").collect()
    assert [(r.record_index, r.input, r.model) for r in rows] == [(0, "a", "llama3.2"), (1, "b", None), (2, "c", "m")]
    assert [r.context_documents for r in rows] == [[], [], ["d1", "d2"]]
    assert [r.expected_blocked for r in rows] == [False, True, False]


def test_golden_index_over_many_blocks_and_files(spark, folder):
    for f in range(3):
        lines = [json.dumps({"input": f"{f}-{i}"}) if i % 4 else "# skip" for i in range(900 * (3 - f))]
        write(folder, f"part-{f}.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = golden.read_golden(spark, folder).orderBy("record_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{f}-{i}" for f in range(3) for i in range(900 * (3 - f)) if i % 4]
    assert [r.record_index for r in rows] == list(range(len(want)))
    assert [r.input for r in rows] == want


def test_malformed_line_and_missing_input_fail(spark, folder):
    for bad, why in (("{not json", "MALFORMED_RECORD"), ('{"output": "x"}', "record without input")):
        path = write(folder, "bad.jsonl", ['{"input": "a"}', bad])
        with pytest.raises(Exception, match=why):
            golden.read_golden(spark, path).collect()


def test_offline_skips_absent_but_keeps_null_output(spark, folder):
    path = write(folder, "o.jsonl", [
        '{"input": "a"}', '{"input": "b", "output": null}', '{"input": "c", "output": "x", "tags": ["t"], "record_id": "r1"}',
    ])
    records, rejected = golden.read_offline(spark, path)
    rows = records.orderBy("record_index").collect()
    assert [(r.record_index, r.input, r.output) for r in rows] == [(0, "b", None), (1, "c", "x")]
    assert rows[1].tags == ["t"] and rows[1].record_id == "r1" and rows[0].tags == []
    assert [r.line for r in rejected.collect()] == ['{"input": "a"}']


def test_request_log_contract(spark, folder):
    names = [f.name for f in REQUESTS.fields]
    assert len(names) == 40
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05", 0.5)], "id string, at string, score_pii double")
    tables.append_requests(df.withColumn("created_at", F.col("at").cast("timestamp")), folder + "/log")
    tables.append_requests(df.withColumn("created_at", F.col("at").cast("timestamp")), folder + "/log")
    stored = spark.read.parquet(folder + "/log")
    assert stored.count() == 2 and str(stored.collect()[0].dt) == "2024-01-02"
    assert stored.collect()[0].score_toxicity is None


def test_validation_reports_each_violation(spark):
    df = spark.createDataFrame(
        [("1", 0.5, "correct_flag"), ("2", 1.5, "maybe"), (None, -0.1, None), ("4", None, None)],
        "id string, score_pii double, review_label string",
    )
    good, bad = validation.split(df, validation.request_checks(df))
    assert {r.id for r in good.collect()} == {"1", "4"}
    assert {r.id: sorted(r.violations) for r in bad.collect()} == {
        "2": ["review_label", "score_pii_range"],
        None: ["id_null", "score_pii_range"],
    }
    runs = spark.createDataFrame([("done", "live"), ("complete", "offline")], "status string, eval_mode string")
    _, wrong = validation.split(runs, validation.run_checks(runs))
    assert [r.violations for r in wrong.collect()] == [["status"]]
    twice = spark.createDataFrame([("t", "l"), ("t", "l"), ("u", "l")], "tenant_id string, label string")
    assert [r.n_rows for r in validation.duplicates(twice, ["tenant_id", "label"]).collect()] == [2]


def test_malformed_events_are_dropped(spark):
    raw = spark.createDataFrame([('{"event_type": "request_passed", "request_id": "1"}',), ("{oops",)], "value string")
    rows = events.parse_events(raw).collect()
    assert [(r.request_id, r.tenant_id) for r in rows] == [("1", None)]


def test_live_responses(spark):
    ok = {
        "choices": [{"message": {"content": "hi"}}],
        "guard": {"request_id": "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "scores": {"pii": 0.1, "toxicity": None},
                  "flags": ["toxicity"], "latency_ms": {"pii": 3}},
    }
    bare = {"choices": []}
    blocked = {"error": {"code": "off_topic", "score": 0.12}}
    strange = {"error": {"code": "something_else", "score": 0.3}}
    rows = [(0, 200, json.dumps(ok), None), (1, 200, json.dumps(bare), None), (2, 400, json.dumps(blocked), None),
            (3, 400, json.dumps(strange), None), (4, 502, "x" * 400, None), (5, None, None, "refused")]
    log = spark.createDataFrame(rows, "record_index int, status int, body string, failure string")
    r = {x.record_index: x for x in responses.normalise_responses(log).collect()}
    assert (r[0].actual_output, r[0].flags, r[0].passed) == ("hi", ["toxicity"], False)
    assert r[0].request_id == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11" and r[0].scores == {"pii": 0.1, "toxicity": None}
    assert r[1].passed and r[1].actual_output is None and set(r[1].scores.values()) == {None} and len(r[1].scores) == 7
    assert r[2].blocked and r[2].flags == ["topic_guardrail"] and r[2].scores["topic_guardrail"] == 0.12
    assert r[3].blocked and r[3].flags == [] and not r[3].passed
    assert r[4].error == "HTTP 502: " + "x" * 400 and r[4].passed
    short = responses.normalise_responses(log, error_chars=300).where("record_index = 4").first()
    assert short.error == "HTTP 502: " + "x" * 300
    assert r[5].error == "refused" and r[5].passed
