"""Allowed topics in tables, small and large."""

import numpy as np
import pytest

from bulwark.operators.detectors import vectors

ROWS = "id long, tenant string, v array<double>, score_of string"


def plain(rows, topics, by_tenant):
    """Best cosine of each row over the topics it may use."""
    out = {}
    for id, tenant, v, _ in rows:
        allowed = [t for k, t in topics if not by_tenant or (k == tenant and k is not None)]
        if not allowed:
            out[id] = 1.0
            continue
        width = len(min(allowed))
        if v is None or None in v or len(v) != width:
            out[id] = None
            continue
        unit = lambda x: np.asarray(x) / (np.linalg.norm(x) or 1)
        out[id] = max(0.0, *(float(unit(v) @ unit(t)) for t in allowed if len(t) == width))
    return out


def table(rng, n):
    rows = [(i, rng.choice(["a", "b", "none"]).item(), rng.normal(size=4).tolist(), None) for i in range(n)]
    return rows + [(n, None, [1.0] * 4, "x"), (n + 1, "a", None, "x"), (n + 2, "a", [1.0, None, 1.0, 1.0], "x"), (n + 3, "a", [1.0] * 3, "x"), (n + 4, "b", [0.0] * 4, "x"), *rows[:5]]


@pytest.mark.parametrize("small", [1 << 20, 0])
@pytest.mark.parametrize("by_tenant", [True, False])
def test_both_ways_equal_all_pairs(spark, monkeypatch, small, by_tenant):
    monkeypatch.setattr(vectors, "SMALL", small)
    monkeypatch.setattr(vectors, "TOPICS", 7)
    monkeypatch.setattr(vectors, "VECTORS", 11)
    rng = np.random.default_rng(4)
    rows = table(rng, 90)
    topics = [(rng.choice(["a", "b"]).item(), rng.normal(size=4).tolist()) for _ in range(40)] + [(None, [9.0] * 4), ("c", [1.0] * 4)]
    df = spark.createDataFrame(rows, ROWS)
    topic_table = spark.createDataFrame(topics, "tenant string, topic array<double>")
    if not by_tenant:
        topic_table = topic_table.select("topic")
    scored = vectors.topic_guardrail_by(df, "v", topic_table, "topic")
    assert scored.columns == [*df.columns, "score", "error"]
    got = scored.collect()
    assert len(got) == len(rows)
    want = plain(rows, topics, by_tenant)
    for r in got:
        assert (r["score"] is None) == (want[r["id"]] is None) == (r["error"] is not None)
        assert r["score"] is None or r["score"] == pytest.approx(want[r["id"]], abs=1e-12)


@pytest.mark.parametrize("small", [1 << 20, -1])
def test_without_topics_all_pass(spark, monkeypatch, small):
    monkeypatch.setattr(vectors, "SMALL", small)
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    row = vectors.topic_guardrail_by(df, "v", spark.createDataFrame([], "topic array<double>"), "topic").first()
    assert (row["score"], row["error"]) == (1.0, None)


def test_a_hundred_thousand_topics(spark):
    """Nothing is collected, and no block holds more than about its size."""
    rng = np.random.default_rng(2)
    topics, rows = rng.normal(size=(100_000, 16)), rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<double>")
    wide = spark.createDataFrame([(t.tolist(),) for t in topics], "topic array<double>")
    scored = vectors.topic_guardrail_by(df, "v", wide, "topic")
    plan = scored._jdf.queryExecution().toString()
    assert "Subquery" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (unit(rows) @ unit(topics).T).max(axis=1)
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert [got[i] for i in range(300)] == pytest.approx(want.tolist(), abs=1e-12)
