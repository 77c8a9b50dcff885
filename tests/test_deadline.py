"""Models that hang, die or fail in their own process."""

import os
import time

import pytest

from bulwark.operators import deadline, scoring
from bulwark.operators.scoring import Scorer


def _moody(model, texts):
    for t in texts:
        if t == "hang":
            while True:
                pass
        if t == "sleep":
            time.sleep(600)
        if t == "die":
            os._exit(3)
        if t == "raise":
            raise ValueError("no")
        if t == "short":
            return []
    return [float(len(t)) for t in texts]


def _no_load():
    raise OSError("no weights")


@pytest.fixture
def child():
    held = deadline.Supervised(None, _moody)
    yield held
    held.end()


@pytest.mark.parametrize("together", [1, 3, 10])
def test_only_the_bad_rows_are_lost(child, together):
    texts = ["a", "hang", "bb", "die", "raise", "ccc", "sleep", "short", "dddd"]
    scores, errors, latencies = child.rows([texts], 0.2, together)
    assert scores == [1.0, None, 2.0, None, None, 3.0, None, None, 4.0]
    assert errors == [None, "timeout", None, deadline.DIED, "no", None, "timeout", "0 scores for 1 rows", None]
    assert latencies[1] == latencies[6] == 200 and max(latencies[i] for i in (0, 2, 5, 8)) < 200


def test_a_hanging_row_costs_one_deadline(child):
    child.rows([["warm"]], 5)
    began = time.monotonic()
    scores, _, _ = child.rows([["a"] * 50 + ["hang"] + ["b"] * 50], 0.5)
    assert scores.count(1.0) == 100 and 0.5 <= time.monotonic() - began < 1.5
    assert child.started == 2


def test_the_child_is_gone_after_its_deadline(child):
    child.ask([["a"]], 5)
    pid = child.child.pid
    assert child.ask([["hang"]], 0.1)[1] == "timeout"
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_model_is_loaded_once_per_child():
    held = deadline.Supervised(lambda: [0], lambda model, texts: [model.append(1) or len(model) for _ in texts])
    assert held.rows([["x", "y", "z"]], 5)[0] == [2, 3, 4]
    held.end()


def test_model_that_does_not_load():
    with pytest.raises(deadline.NotLoaded, match="no weights"):
        deadline.Supervised(_no_load, _moody).ask([["a"]], 1)


def test_scorer_with_deadline(spark):
    rows = [(i, t) for i, t in enumerate(["a", "hang", "bb", "die", "raise", "hang", None, "ccc"])]
    df = spark.createDataFrame(rows, "id long, text string").fillna("")
    scorer = Scorer("moody", ("text",), score_batch=_moody, timeout_ms=300, rows_per_call=4)
    got = {r["id"]: (r["score"], r["error"]) for r in scoring.score(df, scorer).collect()}
    assert got == {
        0: (1.0, None), 1: (None, "timeout"), 2: (2.0, None), 3: (None, deadline.DIED), 4: (None, "no"),
        5: (None, "timeout"), 6: (0.0, None), 7: (3.0, None),
    }
    latencies = {r["id"]: r["latency_ms"] for r in scoring.score(df, scorer).collect()}
    assert latencies[1] == latencies[5] == 300


def test_scorer_with_deadline_that_does_not_load(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    scorer = Scorer("unloaded", ("text",), load=_no_load, score_batch=_moody, timeout_ms=300)
    assert {(r["score"], r["error"]) for r in scoring.score(df, scorer).collect()} == {(None, "model not loaded: no weights")}
