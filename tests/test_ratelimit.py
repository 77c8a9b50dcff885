import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.operators import ratelimit
from bulwark.sources import snapshots
from bulwark.streaming import jobs

WIDTH = 60_000


def brute(rows, limit):
    """Replay per caller in time order: (event_id -> (window_start, position, allowed))."""
    out, state = {}, {}
    for event_id, who, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start, count = state.get(who, (None, 0))
        if start is None or t >= start + WIDTH:
            start, count = t, 0
        count += 1
        state[who] = (start, count)
        out[event_id] = (start, count, count <= limit)
    return out


def log(spark, rows):
    return spark.createDataFrame(rows, "event_id long, identity string, arrival_ms long")


def replayed(spark, rows, limit, **options):
    df = ratelimit.replay_limits(log(spark, rows), limit=limit, **options)
    return {r.event_id: (r.window_start, r.position, r.allowed) for r in df.collect()}


@pytest.mark.parametrize("seed,span", [(1, 400_000), (2, 9_000_000), (3, 40_000_000)])
def test_replay_matches_brute_force(spark, seed, span):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.6 else f"c{rng.randrange(6)}", rng.randrange(span)) for i in range(3000)]
    rows += [(10_000 + i, "edge", i * WIDTH) for i in range(200)]
    rows += [(20_000 + i, "edge2", 3_599_999 + i * (WIDTH - 1)) for i in range(200)]
    assert replayed(spark, rows, 5) == brute(rows, 5)


def test_chunk_steps_agree_with_direct_chains():
    rng = np.random.default_rng(0)
    for _ in range(200):
        start = 3_600_000 * int(rng.integers(0, 3))
        times = np.unique(rng.integers(start, start + 3_600_000, int(rng.integers(1, 300))))
        upto, exits = ratelimit.chunk_exits(times, start, WIDTH)
        for entry in [ratelimit._NEVER, *rng.integers(start, start + WIDTH, 5)]:
            opened = ratelimit.chain_starts(times, int(entry), WIDTH)
            at = np.searchsorted(upto, entry, side="left")
            if len(opened):
                assert exits[at] == opened[-1] + WIDTH
            else:
                assert at == len(upto)


def test_fourth_of_three_is_rejected_and_callers_are_independent(spark):
    rows = [(i, "a", i) for i in range(4)] + [(10, "b", 2)]
    got = ratelimit.replay_limits(log(spark, rows), limit=3).collect()
    assert {r.event_id for r in got if not r.allowed} == {3}
    assert {r.event_id: r.retry_after_s for r in got}[3] == 60


def test_rejected_events_count_and_window_restarts_at_first_event(spark):
    rows = [(0, "a", 1000), (1, "a", 60_999), (2, "a", 61_000), (3, "a", 120_999), (4, "a", 121_000)]
    got = replayed(spark, rows, 1)
    assert [got[i] for i in range(5)] == [
        (1000, 1, True), (1000, 2, False), (61_000, 1, True), (61_000, 2, False), (121_000, 1, True),
    ]


def test_default_limit_and_disabled(spark):
    rows = [(i, "a", i) for i in range(61)]
    assert [e for e, v in replayed(spark, rows, ratelimit.DEFAULT_LIMIT).items() if not v[2]] == [60]
    off = ratelimit.replay_limits(log(spark, rows), limit=1, enabled=False)
    assert off.where("allowed").count() == 61


def test_caller_falls_back_to_address(spark):
    df = spark.createDataFrame([(7, "ip"), (None, "10.0.0.1"), (None, None)], "t long, ip string")
    assert [r.x for r in df.select(ratelimit.caller(F.col("t"), F.col("ip")).alias("x")).collect()] == ["7", "10.0.0.1", "unknown"]


def arrival_order(rows, limit):
    """Decisions of a live counter that takes events as they come; late ones join the open window."""
    out, state = {}, {}
    for event_id, who, t in rows:
        start, count = state.get(who, (None, 0))
        if start is None or t >= start + WIDTH:
            start, count = t, 0
        state[who] = (start, count + 1)
        out[event_id] = (start, count + 1, count < limit)
    return out


def test_stream_over_several_batches_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = 1_700_000_000_000
    times = sorted(base + rng.randrange(900_000) for _ in range(1500))
    rows = [(i, rng.randrange(3), t) for i, t in enumerate(times)]
    # The last caller is quiet for some batches, and one event of a later batch comes late.
    rows += [(5000, 9, base + 5), (5001, 9, base + 899_000)]
    schema = "event_id long, identity long, arrival_ms long"
    batches = [rows[b * 300 : (b + 1) * 300] for b in range(5)]
    batches[0].append(rows[1500])
    batches[4].append(rows[1501])
    late = (7000, batches[3][-1][1], batches[2][-1][2] + 1)
    batches.append([late])
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.rate_limits(source, str(tmp_path / "out"), str(tmp_path / "cp"), limit=20).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()
    want = arrival_order([r for b in batches for r in sorted(b, key=lambda r: (r[2], r[0]))], 20)
    assert {r.event_id: (r.window_start, r.position, r.allowed) for r in got} == want


def _limited(spark, batches, place, **options):
    schema = "event_id long, identity long, arrival_ms long"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(place / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
    jobs.rate_limits(source, str(place / "out"), str(place / "cp"), **options).awaitTermination()
    got = spark.read.parquet(str(place / "out" / "decisions")).collect()
    state = str(place / "out" / "state")
    last = snapshots.numbers(spark, state)[-1]
    return {r.event_id: (r.window_start, r.position, r.allowed) for r in got}, state, snapshots.load(spark, state, last)


def test_micro_batch_writes_state_of_its_own_callers(spark, tmp_path):
    """Two callers among 3,000 known: two rows of state, and the quiet callers' windows go on."""
    first = [(i, i, 1000 + i) for i in range(3000)]
    second = [(9000, 5, 5000), (9001, 6, 5001), (9002, 5, 5002)]
    third = [(9100, 2999, 9000), (9101, 5, 9001)]
    got, state, version = _limited(spark, [first, second, third], tmp_path, limit=2)
    rows = [spark.read.parquet(f"{state}/{f['name']}").count() for f in version["folders"]]
    assert rows == [3000, 2, 2]
    assert got[9002] == (1005, 3, False) and got[9100] == (3999, 2, True) and got[9101] == (1005, 4, False)
    assert got == arrival_order(first + second + third, 2)


def test_state_folds_and_forgets(spark, tmp_path):
    """Folders fold, and those of windows long over are deleted; decisions stay those of a live counter."""
    base = 1_700_000_000_000
    batches = [[(b * 10 + k, k % 3 if b != 4 else None, base + b * 9_000 + k) for k in range(4)] for b in range(12)]
    got, state, version = _limited(spark, batches, tmp_path, limit=5, lateness_ms=30_000)
    assert got == arrival_order([r for b in batches for r in b], 5)
    names = {f["name"] for f in version["folders"]}
    assert any(n.startswith("fold-") for n in names) and len(names) <= 8
    far = tmp_path / "far"
    batches = [[(b, b, base + b * 200_000)] for b in range(6)]
    got, state, version = _limited(spark, batches, far, limit=5, lateness_ms=30_000)
    assert [f["name"] for f in version["folders"]] == ["delta-000000000005"]
    kept = {p.name for p in (far / "out" / "state").iterdir() if p.name.startswith("delta-")}
    assert kept == {"delta-000000000004", "delta-000000000005"}


def test_repeated_micro_batch_decides_the_same(spark, tmp_path):
    """A batch that died after its state was committed is not counted twice."""
    parts = [[(1, 1, 1000), (2, 1, 2000)], [(3, 1, 3000)]]
    got, state, _ = _limited(spark, parts, tmp_path, limit=2)
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "cp" / name).unlink()
    source = spark.readStream.schema("event_id long, identity long, arrival_ms long").option("maxFilesPerTrigger", 1)
    jobs.rate_limits(source.parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), limit=2).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "out" / "decisions")).collect()
    assert {r.event_id: (r.window_start, r.position, r.allowed) for r in again} == got
    assert got[3] == (1000, 3, False)


def test_carried_window_goes_on(spark):
    carried = spark.createDataFrame([("a", 1000, 2)], "identity string, window_start long, count long")
    rows = [(0, "a", 500), (1, "a", 2000), (2, "a", 61_000), (3, "b", 61_000)]
    df = ratelimit.replay_limits(log(spark, rows), limit=3, carried=carried)
    got = {r.event_id: (r.window_start, r.position, r.allowed) for r in df.collect()}
    assert got == {0: (1000, 3, True), 1: (1000, 4, False), 2: (61_000, 1, True), 3: (61_000, 1, True)}
    state = {tuple(r) for r in ratelimit.last_windows(df, carried).collect()}
    assert state == {("a", 61_000, 1), ("b", 61_000, 1)}


def test_dense_caller_in_levels(spark, monkeypatch):
    """One event every few milliseconds over hours; step tables compose over several levels."""
    rng = random.Random(7)
    rows = [(i, "dense", t) for i, t in enumerate(sorted(rng.sample(range(0, 6 * 3_600_000), 12_000)))]
    rows += [(20_000 + i, "beat", i * 20_000) for i in range(1080)]
    sizes = []
    composed = ratelimit.compose

    def watched(tables):
        sizes.append(len(tables))
        return composed(tables)

    monkeypatch.setattr(ratelimit, "compose", watched)
    df = ratelimit.windows(log(spark, rows), "identity", "arrival_ms", chunk_ms=600_000, fan_in=3)
    got = {(r.identity, r.window_start) for r in df.collect()}
    assert got == {(w, s) for (_, w, _), (s, _, _) in zip(rows, map(brute(rows, 1).get, (r[0] for r in rows)))}


def test_composition_equals_chaining():
    rng = np.random.default_rng(1)
    for _ in range(200):
        tables = []
        for c in sorted(rng.choice(9, int(rng.integers(1, 6)), replace=False)):
            start = 3_600_000 * int(c)
            times = np.unique(rng.integers(start, start + 3_600_000, int(rng.integers(1, 40))))
            tables.append((int(c), *ratelimit.chunk_exits(times, start, WIDTH)))
        whole = (0, *ratelimit.compose(tables))
        after = (99, np.array([2**60]), np.array([2**60]))
        for entry in [ratelimit._NEVER, *(tables[0][0] * 3_600_000 + rng.integers(0, WIDTH, 8))]:
            direct, short = ratelimit.chain([*tables, after], int(entry))[-1], ratelimit.chain([whole, after], int(entry))[-1]
            assert direct == short


def test_unknown_callers_and_times(spark):
    rows = [(0, None, 1000), (1, None, 2000), (2, "a", None), (3, None, None), (4, "a", 1000)]
    got = replayed(spark, rows, 1)
    assert got == {0: (1000, 1, True), 1: (1000, 2, False), 2: (None, None, None), 3: (None, None, None), 4: (1000, 1, True)}
