import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.functions.significance import exact_p, normal_p, p_value
from bulwark.operators import distribution, runs, stats


def brute_u(current, baseline):
    return sum((c > b) + 0.5 * (c == b) for c in current for b in baseline)


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles in several partitions, so that totals cross partition borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_match_brute_force_on_a_dominant_key(spark, many_partitions):
    rng = random.Random(1)
    rows = [("hot", rng.random()) for _ in range(4000)] + [("hot", 0.5)] * 500
    rows += [("one", 0.25)] + [(None, 0.1), (None, 0.3)] + [(f"k{i}", i / 7) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.k: r for r in distribution.quantiles(df, ["k"], "v", probs).collect()}
    for key in {r[0] for r in rows}:
        data = [v for k, v in rows if k == key]
        assert got[key].n == len(data)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(data, p)), (key, name)


def test_percentile_goldens(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5)], "v double").withColumn("k", F.lit(1))
    row = distribution.quantiles(df, ["k"], "v", {"p0": 0, "p50": 0.5, "p100": 1}).collect()[0]
    assert (row.p0, round(row.p50, 9), row.p100) == (0.1, 0.3, 0.5)


def test_nearest_rank_of_one_to_hundred_is_96(spark):
    df = spark.range(1, 101).withColumn("k", F.lit("x"))
    assert distribution.nearest_ranks(df, ["k"], "id", {"p95": 0.95}).collect()[0].p95 == 96


@pytest.mark.parametrize("levels", [5, 40, 10**6])
def test_mann_whitney_matches_brute_force(spark, many_partitions, levels):
    rng = random.Random(levels)
    cur = [rng.randrange(levels) / levels for _ in range(60)]
    base = [rng.randrange(levels) / levels * 0.9 for _ in range(45)]
    rows = [("pii", "current", v) for v in cur] + [("pii", "baseline", v) for v in base]
    df = spark.createDataFrame(rows, "evaluator string, side string, score double")
    r = stats.two_samples(df, ["evaluator"], F.col("side") == "current").collect()[0]
    assert r.u == brute_u(cur, base)
    both = cur + base
    assert r.ties == sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    assert r.var_current == pytest.approx(statistics.variance(cur))
    assert r.var_baseline == pytest.approx(statistics.variance(base))


def test_exact_distribution_against_enumeration():
    from itertools import combinations

    n1, n2 = 5, 6
    counts = {}
    for chosen in combinations(range(n1 + n2), n1):
        u = sum(chosen) - n1 * (n1 - 1) // 2
        counts[u] = counts.get(u, 0) + 1
    total = sum(counts.values())
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(c for k, c in counts.items() if k >= top) / total)
        assert exact_p(u, n1, n2) == pytest.approx(want)


def test_p_value_branches():
    assert p_value(0.0, 5, 5, 0.0) == pytest.approx(2 / 252)
    assert p_value(12.5, 5, 5, 0.0) == 1.0
    assert p_value(50.0, 10, 10, 0.0) == pytest.approx(1.0, abs=0.03)
    # All values tie.
    assert normal_p(50.0, 10, 10, 20.0**3 - 20) == 1.0
    # Ties rule out the exact distribution.
    assert p_value(0.0, 5, 5, 6.0) == normal_p(0.0, 5, 5, 6.0)


def compared(spark, cur, base, evaluator="toxicity", flags=(0, 0)):
    rows = [(evaluator, "current", v, i < flags[0]) for i, v in enumerate(cur)]
    rows += [(evaluator, "baseline", v, i < flags[1]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "evaluator string, side string, score double, flag boolean")
    return {r.evaluator: r for r in stats.compare_runs(df).collect()}


def test_comparison_lists_all_evaluators(spark):
    table = compared(spark, [0.9] * 4 + [0.8] * 6, [0.1] * 5 + [0.2] * 5)
    assert len(table) == 7 and table["pii"].n_current == 0 and table["pii"].direction == "stable"
    t = table["toxicity"]
    assert t.mann_whitney_u == 100.0 and t.significant and t.direction == "regression" and t.effect_size == "large"


def test_quality_evaluator_improves_upwards(spark):
    cur, base = [0.8 + i / 100 for i in range(10)], [0.1 + i / 100 for i in range(10)]
    assert compared(spark, cur, base, "relevance")["relevance"].direction == "improvement"
    assert compared(spark, base, cur, "relevance")["relevance"].direction == "regression"


def test_small_sample_uses_flag_rates_with_inverted_sign_for_quality(spark):
    up = compared(spark, [0.5] * 4, [0.5] * 4, "toxicity", (2, 0))["toxicity"]
    assert (up.direction, up.p_value, up.mann_whitney_u, up.significant) == ("regression", 1.0, 0.0, False)
    assert up.flag_rate_delta == 0.5
    assert compared(spark, [0.5] * 4, [0.5] * 4, "relevance", (2, 0))["relevance"].direction == "improvement"
    assert compared(spark, [0.5] * 4, [0.5] * 4, "relevance", (0, 2))["relevance"].direction == "regression"


def test_constant_samples_have_no_effect(spark):
    t = compared(spark, [0.1] * 6, [0.1] * 6)["toxicity"]
    assert t.cohens_d == 0.0 and t.p_value == 1.0 and t.direction == "stable"


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.19,), (-0.2,), (0.5,), (-0.8,)], "d double")
    labels = [r.x for r in df.select(stats.effect_label(F.col("d")).alias("x")).collect()]
    assert labels == ["negligible", "small", "medium", "large"]


def test_scorecard_with_null_score(spark):
    df = spark.createDataFrame(
        [("r", "pii", 0.4, False), ("r", "pii", None, False), ("r", "toxicity", None, False)],
        "run_label string, evaluator string, score double, flag boolean",
    )
    card = {r.evaluator: r for r in runs.scorecard(df).collect()}
    assert len(card) == 7
    assert (card["pii"].n, card["pii"].n_scored, card["pii"].mean, card["pii"].p95) == (2, 1, 0.4, 0.4)
    assert card["toxicity"].mean is None and card["toxicity"].p50 is None and card["relevance"].flag_rate == 0.0


def test_scorecard_counts_errored_records(spark):
    df = spark.createDataFrame([("r", "pii", 0.9, True)], "run_label string, evaluator string, score double, flag boolean")
    n = spark.createDataFrame([("r", 4), ("empty", 0)], "run_label string, n long")
    card = {(r.run_label, r.evaluator): r for r in runs.scorecard(df, records=n).collect()}
    assert card["r", "pii"].flag_rate == 0.25 and card["empty", "pii"].flag_rate == 0.0


@pytest.mark.parametrize("delta,regressed", [(0.049, False), (0.051, True)])
def test_flag_rate_boundary(spark, delta, regressed):
    df = spark.createDataFrame([("pii", 0.02, 0.02 + delta)], "evaluator string, baseline_flag_rate double, current_flag_rate double")
    checked = runs.flag_rate_regression(df)
    assert checked.collect()[0].regressed is regressed
    assert runs.gate(checked).collect()[0].exit_code == (2 if regressed else 0)


def test_auc_and_quality(spark):
    rows = [(0.9, 1), (0.8, 1), (0.4, 1), (0.6, 0), (0.2, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, y int").withColumn("d", F.lit("x"))
    assert stats.auc(df, ["d"], F.col("y") == 1).collect()[0].auc == pytest.approx(8 / 9)
    q = stats.quality_at(df, ["d"], F.col("y") == 1, [0.5]).collect()[0]
    assert (q.tp, q.fp, q.fn, q.tn) == (2, 1, 1, 2)
    assert q.precision == pytest.approx(2 / 3) and q.accuracy == pytest.approx(4 / 6)


def test_exact_p_for_any_sizes():
    """Against counting all splits of the ranks, and against the large-sample value."""
    from itertools import combinations

    from bulwark.functions.significance import exact_p, normal_p, p_value

    for n1, n2 in ((5, 6), (3, 9), (8, 5), (1, 4)):
        sums = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            tail = sum(s >= max(u, n1 * n2 - u) for s in sums)
            assert abs(exact_p(u, n1, n2) - min(1.0, 2 * tail / len(sums))) < 1e-12
    large = p_value(0.1 * 5 * 900_000, 5, 900_000, 0)
    assert abs(large - 5.2e-4) < 5e-6 and abs(large - normal_p(0.1 * 5 * 900_000, 5, 900_000, 0)) > 1e-3
