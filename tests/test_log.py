from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.operators import cache, history, metrics, tenancy
from bulwark.plans import fixtures as fx


def requests(spark, rows):
    """rows: (id, tenant, created_at, flags, blocked, latency, reviewed)"""
    df = spark.createDataFrame(
        rows, "id long, tenant_id long, created_at timestamp, f array<string>, blocked boolean, latency_total int, reviewed boolean"
    )
    scores = {f"score_{n}": F.lit(None).cast("double") for n in NAMES}
    flags = {f"flag_{n}": F.array_contains("f", n) for n in NAMES}
    return df.withColumns({**scores, **flags, "model": F.lit("m"), "has_context": F.lit(False), "block_reason": F.lit(None).cast("string")}).drop("f")


NOW = datetime(2024, 1, 2)
ROWS = [
    (1, 1, datetime(2024, 1, 1, 5, 59), ["pii"], True, 10, False),
    (2, 1, datetime(2024, 1, 1, 5, 30), ["toxicity"], False, 21, True),
    (3, 1, datetime(2024, 1, 1, 0, 0), ["toxicity", "pii"], False, 30, False),
    (4, 1, datetime(2023, 12, 31, 23, 59), ["relevance"], True, 99, False),
    (5, 2, datetime(2024, 1, 1, 1, 0), [], False, 1, False),
]


def test_summary_window_is_inclusive_and_rounds_half_up(spark):
    s = metrics.summary(requests(spark, ROWS), NOW, tenant_id=1).collect()[0]
    assert (s.total_requests_24h, s.blocked_requests_24h, s.unreviewed_flags, s.avg_latency_24h_ms) == (3, 1, 2, 20)
    empty = metrics.summary(requests(spark, ROWS), NOW, tenant_id=9).collect()[0]
    assert (empty.total_requests_24h, empty.block_rate_24h, empty.avg_latency_24h_ms) == (0, 0.0, 0)


def test_top_flag_breaks_ties_by_catalogue_order(spark):
    top = {r.tenant_id: r.top_flag_reason for r in metrics.top_flag(requests(spark, ROWS), NOW).collect()}
    assert top == {1: "pii", 2: None}


def test_unknown_window_and_bucket_fall_back(spark):
    df = requests(spark, ROWS)
    odd = metrics.time_buckets(df, NOW, "2y", "3s").orderBy("tenant_id", "bucket_start").collect()
    usual = metrics.time_buckets(df, NOW, "24h", "1h").orderBy("tenant_id", "bucket_start").collect()
    assert odd == usual and len(usual) == 3


@pytest.mark.parametrize("bucket,n", [("5m", 3), ("1h", 2), ("6h", 2), ("1d", 1)])
def test_bucket_truncation(spark, bucket, n):
    assert metrics.time_buckets(requests(spark, ROWS), NOW, "24h", bucket, tenant_id=1).count() == n


def test_exact_buckets(spark):
    df = metrics.time_buckets(requests(spark, ROWS), NOW, "24h", "6h", tenant_id=1, exact_buckets=True)
    assert [r.request_count for r in df.collect()] == [3]


def test_approximate_percentile_is_close(spark):
    rows = [(i, 1, datetime(2024, 1, 1, 5), [], False, (i * 7919) % 10_000, False) for i in range(10_000)]
    df = requests(spark, rows)
    exact = metrics.time_buckets(df, NOW).collect()[0].p95_latency_total
    approx = metrics.time_buckets(df, NOW, approx=True).collect()[0].p95_latency_total
    assert exact == 9499 and abs(exact - approx) <= 2


def test_flag_rate_series_without_buckets_is_zero(spark):
    none = metrics.time_buckets(requests(spark, ROWS), NOW, "24h", tenant_id=9)
    rows = metrics.flag_rate_series(none).collect()
    assert len(rows) == 7 and {r.rate_pct for r in rows} == {0.0}


def test_history_filters(spark):
    df = requests(spark, ROWS)

    def ids(**kw):
        return {r.id for r in history.score_history(df, 1, **kw).collect()}

    assert ids(start=datetime(2024, 1, 1), end=datetime(2024, 1, 1, 5, 30)) == {2, 3}
    assert ids(evaluator="pii") == {1, 3} and ids(evaluator="no such") == {1, 2, 3, 4}
    assert {r.id for r in history.score_history(df, 2, flagged_only=True).collect()} == set()


def test_lookup_is_tenant_scoped(spark):
    df = requests(spark, ROWS)
    assert history.by_id(df, 5, 2).count() == 1 and history.by_id(df, 5, 1).count() == 0


def test_review_queue_order_and_bounds(spark):
    df = requests(spark, ROWS)
    assert [r.id for r in history.review_queue(df, 1).collect()] == [4, 3, 1]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            history.review_queue(df, 1, bad)


def test_flagged_view_has_25_columns(spark):
    view = history.flagged_view(requests(spark, ROWS))
    assert len(view.columns) == 25 and {r.id for r in view.collect()} == {1, 2, 3, 4}


def test_pages_meet_without_overlap(spark):
    df = requests(spark, ROWS)
    first = history.page(df, 1, 2).collect()
    assert [r.id for r in first] == [1, 2]
    second = [r.id for r in history.page(df, 2, 2).collect()]
    assert second == [5, 3]
    last = first[-1]
    assert [r.id for r in history.page_after(df, last.created_at, last.id, 2).collect()] == second
    with pytest.raises(ValueError):
        history.page(df, 0, 10)


def test_latest_review_wins_within_its_tenant(spark):
    df = requests(spark, ROWS)
    reviews = spark.createDataFrame(
        [(1, 1, 1, "correct_flag", datetime(2024, 1, 3), "n1"), (2, 1, 1, "false_positive", datetime(2024, 1, 4), "n2"),
         (3, 1, 1, "bogus", datetime(2024, 1, 5), "n3"), (4, 3, 2, "correct_flag", datetime(2024, 1, 3), "x")],
        "review_id long, request_id long, tenant_id long, label string, reviewed_at timestamp, note string",
    )
    got = {r.id: (r.reviewed, r.review_label, r.reviewer_note) for r in history.apply_reviews(df, reviews).collect()}
    assert got[1] == (True, "false_positive", "n2") and got[2] == (True, None, None)
    assert got[3] == (False, None, None)


def test_newest_keeps_n_per_tenant(spark):
    rows = history.newest(requests(spark, ROWS), 2).collect()
    assert {(r.tenant_id, r.id) for r in rows} == {(1, 1), (1, 2), (2, 5)}


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("e", 5), ("e", 6), ("e", 6000), ("e", None)], "evaluator string, latency_ms int")
    rows = {r.le: r for r in metrics.latency_histogram(df, ["evaluator"]).collect()}
    assert (rows["0.005"].cumulative, rows["0.01"].cumulative, rows["5.0"].cumulative, rows["+Inf"].cumulative) == (1, 2, 2, 3)
    assert rows["+Inf"].sum_seconds == pytest.approx(6.011)


def test_write_back_renews_alive_keys_and_drops_lapsed_ones(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    stored = spark.createDataFrame(
        [(1, "alive", "pii", 0.1, "m", t(1), t(2)), (1, "alive", "prompt_injection", 0.2, "m", t(1), t(2)),
         (1, "lapsed", "pii", 0.3, "m", t(0), t(1)), (1, "quiet", "pii", 0.4, "m", t(0), t(1))],
        "tenant_id long, cache_key string, evaluator string, score double, metadata string, written_at timestamp, expires_at timestamp",
    )
    fresh = spark.createDataFrame(
        [(1, "alive", "pii", 0.9, "n", t(1, 30), None), (1, "lapsed", "prompt_injection", 0.8, "n", t(1, 30), None),
         (1, "quiet", "pii", None, "n", t(1, 30), None), (1, "new", "pii", 0.7, "n", t(1, 30), "boom")],
        "tenant_id long, cache_key string, evaluator string, score double, metadata string, written_at timestamp, error string",
    )
    got = {(r.cache_key, r.evaluator): (r.score, r.expires_at) for r in cache.write_back(stored, fresh).collect()}
    assert got == {
        ("alive", "pii"): (0.9, t(2, 30)), ("alive", "prompt_injection"): (0.2, t(2, 30)),
        ("lapsed", "prompt_injection"): (0.8, t(2, 30)), ("quiet", "pii"): (0.4, t(1)),
    }


def test_tenant_policies(spark):
    log = spark.createDataFrame(
        [("h1", datetime(2024, 1, 1)), ("h4", datetime(2024, 1, 1)), ("h4", datetime(2024, 1, 20)), ("zz", datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), ("mk", datetime(2024, 1, 1))],
        "api_key string, ts timestamp",
    )

    def status(**kw):
        resolved = tenancy.resolve_tenants(log, fx.api_keys(spark), fx.tenants(spark), **kw)
        return {(r.api_key, r.ts.day): (r.tenant_id, r.auth_status) for r in resolved.collect()}

    closed = status(master_key="mk")
    assert closed[("h1", 1)] == (1, "resolved") and closed[("h4", 1)] == (0, "resolved")
    assert closed[("h4", 20)] == (None, "rejected") == closed[("zz", 1)] == closed[(None, 1)]
    assert closed[("mk", 1)] == (0, "master")
    open_ = status(auth_required=False)
    assert open_[("zz", 1)] == (0, "default") == open_[(None, 1)] and open_[("h1", 1)] == (1, "resolved")


def test_insert_if_absent(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in tenancy.insert_if_absent(table, rows, "k").collect()} == {("a", 1), ("b", 3)}


def test_insert_if_absent_keeps_one_row_per_key(spark):
    from bulwark.operators.tenancy import insert_if_absent

    table = spark.createDataFrame([("a", 1)], "slug string, n int")
    rows = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5), (None, 5)], "slug string, n int")
    got = sorted(((r.slug, r.n) for r in insert_if_absent(table, rows, "slug").collect()), key=str)
    assert got == [("a", 1), ("b", 3), (None, 5), (None, 5)] or got == sorted([("a", 1), ("b", 3), (None, 5), (None, 5)], key=str)


def test_absent_columns_have_the_logs_types(spark):
    from bulwark.operators.history import FLAGGED_VIEW_COLUMNS, flagged_view
    from bulwark.schemas import REQUESTS

    log = spark.createDataFrame([("1", True)], "id string, blocked boolean")
    from bulwark.catalog import NAMES

    log = log.withColumns({f"flag_{n}": F.lit(False) for n in NAMES})
    kinds = dict(flagged_view(log).dtypes)
    want = {f.name: f.dataType.simpleString() for f in REQUESTS.fields}
    assert all(kinds[c] == want[c] for c in FLAGGED_VIEW_COLUMNS)
