from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS, configure, default_config
from bulwark.operators import chain, scoring

SCHEMA = "request_id long, evaluator string, score double, latency_ms int, error string, cached boolean"
ORDER = {e.name: e for e in EVALUATORS}


def calls(spark, rows):
    df = spark.createDataFrame([(*r, None, False)[:6] if len(r) == 4 else r for r in rows], SCHEMA)
    chain_of = F.create_map(*[x for e in EVALUATORS for x in (F.lit(e.name), F.lit(e.chain))])
    ord_of = F.create_map(*[x for e in EVALUATORS for x in (F.lit(e.name), F.lit(e.ord))])
    return df.withColumns({"chain": chain_of[F.col("evaluator")], "ord": ord_of[F.col("evaluator")]})


def kept(df):
    return {r.evaluator for r in df.collect()}


def test_threshold_is_inclusive_both_ways_and_null_never_flags(spark):
    df = calls(spark, [(1, "toxicity", 0.7, 1), (2, "toxicity", 0.69, 1), (3, "relevance", 0.3, 1),
                       (4, "relevance", 0.31, 1), (5, "toxicity", None, 1)])
    flags = {r.request_id: r.flag for r in chain.apply_thresholds(df).collect()}
    assert flags == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_disabled_evaluators_are_dropped(spark):
    df = calls(spark, [(1, "topic_guardrail", 0.1, 1), (1, "pii", 0.1, 1)])
    assert kept(chain.apply_thresholds(df, default_config())) == {"pii"}


def test_timeout_has_no_score_and_the_limit_as_latency(spark):
    row = chain.normalise_timeouts(calls(spark, [(1, "pii", 0.9, 3001)])).collect()[0]
    assert (row.score, row.latency_ms, row.error) == (None, 3000, "timeout")
    row = chain.normalise_timeouts(calls(spark, [(1, "pii", 0.9, 3000)])).collect()[0]
    assert (row.score, row.error) == (0.9, None)


def test_redaction_does_not_cancel_a_slower_sibling(spark):
    df = calls(spark, [(1, "pii", 0.9, 5), (1, "prompt_injection", 0.99, 50)])
    flagged = chain.apply_thresholds(df)
    raced = chain.input_race(flagged).collect()
    assert {r.evaluator for r in raced} == {"pii", "prompt_injection"}
    assert {r.blocked_by for r in raced} == {"prompt_injection"}
    wide = chain.assemble(chain.input_race(flagged)).collect()[0]
    # The log names the first flag to finish, the decision the real blocker.
    assert wide.blocked and wide.block_reason == "pii_detected" and wide.score_prompt_injection == 0.99
    decided = chain.decisions(chain.input_race(flagged)).collect()[0]
    assert (decided.decision, decided.code, decided.threshold) == ("blocked", "prompt_injection_detected", 0.8)


def test_blocking_pii_cancels_the_slower_sibling(spark):
    config = configure({"pii": {"action": "block"}})
    df = calls(spark, [(1, "pii", 0.9, 5), (1, "prompt_injection", 0.99, 50)])
    flagged = chain.apply_thresholds(df, config)
    assert kept(chain.input_race(flagged, config)) == {"pii"}
    decided = chain.decisions(chain.input_race(flagged, config), config).collect()[0]
    assert (decided.decision, decided.code, decided.blocker_score) == ("blocked", "pii_detected", 0.9)


def test_latency_ties_finish_in_catalogue_order(spark):
    config = configure({"pii": {"action": "block"}})
    df = calls(spark, [(1, "prompt_injection", 0.99, 5), (1, "pii", 0.9, 5)])
    assert kept(chain.input_race(chain.apply_thresholds(df, config), config)) == {"pii"}


def test_cached_blocker_keeps_cached_results_only(spark):
    df = calls(spark, [(1, "pii", 0.1, 9, None, True), (1, "prompt_injection", 0.9, 9, None, True),
                       (1, "topic_guardrail", 0.9, 1, None, False)])
    raced = chain.input_race(chain.apply_thresholds(df))
    assert kept(raced) == {"pii", "prompt_injection"}


def test_cached_results_after_a_blocker_stay(spark):
    df = calls(spark, [(1, "prompt_injection", 0.9, 9, None, True), (1, "topic_guardrail", 0.1, 9, None, True)])
    raced = chain.input_race(chain.apply_thresholds(df))
    assert kept(raced) == {"prompt_injection", "topic_guardrail"}
    assert raced.select("blocked_by").distinct().collect()[0][0] == "prompt_injection"


def test_output_flags_never_block(spark):
    df = calls(spark, [(1, "pii", 0.0, 1), (1, "toxicity", 0.99, 1), (1, "exfiltration", 1.0, 1)])
    replayed = chain.replay(df)
    wide = chain.assemble(replayed).collect()[0]
    assert not wide.blocked and wide.block_reason is None and wide.flag_toxicity
    assert chain.decisions(replayed).collect()[0].decision == "stripped"


def test_shadow_mode_reports_but_does_not_block(spark):
    df = calls(spark, [(1, "prompt_injection", 0.9, 1), (1, "toxicity", 0.1, 1)])
    assert kept(chain.replay(df)) == {"prompt_injection"}
    replayed = chain.replay(df, enforce=False)
    assert kept(replayed) == {"prompt_injection", "toxicity"}
    decided = chain.decisions(replayed, enforce=False).collect()[0]
    assert (decided.decision, decided.blocked_by) == ("passed", "prompt_injection")


def test_off_topic_has_its_own_code(spark):
    decided = chain.decisions(chain.replay(calls(spark, [(1, "topic_guardrail", 0.1, 1)]))).collect()[0]
    assert decided.code == "off_topic" and decided.status == 400


def test_missing_evaluators_are_null_and_unflagged(spark):
    wide = chain.assemble(chain.replay(calls(spark, [(1, "pii", 0.1, 4)]))).collect()[0]
    assert wide.score_relevance is None and wide.latency_relevance is None and not wide.flag_relevance
    assert (wide.score_pii, wide.latency_pii) == (0.1, 4)


def test_record_without_total_latency_stores_zero(spark):
    wide = chain.assemble(chain.replay(calls(spark, [(1, "pii", 0.1, 4)])))
    attributes = spark.createDataFrame([(1, "m", None)], "request_id long, model string, latency_total int")
    record = chain.request_records(wide, attributes).collect()[0]
    assert record.latency_total == 0 and record.reviewed is False and record.id == "1"


def test_new_scorer_adds_its_columns(spark):
    custom = scoring.Scorer("secrets", chain="output", threshold=0.5)
    config = scoring.catalogue_with(custom)
    df = spark.createDataFrame(
        [(1, "secrets", "output", 8, 0.6, 3, None)],
        "request_id long, evaluator string, chain string, ord int, score double, latency_ms int, error string",
    )
    wide = chain.assemble(chain.replay(df, config), [e.name for e in config]).collect()[0]
    assert wide.score_secrets == 0.6 and wide.flag_secrets
