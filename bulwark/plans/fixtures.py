"""Guardrail tables derived from the test tables, as DataFrames.

The test data holds no request log, so one is derived deterministically from ``events``;
the layout is described in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.catalog import EVALUATORS

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _hundredth(x: Column) -> Column:
    return x.cast("double") / F.lit(100.0)


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    scored = events.selectExpr(
        "event_id AS id",
        "ts AS created_at",
        "user_id % 4 AS tenant_id",
        "concat('model-', CAST(user_id % 3 AS STRING)) AS model",
        "event_id % 3 = 0 AS has_context",
        "CAST(floor(value) AS INT) + 5 AS latency_total",
        "event_id % 5 = 0 AS reviewed",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
    )
    inputs = scored.selectExpr(
        "*",
        "CASE WHEN id % 17 <> 0 THEN CAST((k * 7 + id) % 60 AS DOUBLE) / 100D END AS score_pii",
        "CASE WHEN id % 19 <> 0 THEN CAST((k * 13 + id) % 90 AS DOUBLE) / 100D END AS score_prompt_injection",
        "CAST(NULL AS DOUBLE) AS score_topic_guardrail",
        "CAST((k * 5 + id) % 100 AS DOUBLE) / 100D AS consistency",
    ).selectExpr(
        "*",
        "coalesce(score_pii >= 0.5D, false) AS flag_pii",
        "coalesce(score_prompt_injection >= 0.8D, false) AS flag_prompt_injection",
        "false AS flag_topic_guardrail",
    )
    answered = "NOT flag_prompt_injection"
    outputs = inputs.selectExpr(
        "*",
        "flag_pii OR flag_prompt_injection OR flag_topic_guardrail AS blocked",
        "CASE WHEN flag_pii THEN 'pii_detected' "
        "WHEN flag_prompt_injection THEN 'prompt_injection_detected' END AS block_reason",
        f"CASE WHEN {answered} THEN CAST((k * 3 + id) % 80 AS DOUBLE) / 100D END AS score_toxicity",
        f"CASE WHEN {answered} THEN CASE WHEN id % 23 = 0 THEN 1D ELSE 0D END END AS score_exfiltration",
        f"CASE WHEN {answered} THEN CAST((k * 11 + id) % 100 AS DOUBLE) / 100D END AS score_relevance",
        f"CASE WHEN {answered} AND has_context THEN 1D - consistency END AS score_hallucination",
        f"CASE WHEN {answered} AND has_context THEN consistency END AS score_faithfulness",
    )
    return outputs.selectExpr(
        "id", "created_at", "tenant_id", "model", "has_context", "blocked", "block_reason",
        *[f"score_{e.name}" for e in EVALUATORS],
        "flag_pii", "flag_prompt_injection", "flag_topic_guardrail",
        "coalesce(score_toxicity >= 0.7D, false) AS flag_toxicity",
        "coalesce(score_exfiltration >= 0.5D, false) AS flag_exfiltration",
        "coalesce(score_relevance <= 0.3D, false) AS flag_relevance",
        "coalesce(score_hallucination >= 0.5D, false) AS flag_hallucination",
        "coalesce(score_faithfulness <= 0.5D, false) AS flag_faithfulness",
        "latency_total", "reviewed",
    )


def eval_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request and evaluator: eight literal entries exploded, no join."""
    entries = ", ".join(
        f"named_struct('evaluator', '{e.name}', 'chain', '{e.chain}', 'ord', {e.ord})" for e in EVALUATORS
    )
    base = requests(spark, sf_dir).selectExpr("id AS request_id", "latency_total", f"inline(array({entries}))")
    return base.selectExpr(
        "request_id", "evaluator", "chain", "ord",
        "CASE WHEN (request_id + ord) % 89 <> 0 "
        "THEN CAST((request_id * (ord + 3) + latency_total * 7) % 101 AS DOUBLE) / 100D END AS score",
        "CASE WHEN (request_id + ord * 5) % 97 = 0 THEN 4000 "
        "ELSE CAST((request_id * 7 + ord * 31) % 120 + 1 AS INT) END AS latency_ms",
        "CASE WHEN (request_id + ord) % 89 = 0 THEN 'boom' END AS error",
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("request_id") % 2 == 0
    return eval_calls(spark, sf_dir).select(
        F.when(even, "baseline").otherwise("current").alias("run_label"),
        F.col("request_id").alias("record_index"),
        "evaluator",
        F.when(even, F.col("score")).otherwise(F.col("score") * F.col("score")).alias("score"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select("id", "tenant_id", "created_at")
    i = F.col("id")
    first = r.where(i % 5 == 0).select(
        (i * 2).alias("review_id"),
        i.alias("request_id"),
        "tenant_id",
        F.when(i % 3 == 0, "correct_flag")
        .when(i % 3 == 1, "false_positive")
        .otherwise("false_negative")
        .alias("label"),
        (F.col("created_at") + F.expr("INTERVAL '1' HOUR")).alias("reviewed_at"),
    )
    second = r.where(i % 10 == 0).select(
        (i * 2 + 1).alias("review_id"),
        i.alias("request_id"),
        "tenant_id",
        F.when(i % 20 == 0, "bad_label").otherwise("false_positive").alias("label"),
        (F.col("created_at") + F.expr("INTERVAL '2' HOUR")).alias("reviewed_at"),
    )
    return first.unionByName(second)


def tenants(spark: SparkSession) -> DataFrame:
    rows = [(i, f"tenant-{i}", i == 0) for i in range(4)]
    return spark.createDataFrame(rows, "tenant_id long, slug string, is_default boolean")


def api_keys(spark: SparkSession) -> DataFrame:
    """Hashes of the plaintext keys h0..h4; h4 was revoked in mid-January."""
    rows = [("h0", 0, None), ("h1", 1, None), ("h2", 2, None), ("h3", 3, None), ("h4", 0, "2024-01-15 00:00:00")]
    return spark.createDataFrame(rows, "api_key string, tenant_id long, revoked_at string").select(
        F.sha2("api_key", 256).alias("key_hash"),
        F.col("api_key").alias("key_prefix"),
        "tenant_id",
        F.col("revoked_at").cast("timestamp_ntz").alias("revoked_at"),
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_projection(table(spark, sf_dir, "events"))


def http_projection(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return events.select(
        "event_id",
        F.concat(F.lit("h"), (F.col("user_id") % 6).cast("string")).alias("api_key"),
        (F.col("user_id") % 4).alias("identity"),
        (i * 400 + (_k() * 37) % 400 + F.floor(i / 1000).cast("bigint") * 120000).alias("arrival_ms"),
        "ts",
    )


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_projection(table(spark, sf_dir, "events"))


def health_projection(events: DataFrame) -> DataFrame:
    return events.select(
        "ts",
        F.when(F.col("event_type") == "click", "llm_call")
        .when(F.col("event_type") == "error", "evaluator")
        .otherwise("request")
        .alias("kind"),
        (F.col("value") > 400).alias("blocked"),
        (F.col("value") > 450).alias("errored"),
        F.floor("value").cast("int").alias("latency_ms"),
    )


def outputs_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an image tag appended to its whole text."""
    m = F.col("doc_id") % 6
    tag = (
        F.when(m == 0, " ![a](https://evil.example.com/x?d=1)")
        .when(m == 1, " ![b](data:image/png;base64,AAAA)")
        .when(m == 2, " ![c](/rel.png)")
        .when(m == 3, ' ![d](https://CDN.example.com:8443/l.png "t")')
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", tag).alias("output_text")
    )


def doc_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scored context documents per request that has context."""
    r = requests(spark, sf_dir).where("has_context").select("id")
    pos = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos")
    return r.select(F.col("id").alias("request_id"), pos).select(
        "request_id", "pos", _hundredth((F.col("request_id") * (F.col("pos") + 1) * 13) % 101).alias("consistency")
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nightly run per tenant, model and day of the log, with a state and a baseline label."""
    day = F.date_trunc("day", F.col("created_at")).cast("timestamp_ntz")
    grouped = (
        requests(spark, sf_dir)
        .groupBy("tenant_id", "model", day.alias("day"))
        .agg(F.count("*").alias("record_count"), F.min("created_at").alias("created_at"))
    )

    def label(d: Column) -> Column:
        return F.concat(F.col("model"), F.lit("/"), F.date_format(d, "yyyy-MM-dd"))

    n = F.col("record_count")
    return grouped.select(
        F.concat_ws("/", F.col("tenant_id").cast("string"), label(F.col("day"))).alias("run_id"),
        "tenant_id",
        label(F.col("day")).alias("label"),
        label(F.col("day") - F.expr("INTERVAL '1' DAY")).alias("baseline_label"),
        F.when(n % 7 == 0, "failed").when(n % 11 == 0, "running").otherwise("complete").alias("status"),
        "record_count",
        "created_at",
    )
