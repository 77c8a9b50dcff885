"""The derived tables as DuckDB SQL, and helpers to compose oracle queries."""

from __future__ import annotations

from bulwark.operators.detectors.pii import PATTERNS, Pattern

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {}

TABLES["requests"] = ((), """
  WITH e AS (
    SELECT event_id, ts, user_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
  ), s AS (
    SELECT event_id AS id, ts AS created_at, user_id % 4 AS tenant_id,
           concat('model-', CAST(user_id % 3 AS VARCHAR)) AS model,
           event_id % 3 = 0 AS has_context,
           CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((k * 7 + event_id) % 60 AS DOUBLE) / 100 END AS score_pii,
           CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST((k * 13 + event_id) % 90 AS DOUBLE) / 100 END AS score_prompt_injection,
           CAST(NULL AS DOUBLE) AS score_topic_guardrail,
           CAST((k * 3 + event_id) % 80 AS DOUBLE) / 100 AS raw_toxicity,
           CASE WHEN event_id % 23 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS raw_exfiltration,
           CAST((k * 11 + event_id) % 100 AS DOUBLE) / 100 AS raw_relevance,
           CAST((k * 5 + event_id) % 100 AS DOUBLE) / 100 AS raw_consistency,
           CAST(floor(value) AS INT) + 5 AS latency_total,
           event_id % 5 = 0 AS reviewed
    FROM e
  ), f AS (
    SELECT *, coalesce(score_pii >= 0.5, false) AS flag_pii,
           coalesce(score_prompt_injection >= 0.8, false) AS flag_prompt_injection,
           false AS flag_topic_guardrail
    FROM s
  ), b AS (
    SELECT *, (flag_pii OR flag_prompt_injection OR flag_topic_guardrail) AS blocked,
           CASE WHEN flag_pii THEN 'pii_detected'
                WHEN flag_prompt_injection THEN 'prompt_injection_detected' END AS block_reason,
           NOT flag_prompt_injection AS answered
    FROM f
  ), o AS (
    SELECT *, CASE WHEN answered THEN raw_toxicity END AS score_toxicity,
           CASE WHEN answered THEN raw_exfiltration END AS score_exfiltration,
           CASE WHEN answered THEN raw_relevance END AS score_relevance,
           CASE WHEN answered AND has_context THEN 1 - raw_consistency END AS score_hallucination,
           CASE WHEN answered AND has_context THEN raw_consistency END AS score_faithfulness
    FROM b
  )
  SELECT id, created_at, tenant_id, model, has_context, blocked, block_reason,
    score_pii, score_prompt_injection, score_topic_guardrail, score_toxicity, score_exfiltration,
    score_relevance, score_hallucination, score_faithfulness,
    flag_pii, flag_prompt_injection, flag_topic_guardrail,
    coalesce(score_toxicity >= 0.7, false) AS flag_toxicity,
    coalesce(score_exfiltration >= 0.5, false) AS flag_exfiltration,
    coalesce(score_relevance <= 0.3, false) AS flag_relevance,
    coalesce(score_hallucination >= 0.5, false) AS flag_hallucination,
    coalesce(score_faithfulness <= 0.5, false) AS flag_faithfulness,
    latency_total, reviewed
  FROM o""")  # fmt: skip

TABLES["evaluator_config"] = ((), """
  SELECT ord, evaluator, chain, direction, CAST(threshold AS DOUBLE) AS threshold, action
  FROM (VALUES
    (0, 'pii', 'input', 'above', 0.5, 'redact'),
    (1, 'prompt_injection', 'input', 'above', 0.8, 'block'),
    (2, 'topic_guardrail', 'input', 'below', 0.3, 'block'),
    (3, 'toxicity', 'output', 'above', 0.7, 'flag'),
    (4, 'exfiltration', 'output', 'above', 0.5, 'strip'),
    (5, 'relevance', 'output', 'below', 0.3, 'flag'),
    (6, 'hallucination', 'output', 'above', 0.5, 'flag'),
    (7, 'faithfulness', 'output', 'below', 0.5, 'flag')
  ) AS t(ord, evaluator, chain, direction, threshold, action)""")  # fmt: skip

TABLES["eval_calls"] = (("requests", "evaluator_config"), """
  SELECT r.id AS request_id, c.evaluator, c.chain, c.ord,
         CASE WHEN (r.id + c.ord) % 89 = 0 THEN NULL
              ELSE CAST((r.id * (c.ord + 3) + r.latency_total * 7) % 101 AS DOUBLE) / 100 END AS score,
         CASE WHEN (r.id + c.ord * 5) % 97 = 0 THEN CAST(4000 AS INT)
              ELSE CAST((r.id * 7 + c.ord * 31) % 120 + 1 AS INT) END AS latency_ms,
         CASE WHEN (r.id + c.ord) % 89 = 0 THEN 'boom' END AS error
  FROM requests r CROSS JOIN evaluator_config c""")  # fmt: skip

TABLES["normalised"] = (("eval_calls",), """
  SELECT request_id, evaluator, chain, ord,
         CASE WHEN latency_ms > 3000 OR error IS NOT NULL THEN NULL ELSE score END AS score,
         CASE WHEN latency_ms > 3000 THEN 3000 ELSE latency_ms END AS latency_ms,
         CASE WHEN latency_ms > 3000 THEN 'timeout' ELSE error END AS error
  FROM eval_calls""")  # fmt: skip

TABLES["flagged_calls"] = (("normalised", "evaluator_config"), """
  SELECT n.*, c.direction, c.threshold, c.action,
         coalesce(CASE WHEN c.direction = 'above' THEN n.score >= c.threshold
                       ELSE n.score <= c.threshold END, false) AS flag
  FROM normalised n JOIN evaluator_config c USING (evaluator)""")  # fmt: skip

# First blocker per request by (latency, ord) without cached results.
TABLES["blockers"] = (("flagged_calls",), """
  SELECT request_id, evaluator AS blocked_by, score AS blocker_score, latency_ms AS stop_ms, ord AS stop_ord
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY latency_ms, ord) AS rn
        FROM flagged_calls
        WHERE chain = 'input' AND flag AND NOT (evaluator = 'pii' AND action = 'redact')) q
  WHERE rn = 1""")  # fmt: skip

TABLES["replayed"] = (("flagged_calls", "blockers"), """
  SELECT c.*, b.blocked_by, b.blocker_score
  FROM flagged_calls c LEFT JOIN blockers b USING (request_id)
  WHERE b.blocked_by IS NULL
     OR (c.chain = 'input' AND (c.latency_ms < b.stop_ms OR (c.latency_ms = b.stop_ms AND c.ord <= b.stop_ord)))
""")  # fmt: skip

TABLES["run_scores"] = (("eval_calls",), """
  SELECT CASE WHEN request_id % 2 = 0 THEN 'baseline' ELSE 'current' END AS run_label,
         request_id AS record_index, evaluator,
         CASE WHEN request_id % 2 = 0 THEN score ELSE score * score END AS score
  FROM eval_calls""")  # fmt: skip

TABLES["run_flags"] = (("run_scores", "evaluator_config"), """
  SELECT r.run_label, r.record_index, r.evaluator, r.score, c.direction,
         coalesce(CASE WHEN c.direction = 'above' THEN r.score >= c.threshold
                       ELSE r.score <= c.threshold END, false) AS flag
  FROM run_scores r JOIN evaluator_config c USING (evaluator)
  WHERE r.evaluator <> 'exfiltration'""")  # fmt: skip

TABLES["scorecard"] = (("run_flags",), """
  SELECT run_label, evaluator, avg(score) AS mean, quantile_cont(score, 0.5) AS p50,
         quantile_cont(score, 0.95) AS p95,
         count(*) FILTER (WHERE flag) * CAST(1 AS DOUBLE) / count(*) AS flag_rate,
         count(*) FILTER (WHERE flag) AS flag_count, count(*) AS n, count(score) AS n_scored
  FROM run_flags GROUP BY run_label, evaluator""")  # fmt: skip

TABLES["reviews"] = (("requests",), """
  SELECT id * 2 AS review_id, id AS request_id, tenant_id,
         CASE WHEN id % 3 = 0 THEN 'correct_flag' WHEN id % 3 = 1 THEN 'false_positive' ELSE 'false_negative' END AS label,
         created_at + INTERVAL '1' HOUR AS reviewed_at
  FROM requests WHERE id % 5 = 0
  UNION ALL
  SELECT id * 2 + 1, id, tenant_id, CASE WHEN id % 20 = 0 THEN 'bad_label' ELSE 'false_positive' END,
         created_at + INTERVAL '2' HOUR
  FROM requests WHERE id % 10 = 0""")  # fmt: skip

TABLES["tenants"] = ((), """
  SELECT CAST(i AS BIGINT) AS tenant_id, concat('tenant-', i) AS slug, i = 0 AS is_default FROM range(4) t(i)""")

TABLES["api_keys"] = ((), """
  SELECT sha256(k) AS key_hash, k AS key_prefix, CAST(t AS BIGINT) AS tenant_id, CAST(r AS TIMESTAMP) AS revoked_at
  FROM (VALUES ('h0', 0, NULL), ('h1', 1, NULL), ('h2', 2, NULL), ('h3', 3, NULL),
               ('h4', 0, '2024-01-15 00:00:00')) AS v(k, t, r)""")  # fmt: skip

TABLES["http_log"] = ((), """
  SELECT event_id, concat('h', CAST(user_id % 6 AS VARCHAR)) AS api_key, user_id % 4 AS identity,
         event_id * 400 + (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 37) % 400
           + CAST(floor(event_id / 1000) AS BIGINT) * 120000 AS arrival_ms, ts
  FROM events""")  # fmt: skip

TABLES["health_events"] = ((), """
  SELECT ts, CASE WHEN event_type = 'click' THEN 'llm_call' WHEN event_type = 'error' THEN 'evaluator' ELSE 'request' END AS kind,
         value > 400 AS blocked, value > 450 AS errored, CAST(floor(value) AS INT) AS latency_ms
  FROM events""")  # fmt: skip

TABLES["outputs_with_images"] = ((), """
  SELECT doc_id, concat(text, CASE
    WHEN doc_id % 6 = 0 THEN ' ![a](https://evil.example.com/x?d=1)'
    WHEN doc_id % 6 = 1 THEN ' ![b](data:image/png;base64,AAAA)'
    WHEN doc_id % 6 = 2 THEN ' ![c](/rel.png)'
    WHEN doc_id % 6 = 3 THEN ' ![d](https://CDN.example.com:8443/l.png "t")'
    ELSE '' END) AS output_text
  FROM documents""")  # fmt: skip

TABLES["doc_consistency"] = (("requests",), """
  SELECT r.id AS request_id, p.pos, CAST((r.id * (p.pos + 1) * 13) % 101 AS DOUBLE) / 100 AS consistency
  FROM requests r CROSS JOIN (VALUES (0), (1), (2)) AS p(pos)
  WHERE r.has_context""")  # fmt: skip

TABLES["pairs"] = ((), """
  SELECT conv_id, turn, text AS input_text, CASE WHEN next_role = 'assistant' THEN next_text END AS output_text
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) q
  WHERE role = 'user'""")  # fmt: skip

TABLES["eval_runs"] = (("requests",), """
  SELECT concat_ws('/', CAST(tenant_id AS VARCHAR), model, strftime(day, '%Y-%m-%d')) AS run_id, tenant_id,
         concat(model, '/', strftime(day, '%Y-%m-%d')) AS label,
         concat(model, '/', strftime(day - INTERVAL '1' DAY, '%Y-%m-%d')) AS baseline_label,
         CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 11 = 0 THEN 'running' ELSE 'complete' END AS status,
         n AS record_count, created_at
  FROM (SELECT tenant_id, model, date_trunc('day', created_at) AS day, count(*) AS n, min(created_at) AS created_at
        FROM requests GROUP BY ALL) q""")  # fmt: skip


def cte(uses: tuple[str, ...]) -> str:
    """A WITH clause of the named derived tables and what they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in TABLES[name][0]:
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in ordered) + "\n"


def regex_sql(p: Pattern) -> str:
    edge = ("\\b" if p.lead else "", "\\b" if p.trail else "")
    return f"{edge[0]}(?:{p.body}){edge[1]}".replace("'", "''")


def verified_sql(m: str, p: Pattern) -> str:
    """Whether a match passes its type's check."""
    if p.check == "luhn":
        d = f"regexp_replace({m}, '[ -]', '', 'g')"
        double = f"2 * CAST(substr({d}, CAST(length({d}) - i AS BIGINT), 1) AS INT)"
        single = f"CAST(substr({d}, CAST(length({d}) - i AS BIGINT), 1) AS INT)"
        return (
            f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {single} "
            f"WHEN {double} > 9 THEN {double} - 9 ELSE {double} END)) % 10 = 0"
        )
    if p.check == "iban":
        moved = f"concat(substr({m}, 5), substr({m}, 1, 4))"
        values = (
            f"list_transform(string_split({moved}, ''), lambda c: "
            "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
        )
        return (
            f"list_reduce(list_concat([0], {values}), "
            "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
        )
    if p.check == "medical":

        def digit(i: int) -> str:
            return f"CAST(substr({m}, {i + 2}, 1) AS INT)"

        odd = " + ".join(digit(i) for i in (1, 3, 5))
        even = " + ".join(digit(i) for i in (2, 4, 6))
        return f"({odd} + 2 * ({even})) % 10 = {digit(7)}"
    return "true"


def matches_sql(text: str, p: Pattern) -> str:
    found = f"regexp_extract_all({text}, '{regex_sql(p)}')"
    return found if p.check is None else f"list_filter({found}, lambda m: {verified_sql('m', p)})"


def redacted_sql(text: str, threshold: float = 0.5) -> str:
    """Nested replacement of every type, checked ones match by match."""
    out = text
    for p in PATTERNS:
        if p.confidence < threshold:
            continue
        if p.check is None:
            out = f"regexp_replace({out}, '{regex_sql(p)}', '<{p.type}>', 'g')"
        else:
            out = (
                f"array_to_string(list_transform(list_zip(regexp_split_to_array({out}, '{regex_sql(p)}'), "
                f"regexp_extract_all({out}, '{regex_sql(p)}')), lambda z: concat(z[1], "
                f"CASE WHEN z[2] IS NULL THEN '' WHEN {verified_sql('z[2]', p)} THEN '<{p.type}>' ELSE z[2] END)), '')"
            )
    return out
