"""Queries over conversations, documents and embeddings: messages, detectors, cache, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulwark.catalog import configure
from bulwark.operators import cache, chain, messages, offline, scoring
from bulwark.operators.detectors import exfiltration, models, pii, vectors
from bulwark.plans import fixtures as fx
from bulwark.plans import standins
from bulwark.plans.oracle_sql import PATTERNS, matches_sql, redacted_sql
from bulwark.plans.registry import query, rounded, stamp_sql, stamped
from bulwark.session import scratch
from bulwark.sources import golden, responses, tables, validation

ACTIVE = [p for p in PATTERNS if p.confidence >= 0.5]

# Messages.


@query(
    "last_user_input",
    """
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn), '') AS input_text
FROM conversations GROUP BY conv_id""",
)
def last_user_input(spark, sf):
    return messages.input_text(fx.conversations(spark, sf))


@query(
    "message_hash",
    """
SELECT conv_id, sha256(sha256(sha256(string_agg(digest, chr(30) ORDER BY turn)))) AS input_hash
FROM (SELECT conv_id, turn, sha256(concat(role, chr(31), text)) AS digest FROM conversations) d GROUP BY conv_id""",
)
def message_hash(spark, sf):
    return messages.input_hash(fx.conversations(spark, sf))


_INSTRUCTION = messages.BOUNDARY_INSTRUCTION.replace("'", "''")


@query(
    "untrusted_wrap",
    f"""WITH heads AS (
  SELECT conv_id, min(turn) FILTER (WHERE role = 'system') AS system_turn, min(turn) AS first_turn
  FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, CASE
  WHEN c.role = 'user' THEN concat('<untrusted_user_input>', chr(10), c.text, chr(10), '</untrusted_user_input>')
  WHEN c.turn = h.system_turn THEN concat(c.text, chr(10), chr(10), '{_INSTRUCTION}') ELSE c.text END AS text
FROM conversations c JOIN heads h USING (conv_id)
UNION ALL SELECT conv_id, first_turn - 1, 'system', '{_INSTRUCTION}' FROM heads WHERE system_turn IS NULL""",
)
def untrusted_wrap(spark, sf):
    return messages.wrap_untrusted(fx.conversations(spark, sf))


@query(
    "payload_pairs",
    "SELECT conv_id, turn, input_text, output_text FROM pairs",
    ("pairs",),
)
def payload_pairs(spark, sf):
    return messages.pair_payloads(fx.conversations(spark, sf))


@query(
    "redacted_substitution",
    f"""WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role,
  CASE WHEN l.turn IS NOT NULL THEN {redacted_sql("c.text")} ELSE c.text END AS text
FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn""",
)
def redacted_substitution(spark, sf):
    log = fx.conversations(spark, sf)
    cleaned = messages.input_text(log).select("conv_id", pii.redacted(F.col("input_text")).alias("redacted_text"))
    return messages.substitute_redacted(log, cleaned)


@query("chunk_reassembly", "SELECT doc_id AS request_id, nullif(text, '') AS output_text FROM documents")
def chunk_reassembly(spark, sf):
    """Every document streamed word by word, with empty pieces in between, and put together again."""
    words = F.split("text", "(?<= )")
    pieces = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.posexplode(words).alias("at", "content")
    )
    deltas = pieces.select(
        "request_id",
        F.explode(
            F.array(
                F.struct((F.col("at") * 2).alias("seq"), F.col("content").alias("content")),
                F.struct((F.col("at") * 2 + 1).alias("seq"), F.lit(None).cast("string").alias("content")),
            )
        ).alias("d"),
    ).select("request_id", "d.*")
    return messages.reassemble_chunks(deltas)


@query(
    "text_retention",
    f"""
SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS input_text, {redacted_sql("input_text")} AS input_redacted FROM pairs""",
    ("pairs",),
)
def text_retention(spark, sf):
    payloads = messages.pair_payloads(fx.conversations(spark, sf)).drop("output_text")
    cleaned = payloads.withColumn("redacted_text", pii.redacted(F.col("input_text")))
    return messages.retain_text(cleaned, store_input_text=False).drop("redacted_text")


# Detectors.

def _entities_sql() -> str:
    out = "[]"
    for p in ACTIVE:
        out = f"list_concat({out}, list_transform({matches_sql('text', p)}, lambda x: concat('{p.type}:', x)))"
    return out


@query(
    "pii_scan",
    f"""WITH f AS (SELECT doc_id, {_entities_sql()} AS found FROM documents), s AS (
  SELECT doc_id, found, coalesce(list_max(list_transform(found, lambda x: CASE split_part(x, ':', 1) """
    + " ".join(f"WHEN '{p.type}' THEN CAST({p.confidence} AS DOUBLE)" for p in ACTIVE)
    + """ END)), 0) AS score FROM f)
SELECT doc_id, score, len(found) AS n_entities, array_to_string(list_sort(found), '|') AS entities FROM s""",
)
def pii_scan(spark, sf):
    scanned = pii.scan(fx.table(spark, sf, "documents").select("doc_id", "text"))
    shown = F.array_sort(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["match"])))
    return scanned.select(
        "doc_id",
        "score",
        F.size("entities").cast("long").alias("n_entities"),
        F.array_join(shown, "|").alias("entities"),
    )


@query("pii_redact", f"SELECT doc_id, {redacted_sql('text')} AS redacted_text FROM documents")
def pii_redact(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", pii.redacted(F.col("text")).alias("redacted_text"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"  # written out, not the engine's
_NAMED = f"""WITH m AS (
  SELECT doc_id, text, length(split_part(text, ' ', 1)) AS n, regexp_extract_all(text, '{_EMAIL}') AS found, regexp_split_to_array(text, '{_EMAIL}') AS gaps
  FROM documents
), e AS (
  SELECT *, list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0)) AS starts FROM m
), s AS (
  SELECT *, length(text) % 2 = 0 AND n > 0 AND len(list_filter(starts, lambda s: s < n)) = 0 AS person FROM e)"""


@query(
    "pii_scan_entities",
    f"""{_NAMED}
SELECT doc_id, CAST(CASE WHEN len(found) > 0 THEN 1.0 WHEN person THEN 0.85 ELSE 0.0 END AS DOUBLE) AS score,
  array_to_string(list_concat(CASE WHEN person THEN [concat('PERSON:0:', n)] ELSE [] END, list_transform(range(1, len(found) + 1),
    lambda i: concat('EMAIL_ADDRESS:', CAST(starts[i] AS BIGINT), ':', CAST(starts[i] + length(found[i]) AS BIGINT)))), '|') AS entities
FROM s""",
)
def pii_scan_entities(spark, sf):
    """Places of patterns and of a model's entities, without overlaps."""
    scanned = _with_names(spark, sf)
    place = lambda e: F.concat_ws(":", e["type"], e["start"].cast("string"), e["end"].cast("string"))
    return scanned.select("doc_id", "score", F.array_join(F.transform("entities", place), "|").alias("entities"))


def _with_names(spark, sf):
    named = scoring.score(fx.table(spark, sf, "documents").select("doc_id", "text"), standins.NAMES)
    found = named.select("doc_id", "text", F.col("score").alias("names"))
    return pii.scan_spans(found, extra="names", types=("EMAIL_ADDRESS", "PERSON"))


@query(
    "pii_redact_entities",
    f"""{_NAMED}
SELECT doc_id, CASE WHEN person THEN concat('<PERSON>', regexp_replace(substr(text, n + 1), '{_EMAIL}', '<EMAIL_ADDRESS>', 'g'))
  ELSE regexp_replace(text, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g') END AS redacted_text FROM s""",
)
def pii_redact_entities(spark, sf):
    scanned = _with_names(spark, sf)
    return scanned.select("doc_id", pii.redacted_spans(F.col("text"), F.col("entities")).alias("redacted_text"))


@query(
    "pii_report",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT source, lang, '{p.type}' AS entity_type, len({matches_sql('text', p)}) AS n FROM documents"
        for p in ACTIVE
    )
    + """)
SELECT source, lang, entity_type, count(*) AS documents, CAST(sum(n) AS BIGINT) AS matches
FROM c WHERE n > 0 GROUP BY ALL""",
)
def pii_report(spark, sf):
    return pii.report(fx.table(spark, sf, "documents"), ["source", "lang"])


ALLOWED = ("cdn.example.com",)
_IMAGE = exfiltration.IMAGE.replace("'", "''")
_HOST = "lower(regexp_extract({u}, '^(?i:https?)://(?:[^/?#]*@)?([^:/?#]*)', 1))"
_BAD = "regexp_matches({u}, '^(?i:https?):') AND " + _HOST + " NOT IN ('cdn.example.com')"


@query(
    "exfiltration_detect",
    f"""WITH u AS (SELECT doc_id, regexp_extract_all(output_text, '{_IMAGE}', 2) AS urls FROM outputs_with_images)
SELECT doc_id, CASE WHEN len(urls) > 0 AND len(list_filter(urls, lambda x: {_BAD.format(u="x")})) > 0 THEN CAST(1 AS DOUBLE)
    ELSE CAST(0 AS DOUBLE) END AS score,
  array_to_string(list_transform(list_filter(urls, lambda x: {_BAD.format(u="x")}), lambda x: {_HOST.format(u="x")}), ',') AS hosts
FROM u""".replace("WITH u", ", u", 1),
    ("outputs_with_images",),
)
def exfiltration_detect(spark, sf):
    found = exfiltration.detect(fx.outputs_with_images(spark, sf), allowed=ALLOWED)
    hosts = F.array_join(F.transform("matches", lambda m: m["host"]), ",").alias("hosts")
    return found.select("doc_id", "score", hosts)


@query(
    "exfiltration_strip",
    f"""
SELECT doc_id, regexp_replace(output_text, '{_IMAGE.replace("([^)", "((?i:https?):[^)", 1)}',
  '{exfiltration.MARKER}', 'g') AS stripped_text FROM outputs_with_images""",
    ("outputs_with_images",),
)
def exfiltration_strip(spark, sf):
    return exfiltration.strip(fx.outputs_with_images(spark, sf)).select("doc_id", "stripped_text")


@query(
    "exfiltration_strip_allowed",
    f"""
SELECT doc_id, array_to_string(list_transform(list_zip(regexp_split_to_array(output_text, '{_IMAGE}'),
    regexp_extract_all(output_text, '{_IMAGE}'), regexp_extract_all(output_text, '{_IMAGE}', 2)),
  lambda z: concat(z[1], CASE WHEN z[2] IS NULL THEN '' WHEN {_BAD.format(u="z[3]")} THEN '{exfiltration.MARKER}'
    ELSE z[2] END)), '') AS stripped_text FROM outputs_with_images""",
    ("outputs_with_images",),
)
def exfiltration_strip_allowed(spark, sf):
    stripped = exfiltration.strip(fx.outputs_with_images(spark, sf), allowed=ALLOWED)
    return stripped.select("doc_id", "stripped_text")


@query(
    "topic_guardrail",
    """WITH c AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
  FROM embeddings CROSS JOIN range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) r(i) GROUP BY ALL
), topics AS (SELECT label, list(v ORDER BY i) AS t FROM c GROUP BY label)
SELECT e.vec_id, round(greatest(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.t)), 0), 6) AS score
FROM embeddings e CROSS JOIN topics t GROUP BY e.vec_id""",
)
def topic_guardrail(spark, sf):
    """The mean vector of each label is an allowed topic; every vector is scored against all."""
    vecs = fx.table(spark, sf, "embeddings")
    scored = vectors.topic_guardrail_by(vecs, "embedding", _label_means(vecs).select("topic"), "topic")
    return rounded(scored.select("vec_id", "score"), 6)


def _label_means(vecs):
    return (
        vecs.select("label", F.posexplode("embedding").alias("pos", "v"))
        .groupBy("label", "pos")
        .agg(F.avg("v").alias("v"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("topic"))
    )


def _ragged(spark, sf):
    """The vectors, every fifth cut to ten numbers and every seventh absent."""
    v = F.col("embedding")
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice(v, 1, 10)).otherwise(v)
    return fx.table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, cut))


_WIDTH_ERROR = """CASE WHEN vec_id % 7 = 0 THEN 'no vector' WHEN vec_id % 5 = 0 THEN
  concat('vector of width 10, not ', (SELECT max(len(embedding)) FROM embeddings)) END"""


@query(
    "topic_guardrail_ragged",
    f"""WITH c AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
  FROM embeddings CROSS JOIN range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) r(i) GROUP BY ALL
), topics AS (SELECT label, list(v ORDER BY i) AS t FROM c GROUP BY label)
SELECT e.vec_id, CASE WHEN vec_id % 7 <> 0 AND vec_id % 5 <> 0
    THEN round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.t), 0), 6) END AS score, {_WIDTH_ERROR} AS error
FROM embeddings e JOIN topics t USING (label)""",
)
def topic_guardrail_ragged(spark, sf):
    """Each vector against its own label's topic; vectors that cannot be scored say why."""
    vecs = _ragged(spark, sf)
    scored = vectors.topic_guardrail_by(vecs, "embedding", _label_means(fx.table(spark, sf, "embeddings")), "topic")
    return rounded(scored.select("vec_id", "score", "error"), 6)


@query(
    "relevance_ragged",
    """
SELECT a.vec_id, CASE WHEN a.vec_id % 7 <> 0 AND b.vec_id % 7 <> 0 AND (a.vec_id % 5 = 0) = (b.vec_id % 5 = 0) THEN
  round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) END AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
)
def relevance_ragged(spark, sf):
    vecs = _ragged(spark, sf)
    outputs = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("output_vec"))
    pairs = vecs.where(F.col("vec_id") % 2 == 0).join(outputs, "vec_id")
    scored = pairs.withColumn("score", vectors.relevance(F.col("embedding"), F.col("output_vec")))
    return rounded(scored.select("vec_id", "score"), 6)


@query(
    "relevance",
    """
SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
)
def relevance(spark, sf):
    vecs = fx.table(spark, sf, "embeddings")
    inputs = vecs.where(F.col("vec_id") % 2 == 0).select("vec_id", F.col("embedding").alias("input_vec"))
    outputs = vecs.where(F.col("vec_id") % 2 == 1).select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("output_vec")
    )
    scored = inputs.join(outputs, "vec_id").withColumn(
        "score", vectors.relevance(F.col("input_vec"), F.col("output_vec"))
    )
    return rounded(scored.select("vec_id", "score"), 6)


@query(
    "turn_gaps",
    """
SELECT conv_id, count(*) AS n_messages, min(turn) AS first, max(turn) AS last FROM conversations
WHERE NOT (conv_id % 3 = 0 AND turn = 1) GROUP BY conv_id HAVING count(*) <> max(turn) - min(turn) + 1""",
)
def turn_gaps(spark, sf):
    log = fx.conversations(spark, sf).where(~((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1)))
    return validation.turn_gaps(log)


@query(
    "ninth_evaluator",
    f""", s AS (SELECT concat(conv_id, '/', turn) AS request_id, {standins.INJECTION_SQL} AS s1,
    CASE WHEN length(output_text) > 0 THEN CAST(length(output_text) % 71 AS DOUBLE) / 100 END AS s8 FROM pairs)
SELECT request_id, s1 AS score_prompt_injection, CASE WHEN s1 < 0.8 THEN s8 END AS score_verbosity,
  coalesce(s1 < 0.8 AND s8 >= 0.6, false) AS flag_verbosity, s1 >= 0.8 AS blocked FROM s""",
    ("pairs",),
)
def ninth_evaluator(spark, sf):
    """A detector that the catalogue does not know, from its scores to its columns of the log."""
    config = tuple(
        e for e in scoring.catalogue_with(standins.VERBOSITY) if e.name in ("prompt_injection", "verbosity")
    )
    payloads = _records(spark, sf).drop("context_documents")
    calls = offline.guard(payloads, (standins.INJECTION, standins.VERBOSITY), config=config)
    kept = chain.replay(calls.withColumn("latency_ms", F.lit(1)), config)
    wide = chain.assemble(kept, [e.name for e in config])
    return wide.select("request_id", "score_prompt_injection", "score_verbosity", "flag_verbosity", "blocked")


@query(
    "batch_scores",
    """
SELECT doc_id, CASE WHEN length(text) % 50 <> 0 THEN CAST(length(text) % 101 AS DOUBLE) / 100 END AS score,
  CASE WHEN length(text) % 50 = 0 THEN 'unreadable text' END AS error FROM documents""",
)
def batch_scores(spark, sf):
    scored = scoring.score(fx.table(spark, sf, "documents").select("doc_id", "text"), standins.FRAGILE)
    return scored.select("doc_id", "score", "error")


@query(
    "deadline_scores",
    f"""
SELECT doc_id, CASE WHEN NOT hangs THEN CAST(length(text) % 101 AS DOUBLE) / 100 END AS score,
  CASE WHEN hangs THEN 'timeout' END AS error, CASE WHEN hangs THEN {standins.HANGING.timeout_ms} END AS timed_out_ms
FROM (SELECT *, coalesce(length(text) % {standins.HANGS_FOR} = {standins.HANGS_AT}, false) AS hangs FROM documents) d""",
)
def deadline_scores(spark, sf):
    """A model that never returns on some texts, each of which is given up at the deadline."""
    scored = scoring.score(fx.table(spark, sf, "documents").select("doc_id", "text"), standins.HANGING)
    late = F.when(F.col("error") == "timeout", F.col("latency_ms"))
    return scored.select("doc_id", "score", "error", late.alias("timed_out_ms"))


@query(
    "injection_scores",
    f"SELECT conv_id, turn, {standins.INJECTION_SQL} AS score FROM pairs",
    ("pairs",),
)
def injection_scores(spark, sf):
    payloads = messages.pair_payloads(fx.conversations(spark, sf))
    scored = scoring.score(payloads, standins.INJECTION_LABELS)
    return scored.select("conv_id", "turn", models.injection_probability(F.col("score")).alias("score"))


@query(
    "toxicity_scores",
    """
SELECT doc_id, greatest(CAST(length(text) % 83 AS DOUBLE) / 100, CAST(length(text) % 59 AS DOUBLE) / 100) AS any_score,
  least(CAST(length(text) % 83 AS DOUBLE) / 100, CAST(length(text) % 59 AS DOUBLE) / 100) AS all_score,
  CAST(0 AS DOUBLE) AS none_score FROM documents""",
)
def toxicity_scores(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    scored = scoring.score(docs, standins.TOXICITY_DIMENSIONS)
    dims = F.col("score")
    return scored.select(
        "doc_id",
        models.toxicity(dims).alias("any_score"),
        models.toxicity(dims, flag_on="all").alias("all_score"),
        models.toxicity(dims, wanted=("insult",)).alias("none_score"),
    )


@query(
    "grounding",
    """
SELECT request_id, round(max(1 - consistency), 9) AS hallucination, round(max(consistency), 9) AS faithfulness,
  count(*) AS num_docs FROM doc_consistency GROUP BY request_id""",
    ("doc_consistency",),
)
def grounding(spark, sf):
    return rounded(models.grounding(fx.doc_consistency(spark, sf), ["request_id"]))


@query(
    "grounding_errors",
    """
SELECT request_id, CASE WHEN NOT bool_or((request_id + pos) % 7 = 0) THEN round(max(1 - consistency), 9) END AS hallucination,
  CASE WHEN NOT bool_or((request_id + pos) % 7 = 0) THEN round(max(consistency), 9) END AS faithfulness,
  count(*) FILTER (WHERE (request_id + pos) % 7 <> 0) AS num_docs,
  CASE WHEN bool_or((request_id + pos) % 7 = 0) THEN 'model failed' END AS error, CAST(sum(pos + 1) AS INTEGER) AS latency_ms
FROM doc_consistency GROUP BY request_id""",
    ("doc_consistency",),
)
def grounding_errors(spark, sf):
    """One failed document leaves the request without scores."""
    failed = (F.col("request_id") + F.col("pos")) % 7 == 0
    pairs = fx.doc_consistency(spark, sf).withColumns(
        {
            "consistency": F.when(~failed, F.col("consistency")),
            "error": F.when(failed, "model failed"),
            "latency_ms": (F.col("pos") + 1).cast("int"),
        }
    )
    return rounded(models.grounding(pairs, ["request_id"]))


@query(
    "per_document_consistency",
    """
SELECT request_id, string_agg(CAST(CAST(round(consistency * 100, 0) AS INT) AS VARCHAR), ',' ORDER BY pos) AS percent
FROM doc_consistency GROUP BY request_id""",
    ("doc_consistency",),
)
def per_document_consistency(spark, sf):
    listed = models.per_document(fx.doc_consistency(spark, sf), ["request_id"])
    percent = F.transform("per_document", lambda c: F.round(c * 100, 0).cast("int").cast("string"))
    return listed.select("request_id", F.array_join(percent, ",").alias("percent"))


# Offline evaluation of whole conversations: all evaluators, stand-ins for the models.

_CONTEXT = """, sys AS (SELECT conv_id, text AS document FROM conversations WHERE role = 'system'), p AS (
  SELECT pairs.*, s.document FROM pairs LEFT JOIN sys s USING (conv_id))"""
_SCORED = f"""{_CONTEXT}, f AS (SELECT *, {_entities_sql().replace("text", "input_text")} AS found FROM p), sc AS (
  SELECT conv_id, turn, input_text, output_text, coalesce(list_max(list_transform(found, lambda x: CASE split_part(x, ':', 1) """ + " ".join(
    f"WHEN '{p.type}' THEN CAST({p.confidence} AS DOUBLE)" for p in ACTIVE
) + f""" END)), 0) AS score_pii, {standins.INJECTION_SQL} AS score_prompt_injection,
    CASE WHEN length(output_text) > 0 THEN {standins.TOXICITY_SQL} END AS score_toxicity,
    CASE WHEN length(output_text) > 0 THEN CAST(0 AS DOUBLE) END AS score_exfiltration,
    CASE WHEN length(output_text) > 0 THEN {standins.RELEVANCE_SQL} END AS score_relevance,
    CASE WHEN length(output_text) > 0 AND document IS NOT NULL
         THEN 1 - CAST((length(document) * 5 + length(output_text)) % 101 AS DOUBLE) / 100 END AS score_hallucination,
    CASE WHEN length(output_text) > 0 AND document IS NOT NULL
         THEN CAST((length(document) * 5 + length(output_text)) % 101 AS DOUBLE) / 100 END AS score_faithfulness
  FROM f)"""


_FLAGGED = f"""{_SCORED}, fl AS (SELECT *, score_pii >= 0.5 AS f0, score_prompt_injection >= 0.8 AS f1,
  coalesce(score_toxicity >= 0.7, false) AS f3, coalesce(score_relevance <= 0.3, false) AS f5,
  coalesce(score_hallucination >= 0.5, false) AS f6, coalesce(score_faithfulness <= 0.5, false) AS f7 FROM sc)"""
MODELS = (standins.INJECTION, standins.TOXICITY, standins.RELEVANCE)


def _records(spark, sf):
    """Pairs of user and assistant messages, with the system message as context document."""
    log = fx.conversations(spark, sf)
    context = log.where(F.col("role") == "system").select("conv_id", F.array("text").alias("context_documents"))
    payloads = messages.pair_payloads(log).join(context, "conv_id", "left")
    return payloads.withColumn("request_id", F.concat_ws("/", "conv_id", "turn"))


CHAINED = configure({"topic_guardrail": {"enabled": True}})


def _offline_sql() -> str:
    """Calls in long form, the race by (latency, order), then one row per record."""
    calls = " UNION ALL ".join(
        f"""SELECT conv_id, turn, '{e.name}' AS evaluator, {e.ord} AS ord, '{e.chain}' = 'input' AS is_input,
    {"score_topic" if e.name == "topic_guardrail" else f"score_{e.name}"} AS raw, (conv_id * 131 + turn * 17 + {e.ord * 977}) % 3400 AS took,
    {"CASE WHEN length(input_text) % 11 = 0 THEN 'off the map' END" if e.name == "topic_guardrail" else "CAST(NULL AS VARCHAR)"} AS failure,
    {e.threshold} AS threshold, '{e.direction}' = 'above' AS above, {e.action != "redact" and e.chain == "input"} AS can_block
  FROM scored"""
        for e in CHAINED
    )
    columns = ", ".join(
        f"round(max(score) FILTER (WHERE evaluator = '{e.name}' AND kept), 9) AS score_{e.name}" for e in CHAINED
    )
    return f"""{_SCORED}, scored AS (SELECT *, {standins.TOPIC_SQL} AS score_topic FROM sc), c AS ({calls}), r AS (
  SELECT *, CASE WHEN took <= 3000 AND failure IS NULL THEN raw END AS score, CASE WHEN took > 3000 THEN 'timeout' ELSE failure END AS error,
    least(took, 3000) * 100 + ord AS finish FROM c
), g AS (SELECT *, coalesce(CASE WHEN above THEN score >= threshold ELSE score <= threshold END, false) AS flag FROM r), w AS (
  SELECT *, min(finish) FILTER (WHERE flag AND can_block) OVER (PARTITION BY conv_id, turn) AS stop FROM g
), k AS (SELECT *, NOT is_input OR stop IS NULL OR finish <= stop AS kept FROM w)
SELECT conv_id, turn, {columns},
  coalesce(string_agg(evaluator, ',' ORDER BY ord) FILTER (WHERE kept AND flag), '') AS flags,
  max(evaluator) FILTER (WHERE finish = stop) AS blocked_by, max(stop) IS NOT NULL AS blocked,
  coalesce(string_agg(concat(evaluator, ': ', error), '; ' ORDER BY ord) FILTER (WHERE kept AND error IS NOT NULL), '') AS error,
  max(stop) IS NULL AND NOT bool_or(kept AND flag) AS passed
FROM k GROUP BY conv_id, turn"""


def _took(calls):
    """Latencies as they might have been logged: some over the timeout, in varying order."""
    conv, turn = (F.split_part("request_id", F.lit("/"), F.lit(i)).cast("long") for i in (1, 2))
    return calls.withColumn("latency_ms", ((conv * 131 + turn * 17 + F.col("ord") * 977) % 3400).cast("int"))


@query("offline_evaluation", _offline_sql(), ("pairs",))
def offline_evaluation(spark, sf):
    """All evaluators, with timeouts, failing rows and the first blocker cancelling slower calls."""
    results = offline.evaluate(
        _records(spark, sf), (*MODELS, standins.TOPIC), standins.CONSISTENCY, CHAINED, logged=_took
    )
    scores = [F.col("scores")[e.name].alias(f"score_{e.name}") for e in CHAINED]
    flags = F.array_join("flags", ",").alias("flags")
    return rounded(results.select("conv_id", "turn", *scores, flags, "blocked_by", "blocked", "error", "passed"))


@query(
    "offline_result_rows",
    f"""WITH u AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS record_index, conv_id, text FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0
), e AS (SELECT *, len({_entities_sql()}) > 0 AS f0, {standins.INJECTION_SQL.replace("input_text", "text")} AS s1,
    {standins.TOXICITY_SQL.replace("output_text", "text")} AS s3 FROM u)
SELECT 'run-7' AS eval_run_id, record_index, text AS input_text, lower(text) AS actual_output, s1 AS score_prompt_injection,
  CASE WHEN length(text) > 0 THEN s3 END AS score_toxicity, NOT (f0 OR s1 >= 0.8 OR coalesce(s3 >= 0.7 AND length(text) > 0, false)) AS passed
FROM e""",
)
def offline_result_rows(spark, sf):
    """From an offline dataset to rows of the result table."""
    records, _ = golden.read_offline(spark, _write_golden(spark, sf))
    listed = records.select(
        F.col("record_index").cast("string").alias("request_id"),
        "record_index",
        F.col("input").alias("input_text"),
        F.col("output").alias("output_text"),
    )
    results = offline.evaluate(listed, (standins.INJECTION, standins.TOXICITY), logged=lambda c: c.withColumn("latency_ms", F.lit(1)))
    path = scratch(spark, "offline-results")
    tables.append_results(offline.result_rows(results, "run-7"), path)
    rows = spark.read.parquet(path)
    scores = [F.col("scores")[n].alias(f"score_{n}") for n in ("prompt_injection", "toxicity")]
    return rows.select("eval_run_id", "record_index", "input_text", "actual_output", *scores, "passed")


@query(
    "guarded_requests",
    f"""{_FLAGGED}, h AS (
  SELECT conv_id, sha256(sha256(sha256(string_agg(digest, chr(30) ORDER BY turn)))) AS input_hash
  FROM (SELECT conv_id, turn, sha256(concat(role, chr(31), text)) AS digest FROM conversations) d GROUP BY conv_id)
SELECT concat(conv_id, '/', turn) AS id, input_hash, input_text,
  CASE WHEN f1 THEN input_text ELSE {redacted_sql("input_text")} END AS input_redacted,
  f0 OR f1 AS blocked, CASE WHEN f0 THEN 'pii_detected' WHEN f1 THEN 'prompt_injection_detected' END AS block_reason,
  score_pii, score_prompt_injection, CASE WHEN NOT f1 THEN score_toxicity END AS score_toxicity,
  CASE WHEN NOT f1 THEN score_exfiltration END AS score_exfiltration,
  CASE WHEN NOT f1 THEN score_relevance END AS score_relevance,
  round(CASE WHEN NOT f1 THEN score_hallucination END, 9) AS score_hallucination,
  NOT f1 AND f5 AS flag_relevance, 0 AS latency_total
FROM fl JOIN h USING (conv_id)""",
    ("pairs",),
)
def guarded_requests(spark, sf):
    """From conversations to request-log rows: pair, score, replay, assemble, redact, hash."""
    records = _records(spark, sf)
    # Stand-in models take no time worth logging; equal latencies finish in catalogue order.
    calls = offline.guard(records, MODELS, standins.CONSISTENCY).withColumn("latency_ms", F.lit(1))
    hashes = messages.input_hash(fx.conversations(spark, sf))
    attributes = records.join(hashes, "conv_id").select(
        "request_id",
        "input_hash",
        "input_text",
        pii.redacted(F.col("input_text")).alias("redacted_text"),
        F.lit(None).cast("int").alias("latency_total"),
    )
    assembled = chain.assemble(chain.replay(calls), with_blocker=True)
    rows = chain.request_records(assembled, attributes)
    return rounded(
        rows.select(
            "id", "input_hash", "input_text", "input_redacted", "blocked", "block_reason", "score_pii",
            "score_prompt_injection", "score_toxicity", "score_exfiltration", "score_relevance",
            "score_hallucination", "flag_relevance", "latency_total",
        )
    )


# Score cache.

_CACHE_TEXTS = """, t AS (
  SELECT conv_id, turn, conv_id % 4 AS tenant_id, input_text,
    concat('guard:', CAST(conv_id % 4 AS VARCHAR), ':scores:', sha256(concat(input_text, '|v1'))) AS cache_key FROM pairs)"""


@query("cache_keys", f"{_CACHE_TEXTS} SELECT conv_id, turn, cache_key FROM t", ("pairs",))
def cache_keys(spark, sf):
    return _cache_texts(spark, sf).select("conv_id", "turn", "cache_key")


def _cache_texts(spark, sf):
    payloads = messages.pair_payloads(fx.conversations(spark, sf)).withColumn("tenant_id", F.col("conv_id") % 4)
    return cache.with_cache_key(payloads, "v1").drop("output_text")


def _base():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def _hours(n):
    return _base() + F.make_dt_interval(F.lit(0), n)


_CACHE = """, entries AS (
  SELECT tenant_id, cache_key, e.evaluator, CASE e.evaluator WHEN 'pii' THEN CAST(conv_id % 10 AS DOUBLE) / 10
      ELSE CAST(conv_id % 7 AS DOUBLE) / 10 END AS score, concat('m', conv_id % 10) AS metadata, conv_id % 5 AS hour
  FROM t CROSS JOIN (VALUES ('pii'), ('prompt_injection')) AS e(evaluator) WHERE e.evaluator = 'pii' OR conv_id % 3 = 1
), stored AS (
  SELECT tenant_id, cache_key, evaluator, score, metadata, TIMESTAMP '2024-01-01 00:00:00' + to_hours(hour) AS written_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(hour + 1) AS expires_at
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, cache_key, evaluator ORDER BY hour DESC, score DESC, metadata DESC) AS rn
        FROM entries) q WHERE rn = 1)"""


def _stored(spark, sf):
    """A cache filled from all messages: pii of every text, injection for one conversation in three.

    Copies of a text collapse to their latest entry. Entries expire hour by hour.
    """
    conv = F.col("conv_id")
    hour = (conv % 5).cast("int")
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("pii").alias("evaluator"), ((conv % 10).cast("double") / 10).alias("score")),
            F.when(
                conv % 3 == 1,
                F.struct(
                    F.lit("prompt_injection").alias("evaluator"), ((conv % 7).cast("double") / 10).alias("score")
                ),
            ),
        )
    )
    listed = _cache_texts(spark, sf).select(
        "tenant_id", "cache_key", hour.alias("hour"), F.concat(F.lit("m"), conv % 10).alias("metadata"), F.inline(entries)
    )
    latest = F.max(F.struct("hour", "score", "metadata")).alias("e")
    return (
        listed.groupBy("tenant_id", "cache_key", "evaluator")
        .agg(latest)
        .select(
            "tenant_id",
            "cache_key",
            "evaluator",
            "e.score",
            "e.metadata",
            _hours(F.col("e.hour")).alias("written_at"),
            _hours(F.col("e.hour") + 1).alias("expires_at"),
        )
    )


_WANTED = """, w AS (SELECT t.conv_id, t.turn, t.cache_key, e.evaluator FROM t CROSS JOIN
  (VALUES ('pii'), ('prompt_injection'), ('topic_guardrail')) AS e(evaluator)),
  alive AS (SELECT * FROM stored WHERE expires_at > TIMESTAMP '2024-01-01 03:00:00')"""
CACHE_AS_OF = "2024-01-01 03:00:00"


@query(
    "cache_hits",
    f"""{_CACHE_TEXTS}{_CACHE}{_WANTED}
SELECT w.conv_id, w.turn, w.evaluator, a.score, 0 AS latency_ms FROM w JOIN alive a USING (cache_key, evaluator)""",
    ("pairs",),
)
def cache_hits(spark, sf):
    hits = cache.cache_hits(cache.wanted(_cache_texts(spark, sf)), _stored(spark, sf), CACHE_AS_OF)
    return hits.select("conv_id", "turn", "evaluator", "score", "latency_ms")


@query(
    "cache_misses",
    f"""{_CACHE_TEXTS}{_CACHE}{_WANTED}
SELECT w.conv_id, w.turn, w.evaluator FROM w
WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.cache_key = w.cache_key AND a.evaluator = w.evaluator)""",
    ("pairs",),
)
def cache_misses(spark, sf):
    misses = cache.cache_misses(cache.wanted(_cache_texts(spark, sf)), _stored(spark, sf), CACHE_AS_OF)
    return misses.select("conv_id", "turn", "evaluator")


@query(
    "cached_batch_scores",
    f"""{_CACHE_TEXTS}{_CACHE}, alive AS (
  SELECT * FROM stored WHERE evaluator = 'prompt_injection' AND expires_at > TIMESTAMP '2024-01-01 03:00:00')
SELECT t.conv_id, t.turn, a.cache_key IS NOT NULL AS cached,
  CASE WHEN a.cache_key IS NOT NULL THEN a.score ELSE {standins.INJECTION_SQL} END AS score, a.metadata
FROM t LEFT JOIN alive a USING (cache_key)""",
    ("pairs",),
)
def cached_batch_scores(spark, sf):
    texts = _cache_texts(spark, sf)
    scored = scoring.score_cached(texts, standins.INJECTION, _stored(spark, sf), CACHE_AS_OF)
    return scored.select("conv_id", "turn", "cached", "score", "metadata")


@query(
    "cache_write_back",
    f"""{_CACHE_TEXTS}{_CACHE}, fresh AS (
  SELECT tenant_id, cache_key, 'pii' AS evaluator, CAST(length(input_text) % 100 AS DOUBLE) / 100 AS score, 'new' AS metadata,
    max(TIMESTAMP '2024-01-01 03:30:00') AS written_at
  FROM t WHERE length(input_text) % 6 <> 0 AND length(input_text) % 5 <> 0 GROUP BY ALL
), k AS (SELECT cache_key, min(written_at) AS first_write, max(written_at) AS last_write FROM fresh GROUP BY 1), m AS (
  SELECT tenant_id, cache_key, evaluator, score, metadata, written_at, expires_at FROM stored
  UNION ALL SELECT *, NULL FROM fresh
), kept AS (
  SELECT m.*, k.last_write, row_number() OVER (PARTITION BY m.cache_key, m.evaluator ORDER BY m.written_at DESC) AS rn
  FROM m LEFT JOIN k USING (cache_key) WHERE NOT coalesce(m.expires_at <= k.first_write, false))
SELECT tenant_id, cache_key, evaluator, score, metadata, {stamp_sql("written_at")} AS written_at,
  {stamp_sql("coalesce(last_write + INTERVAL '1' HOUR, expires_at)")} AS expires_at FROM kept
WHERE rn = 1 AND coalesce(last_write + INTERVAL '1' HOUR, expires_at) > TIMESTAMP '2024-01-01 03:30:00'""",
    ("pairs",),
)
def cache_write_back(spark, sf):
    """Through the stored cache: filled, then written to again, with what expired gone."""
    n = F.length("input_text")
    fresh = _cache_texts(spark, sf).select(
        "tenant_id",
        "cache_key",
        F.lit("pii").alias("evaluator"),
        F.when(n % 6 != 0, (n % 100).cast("double") / 100).alias("score"),
        F.lit("new").alias("metadata"),
        F.lit("2024-01-01 03:30:00").cast("timestamp_ntz").alias("written_at"),
        F.when(n % 5 == 0, "boom").alias("error"),
    )
    return stamped(cache.write_back(_stored(spark, sf), fresh, as_of="2024-01-01 03:30:00"))


@query(
    "cache_store",
    f"""{_CACHE_TEXTS}
SELECT tenant_id, cache_key, 'pii' AS evaluator, CAST(length(input_text) % 100 AS DOUBLE) / 100 AS score, 'second' AS metadata,
  '2024-01-01 00:30:00.000000' AS written_at, '2024-01-01 01:30:00.000000' AS expires_at
FROM t WHERE length(input_text) % 4 <> 0 GROUP BY ALL
UNION ALL
SELECT tenant_id, cache_key, 'pii', CAST(length(input_text) % 10 AS DOUBLE) / 10, 'first',
  '2024-01-01 00:00:00.000000', '2024-01-01 01:00:00.000000'
FROM t WHERE length(input_text) % 4 = 0 GROUP BY ALL""",
    ("pairs",),
)
def cache_store(spark, sf):
    """Two writes to a stored cache; the second replaces most scores and repeats itself harmlessly."""
    n = F.length("input_text")
    texts = _cache_texts(spark, sf)
    none = F.lit(None).cast("string").alias("error")
    path = scratch(spark, "stored-cache")

    def written(score, metadata: str, at: str, rows):
        return rows.select(
            "tenant_id", "cache_key", F.lit("pii").alias("evaluator"), score.alias("score"), F.lit(metadata).alias("metadata"),
            F.lit(at).cast("timestamp_ntz").alias("written_at"), none,
        )

    cache.store(written((n % 10).cast("double") / 10, "first", "2024-01-01 00:00:00", texts), path)
    second = written((n % 100).cast("double") / 100, "second", "2024-01-01 00:30:00", texts.where(n % 4 != 0))
    for _ in range(2):
        cache.store(second, path)
    return stamped(cache.read(spark, path))


# Datasets and logged responses.


def _write_golden(spark, sf):
    """Conversations as a golden file: user messages are records, system messages comments,
    assistant messages blank lines; every third record has no output."""
    role, record = F.col("role"), F.struct(
        F.col("text").alias("input"),
        F.when(F.col("turn") > 0, F.concat(F.lit("model-"), F.col("turn").cast("string"))).alias("model"),
        F.when(F.col("conv_id") % 3 != 0, F.lower("text")).alias("output"),
        F.when(F.col("turn") > 1, F.array(F.col("role"))).alias("tags"),
        (F.col("conv_id") % 2 == 0).alias("expected_blocked"),
    )
    comment = F.concat(F.lit("# "), F.regexp_replace("text", "[\\r\\n]", " "))
    line = F.when(role == "user", F.concat(F.lit("  "), F.to_json(record))).when(role == "system", comment)
    lines = fx.conversations(spark, sf).orderBy("conv_id", "turn").select(F.coalesce(line, F.lit("")).alias("value"))
    path = scratch(spark, "golden")
    lines.write.text(path)
    return path


@query(
    "golden_records",
    """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS record_index, text AS input,
  CASE WHEN turn > 0 THEN concat('model-', turn) ELSE 'llama3.2' END AS model, 0 AS n_context,
  conv_id % 2 = 0 AS expected_blocked FROM conversations WHERE role = 'user'""",
)
def golden_records(spark, sf):
    records = golden.read_golden(spark, _write_golden(spark, sf))
    return records.select(
        "record_index", "input", "model", F.size("context_documents").alias("n_context"), "expected_blocked"
    )


@query(
    "offline_records",
    """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS record_index, text AS input, lower(text) AS output,
  CASE WHEN turn > 1 THEN 'user' ELSE '' END AS tags FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0""",
)
def offline_records(spark, sf):
    records, _ = golden.read_offline(spark, _write_golden(spark, sf))
    return records.select("record_index", "input", "output", F.array_join("tags", ",").alias("tags"))


@query(
    "offline_rejects",
    "SELECT count(*) AS n_rejected FROM conversations WHERE role = 'user' AND conv_id % 3 = 0",
)
def offline_rejects(spark, sf):
    _, rejected = golden.read_offline(spark, _write_golden(spark, sf))
    return rejected.agg(F.count("*").alias("n_rejected"))


@query(
    "live_results",
    """
SELECT id AS record_index, CASE WHEN id % 43 = 0 THEN NULL WHEN blocked THEN
    CASE WHEN block_reason = 'pii_detected' THEN score_pii END ELSE score_pii END AS score_pii,
  CASE WHEN id % 43 <> 0 AND (NOT blocked OR block_reason = 'prompt_injection_detected') THEN score_prompt_injection END AS score_prompt_injection,
  CASE WHEN id % 43 = 0 THEN '' WHEN blocked THEN replace(block_reason, '_detected', '') WHEN flag_toxicity THEN 'toxicity' ELSE '' END AS flags,
  id % 43 <> 0 AND blocked AS blocked, CASE WHEN id % 43 <> 0 AND blocked THEN block_reason END AS block_reason,
  CASE WHEN id % 43 <> 0 AND NOT blocked THEN concat('answer ', id) END AS actual_output,
  CASE WHEN id % 43 = 0 THEN 'HTTP 502: bad gateway' END AS error,
  id % 43 = 0 OR NOT (blocked OR flag_toxicity) AS passed FROM requests""",
    ("requests",),
)
def live_results(spark, sf):
    r = fx.requests(spark, sf)
    flags = F.when(F.col("flag_toxicity"), F.array(F.lit("toxicity"))).otherwise(F.array().cast("array<string>"))
    scores = F.create_map(F.lit("pii"), F.col("score_pii"), F.lit("prompt_injection"), F.col("score_prompt_injection"))
    ok = F.to_json(
        F.struct(
            F.array(
                F.struct(F.struct(F.concat(F.lit("answer "), F.col("id").cast("string")).alias("content")).alias("message"))
            ).alias("choices"),
            F.struct(scores.alias("scores"), flags.alias("flags")).alias("guard"),
        )
    )
    score = F.when(F.col("block_reason") == "pii_detected", F.col("score_pii")).otherwise(F.col("score_prompt_injection"))
    refused = F.to_json(F.struct(F.struct(F.col("block_reason").alias("code"), score.alias("score")).alias("error")))
    down = F.col("id") % 43 == 0
    log = r.select(
        F.col("id").alias("record_index"),
        F.when(down, 502).when(F.col("blocked"), 400).otherwise(200).alias("status"),
        F.when(down, "bad gateway").when(F.col("blocked"), refused).otherwise(ok).alias("body"),
    )
    results = responses.normalise_responses(log)
    return results.select(
        "record_index",
        F.col("scores")["pii"].alias("score_pii"),
        F.col("scores")["prompt_injection"].alias("score_prompt_injection"),
        F.array_join("flags", ",").alias("flags"),
        "blocked",
        "block_reason",
        "actual_output",
        "error",
        "passed",
    )
