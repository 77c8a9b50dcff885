import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bulwark.operators import messages

SCHEMA = "conv_id long, turn long, role string, text string"


def conv(spark, *rows):
    return spark.createDataFrame([(c, t, r, x) for c, t, r, x in rows], SCHEMA)


def texts(df, conv_id=1):
    return [(r.role, r.text) for r in df.where(F.col("conv_id") == conv_id).orderBy("turn").collect()]


def test_input_is_last_user_message_else_last_message(spark):
    df = conv(spark, (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"),
              (2, 0, "system", "s"), (2, 1, "assistant", "t"), (3, 0, "user", None))
    assert {r.conv_id: r.input_text for r in messages.input_text(df).collect()} == {1: "b", 2: "t", 3: ""}


def test_wrap_inserts_system_message_when_missing(spark):
    wrapped = messages.wrap_untrusted(conv(spark, (1, 0, "user", "hi"), (1, 1, "assistant", "yo")))
    assert texts(wrapped) == [
        ("system", messages.BOUNDARY_INSTRUCTION),
        ("user", "<untrusted_user_input>\nhi\n</untrusted_user_input>"),
        ("assistant", "yo"),
    ]


def test_wrap_appends_to_first_system_message_only(spark):
    df = conv(spark, (1, 0, "user", "x"), (1, 1, "system", "one"), (1, 2, "system", "two"), (1, 3, "user", "y"))
    got = texts(messages.wrap_untrusted(df))
    assert got[1] == ("system", f"one\n\n{messages.BOUNDARY_INSTRUCTION}") and got[2] == ("system", "two")
    assert got[3][1] == "<untrusted_user_input>\ny\n</untrusted_user_input>" and len(got) == 4


def test_substitution_replaces_only_the_last_user_message(spark):
    df = conv(spark, (1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "c"), (3, 0, "assistant", "d"))
    redactions = spark.createDataFrame([(1, "B"), (2, ""), (3, "D")], "conv_id long, redacted_text string")
    out = messages.substitute_redacted(df, redactions)
    assert texts(out, 1) == [("user", "a"), ("user", "B")]
    assert texts(out, 2) == [("user", "c")] and texts(out, 3) == [("assistant", "d")]


def test_pairs_need_the_answer_directly_after(spark):
    df = conv(spark, (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"))
    got = {r.turn: (r.input_text, r.output_text) for r in messages.pair_payloads(df).collect()}
    assert got == {0: ("a", None), 1: ("b", "c"), 3: ("d", None)}


def test_hash_depends_on_order_role_and_text(spark):
    long = [(1, i, "user", f"m{i}") for i in range(3000)]
    same = [(2, i, "user", f"m{i}") for i in range(3000)]
    swapped = [(3, i, "user", f"m{i}") for i in range(2998)] + [(3, 2998, "user", "m2999"), (3, 2999, "user", "m2998")]
    split = [(4, 0, "user", "ab"), (4, 1, "user", "c"), (5, 0, "user", "a"), (5, 1, "user", "bc"), (6, 0, "assistant", "ab")]
    hashes = {r.conv_id: r.input_hash for r in messages.input_hash(conv(spark, *long, *same, *swapped, *split)).collect()}
    assert hashes[1] == hashes[2] != hashes[3] and len(set(hashes.values())) == 5


def test_chunks_join_in_order_over_blocks(spark):
    n = 2500
    rows = [(1, i, str(i % 10) if i % 3 else None) for i in range(n)] + [(2, 0, None), (2, 1, "")]
    df = spark.createDataFrame(rows, "request_id long, seq long, content string").orderBy(F.rand(1))
    got = {r.request_id: r.output_text for r in messages.reassemble_chunks(df).collect()}
    assert got == {1: "".join(str(i % 10) for i in range(n) if i % 3), 2: None}


def plainly(rows):
    """Request -> pieces by (seq, content), those without a seq first."""
    of: dict = {}
    for request, seq, content in rows:
        of.setdefault(request, []).append((seq is not None, seq or 0, content))
    return {r: "".join(c for *_, c in sorted(p for p in pieces if p[2] is not None)) or None for r, pieces in of.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_chunks_that_repeat_overlap_or_lack_a_place(spark, parts):
    rng = random.Random(3)
    rows = [("a", i, rng.choice(["x", "", None, "é ", "yz"])) for i in range(3000)] + [("a", i, "again") for i in range(1000, 1100)]
    rows += [("b", i, str(i)) for i in range(5, 9)] + [("b", i, f"<{i}>") for i in range(7, 12)] + [("b", None, "n"), ("b", 1, "one"), ("b", None, "m")]
    rows += [(None, 0, "no"), (None, 1, "body"), ("c", 0, None), ("d", -1, "before"), ("d", 0, "zero"), ("d", 2**31, "far"), ("e", None, None)]
    mixed = rng.sample(rows, len(rows))
    for some in (rows, mixed):
        df = spark.createDataFrame(some, "request_id string, seq long, content string").repartition(parts)
        assert {r.request_id: r.output_text for r in messages.reassemble_chunks(df).collect()} == plainly(rows)
    ints = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "request_id int, seq int, content string")
    assert [tuple(r) for r in messages.reassemble_chunks(ints).collect()] == [(1, "ab")]


def test_chunks_are_gathered_before_they_are_dealt_out(spark):
    chunks = spark.range(400, numPartitions=2).select(F.col("id").alias("request_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("seq"))
    chunks = chunks.withColumn("content", F.when(F.col("seq") % 2 == 0, F.concat(F.col("seq"), F.lit(" "))))
    # 40,000 pieces: one run per response, and one more where a batch of rows ends within it.
    assert messages.chunk_runs(chunks).count() <= 410
    plan = messages.reassemble_chunks(chunks)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "MapInArrow" in first and "Aggregate" not in first
    got = messages.reassemble_chunks(chunks).select("output_text").distinct().collect()
    assert [r.output_text for r in got] == ["".join(f"{i} " for i in range(0, 100, 2))]


def test_retention(spark):
    df = spark.createDataFrame([("raw", "red"), ("raw", None), ("raw", "")], "input_text string, redacted_text string")

    def kept(**options):
        return [(r.input_text, r.input_redacted) for r in messages.retain_text(df, **options).collect()]

    assert kept() == [("raw", "red"), ("raw", "raw"), ("raw", "raw")]
    assert kept(store_input_text=False) == [(None, "red"), (None, "raw"), (None, "raw")]
    assert kept(null_on_pii=True) == [(None, "red"), ("raw", "raw"), ("raw", "raw")]


@pytest.mark.parametrize("version", ["1", "2"])
def test_cache_key_value(spark, version):
    from bulwark.functions.text import cache_key

    df = spark.createDataFrame([("t1", "héllo")], "tenant string, text string")
    key = df.select(cache_key(F.col("tenant"), F.col("text"), version).alias("k")).collect()[0].k
    assert key == "guard:t1:scores:" + hashlib.sha256(f"héllo|{version}".encode()).hexdigest()


def test_uuid_forms(spark):
    from bulwark.functions.text import key_prefix, uuid_or_null

    want = "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    forms = [want, want.upper(), "{" + want + "}", "urn:uuid:" + want, want.replace("-", ""), "no", "", want + "0", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    rows = df.orderBy("i").select(uuid_or_null(F.col("t")).alias("u"), key_prefix(F.col("t")).alias("p")).collect()
    assert [r.u for r in rows] == [want] * 5 + [None] * 4
    assert rows[0].p == want[:20]
