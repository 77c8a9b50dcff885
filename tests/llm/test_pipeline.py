import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from bulwark.llm import (
    bpe,
    fill_in_middle,
    langid,
    lblm,
    mixing,
    quality,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    weighted_sampling,
)


def test_stages(spark, documents, data_dir):
    """Every stage on its input: kept columns, effects, and the last one against the library."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data_dir)
        assert out.columns == documents.columns
        before, after = docs.collect(), out.collect()
        if name in ("quality", "simhash"):
            assert set(after) <= set(before) and len(after) < len(before)
        if name == "secrets":
            assert len(after) == len(before) and {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        docs = spark.createDataFrame(after, documents.schema)
    name, stage = corpus_pipeline.STAGES[-1]
    library = Tokenizer.from_file(bpe.public_vocabulary())
    texts = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect())
    rows = sorted((r["doc_id"], np.frombuffer(r["ids"], dtype=bpe.PACKED).tolist()) for r in stage(spark, docs, data_dir).collect())
    assert rows == texts


def test_run_equals_its_stages(spark, documents, labels, data_dir):
    got = corpus_pipeline.run(spark, data_dir)
    kept = simhash.one_of_each(quality.good(documents, labels))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_stages_on_odd_and_empty_tables(spark, odd, empty, data_dir):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data_dir)
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_last_stage_decodes(spark, documents, odd, data_dir):
    for docs in (documents, odd):
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir).select("doc_id", "decoded").collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(rows, key=key) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=key)


INTERNAL = (
    "_grade _text _id _bw_size _bw_start _bw_again _bw_pass _bw_source _bw_no _bw_shard _bw_quota _words _blocks _row _base _spans "
    "_bulwark_row row row1 row2 fp root first base spans filled found c0 c1 c4 shard packed place data id label vector width rank "
    "doc part at start n_tokens ids size target taken score held_out _held_out decoded token tie copy n form"
).split()


def test_stages_keep_columns_with_internal_names(spark, documents, data_dir):
    """Every stage and operator on a table that has all internal names as columns of its own."""
    some = documents.where("doc_id < 60")
    wide = some.select("*", *[F.lit(f"own {c}").alias(c) for c in INTERNAL])
    docs, plain = wide, some
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, data_dir), stage(spark, plain, data_dir)
        assert docs.columns == wide.columns
        rows, want = docs.collect(), plain.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in INTERNAL)
        if name in ("quality", "simhash", "secrets"):
            assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in want)
        docs, plain = spark.createDataFrame(rows, wide.schema), spark.createDataFrame(want, some.schema)
    ids = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.encoded(spark, df, data_dir).collect())
    assert ids(docs) == sorted((r["doc_id"], len(n)) for r in docs.collect() for n in [Tokenizer.from_file(bpe.public_vocabulary()).encode(r["text"]).ids])


def test_operators_ignore_columns_with_internal_names(spark, documents, labels):
    some = documents.where("doc_id < 60")
    wide = some.select("*", *[F.lit("own").alias(c) for c in INTERNAL])
    for run in (
        lambda d: quality.graded(d, labels), mixing.taken, simhash.groups, secret_scan.report, langid.identified, lblm.scores,
        lambda d: toxicity.scored(d, labels), lambda d: fill_in_middle.digests(fill_in_middle.arranged(d)),
        lambda d: token_files.round_trip(d, token_files.public_vocabulary()),
        lambda d: bpe.digests(bpe.encode(d, bpe.public_vocabulary(), decoded=True)),
        lambda d: weighted_sampling.digests(weighted_sampling.edited(d)),
    ):
        got, want = run(wide), run(some)
        assert got.columns == want.columns and got.count() == want.count()
