import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bulwark.llm import langid, quality, toxicity

SIZED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SIZED}/documents.parquet"), spark.read.parquet(f"{SIZED}/labels.parquet")


def remainder(id_, folds):
    return zlib.crc32(str(id_).encode()) % folds


# Languages.


def test_languages(more):
    docs, _ = more
    rows = langid.identified(docs).collect()
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(true) and all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"] and true[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in unseen]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_do_not_leak(more):
    """Labels of held-out rows, and other columns, change nothing."""
    docs, _ = more
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(langid.identified(docs).collect()) == sorted(langid.identified(changed.repartition(5)).collect())


def test_languages_odd_rows(odd, empty):
    rows = langid.identified(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5, 9))
    assert langid.identified(empty).count() == 0
    one = langid.identified(odd.where("lang = 'en'")).collect()
    assert {r["lang_pred"] for r in one} == {"en"}
    none = langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_gram_counts_over_chunks(monkeypatch):
    text = "Straße à la carte, otra vez. " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    parts = langid.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].sum() == sum(len(text) - n for n in range(langid.GRAMS))


def test_temperature_and_sparsity():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), y] += 1.0
    # These logits are calibrated; four times as large ones need a temperature of four.
    assert abs(langid.temperature(4 * logits, y) / langid.temperature(logits, y) - 4) < 0.05
    vectors = [(np.array([int(t), 100 + int(rng.integers(0, 5000))]), np.array([1.0, 0.3])) for t in y]
    w = langid.ftrl(vectors, y.tolist(), 3, 1)
    assert (w[:3].argmax(axis=1) == np.arange(3)).all() and (w == 0).mean() > 0.5


# Toxicity.


def test_toxicity(more):
    docs, labels = more
    rows = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (remainder(i, 3) == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in rows.items())
    unseen = [(r["toxic"], rows[r["doc_id"]]) for r in labels.collect() if remainder(r["doc_id"], 3) == 1]
    hits = [r["predicted"] for t, r in unseen if t]
    assert np.mean(hits) > 0.6 and not any(r["predicted"] for t, r in unseen if not t)


def test_toxicity_does_not_leak(more):
    docs, labels = more
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    a = toxicity.scored(docs, labels).collect()
    b = toxicity.scored(docs.drop("source", "lang").repartition(3), changed).collect()
    assert sorted(a) == sorted(b)


def test_toxicity_odd_rows(spark, odd, empty, labels):
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (-5, 0), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.scored(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(empty, labels).count() == 0
    unlabelled = toxicity.scored(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.0}


def test_masked_words():
    reader = toxicity.Reader({"moron": 3.0, "vequ-": 2.0})
    at = toxicity.FEATURES.index
    plain = reader.features(b"what a m0r0n you are, m-o-r-o-n!! VEQUNE")
    assert plain[at("hidden_rate")] > 0 and plain[at("beginnings")] > 0 and plain[at("near_second_person")] > 0.5
    assert not reader.features(b"what a fine day")[: at("second_person_rate")].any()
    assert not reader.features(b"").any() and not reader.features(b" \n").any()


def test_reader_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 50)
    small, large = toxicity.Reader({"w7": 3.0}), None
    monkeypatch.setattr(toxicity, "CACHED", 400_000)
    large = toxicity.Reader({"w7": 3.0})
    texts = [" ".join(f"w{i * 13 + j}" for j in range(n)).encode() for i, n in enumerate((10, 45, 70, 30, 200))]
    monkeypatch.setattr(toxicity, "CACHED", 50)
    got = [small.features(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHED", 400_000)
    assert all((g == large.features(t)).all() for g, t in zip(got, texts))


def test_isotonic_against_brute_force():
    """Pooling equals the least-squares non-decreasing curve (min-max formula)."""
    rng = np.random.default_rng(2)
    raw, y, w = rng.integers(0, 25, 60).astype(float), (rng.random(60) < 0.4).astype(float), rng.random(60) + 0.1
    x, p = toxicity.isotonic(raw, y, w)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()
    levels = np.unique(raw)
    mean = lambda a, b: (lambda m: (y[m] @ w[m]) / w[m].sum())((raw >= a) & (raw <= b))
    best = [max(min(mean(a, b) for b in levels if b >= v) for a in levels if a <= v) for v in levels]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(p, 9))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = toxicity.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.raw(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


# Quality.


def test_quality(more):
    docs, labels = more
    rows = {r["doc_id"]: r for r in quality.graded(docs, labels).collect()}
    assert len(rows) == docs.count()
    unseen = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if remainder(r["doc_id"], 5) == 1]
    assert all(r["held_out"] for _, r in unseen)
    assert np.mean([r["kept"] for q, r in unseen if q]) > 0.98
    assert np.mean([r["tail_probability"] for q, r in unseen if q]) > np.mean([r["tail_probability"] for q, r in unseen if not q]) + 0.2
    kept = quality.good(docs, labels)
    assert kept.schema == docs.schema and 0.7 * len(rows) < kept.count() < len(rows)


def test_quality_odd_rows(odd, empty, labels):
    rows = quality.graded(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["tail_probability"] <= 1 for r in rows)
    assert quality.graded(empty, labels).count() == 0 and quality.good(empty, labels).count() == 0
    assert all(r["expected_grade"] is None and r["kept"] for r in quality.graded(odd, labels.limit(0)).collect())
    assert quality.good(odd, labels).schema == odd.schema
    same = quality.graded(odd, labels.withColumn("quality", F.lit(0))).collect()
    assert {r["expected_grade"] for r in same} == {0.0} and not any(r["kept"] for r in same)


def test_four_grades():
    """One weight per slot orders all grades; thresholds ascend; tails and means follow."""
    rng = np.random.default_rng(4)
    score = rng.integers(0, 8, 3000)
    y = np.digitize(score + rng.logistic(0, 0.5, 3000), [1.5, 3.5, 5.5])
    vectors = [(np.array([int(s), 50 + int(rng.integers(0, 100))]), np.array([1.0, 0.1])) for s in score]
    model = quality.fit(vectors, y, np.ones(3000), [1.0, 2.0, 3.0, 5.0], 1)
    assert (np.diff(model.thresholds) > 0).all()
    margins = np.array([model.margin(*v) for v in vectors])
    expected = model.expected(margins)
    assert np.corrcoef(expected, np.array([1.0, 2.0, 3.0, 5.0])[y])[0, 1] > 0.85
    assert abs((model.tail(margins, 3.0)).mean() - (y >= 2).mean()) < 0.03
    assert (model.tail(margins, 1.0) == 1).all() and (model.tail(margins, 9.0) == 0).all()
