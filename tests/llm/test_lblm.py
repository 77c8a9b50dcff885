import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bulwark.llm import lblm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(id_):
    return id_ is not None and zlib.crc32(str(id_).encode()) % 7 == 2


def check(docs, rows):
    counts = Counter()
    for r in docs:
        if not held(r["doc_id"]):
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in docs:
        t = tokens(r["text"])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        want.append((str(r["doc_id"]), held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n, round(base, 5)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_documents(documents):
    rows = lblm.scores(documents).collect()
    check(documents.collect(), rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_many_shards_and_rare_tokens(documents, monkeypatch):
    """Counts found by the join, and averaged shards, give the same base scores."""
    monkeypatch.setattr(lblm, "COMMON", 300)
    monkeypatch.setattr(lblm, "WORDS", 100)
    monkeypatch.setattr(lblm, "SHARD", 700)
    monkeypatch.setattr(lblm, "FAN_IN", 3)
    monkeypatch.setattr(lblm, "HELD", 500)
    rows = lblm.scores(documents).collect()
    check(documents.collect(), rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_odd_rows_and_empty_table(odd, empty):
    check(odd.collect(), lblm.scores(odd).collect())
    assert lblm.scores(empty).count() == 0


def test_probabilities_are_normalised():
    """Every pair of contexts, summed over all classes the slow way."""
    rng = np.random.default_rng(1)
    theta = rng.normal(0, 0.7, (lblm.END_CLASS + 20, 3 * lblm.SIZE + 1))
    tables = lblm.Tables(theta)
    size = len(theta)
    for u, v in rng.integers(0, size, (20, 2)):
        line = np.stack([np.full(size, u), np.full(size, v), np.arange(size)])
        p = [10 ** tables.log10(line[:, w])[0] for w in range(size) if w != lblm.BEGIN]
        assert abs(sum(p) - 1) < 1e-4
        scores = (theta[u, : lblm.SIZE] + theta[v, lblm.SIZE : 2 * lblm.SIZE]) @ theta[:, 2 * lblm.SIZE : 3 * lblm.SIZE].T + theta[:, -1]
        scores = np.delete(scores, lblm.BEGIN)
        assert np.allclose(p, np.exp(scores) / np.exp(scores).sum(), rtol=1e-3)


def test_training_learns_context():
    """Class b always follows class a, and a follows b."""
    a, b = lblm.END_CLASS + 1, lblm.END_CLASS + 2
    p = np.full(lblm.END_CLASS + 3, 0.01)
    p[[a, b]], p[lblm.BEGIN] = 0.4, 0.0
    p /= p.sum()
    line = np.array([a, b] * 40_000, dtype="<u2")
    tables = lblm.Tables(lblm.train_shard(lblm.initial(p, 1), line, lblm.positions(line), p, 2))
    after = lambda u, v, w: 10 ** tables.log10(np.array([u, v, w]))[0]
    assert after(b, a, b) > 0.85 and after(a, b, a) > 0.85 and after(b, a, a) < 0.1


def test_training_steps_equal_a_plain_version(monkeypatch):
    """Two minibatches, one example and one noise class at a time."""
    monkeypatch.setattr(lblm, "BATCH", 7)
    monkeypatch.setattr(lblm, "NOISE", 5)
    rng = np.random.default_rng(5)
    size = lblm.END_CLASS + 6
    p = rng.random(size)
    p[lblm.BEGIN] = 0.0
    p /= p.sum()
    theta = lblm.initial(p, 4)
    line = np.concatenate(([lblm.BEGIN] * 2, rng.integers(lblm.END_CLASS, size, 12))).astype("<u2")
    at = lblm.positions(line)
    got = lblm.train_shard(theta, line, at, p, 9)

    draw = np.random.default_rng(9)
    order = draw.permutation(at)
    n = lblm.SIZE
    P, Q, R, bias = (theta[:, c].copy() for c in (slice(0, n), slice(n, 2 * n), slice(2 * n, 3 * n), slice(3 * n, None)))
    tables = [P, Q, R, bias]
    seen = [np.ones_like(t) for t in tables]
    for start in range(0, len(order), 7):
        noise = [int(np.searchsorted(np.cumsum(p), x, side="right")) for x in draw.random(5)]
        grads = [np.zeros_like(t) for t in tables]
        touched = [set() for _ in tables]
        for i in order[start : start + 7]:
            u, v, w = (int(line[i + k]) for k in range(3))
            h = P[u] + Q[v]
            for c, sign in [(w, 1.0), *((k, 0.0) for k in noise)]:
                score = h @ R[c] + bias[c, 0] - math.log(5 * p[c])
                slope = 1 / (1 + math.exp(-score)) - sign
                for table, row, g in ((0, u, slope * R[c]), (1, v, slope * R[c]), (2, c, slope * h), (3, c, slope)):
                    grads[table][row] += g
                    touched[table].add(row)
        for table, grad, square, rows in zip(tables, grads, seen, touched):
            for row in rows:
                square[row] += grad[row] ** 2
                table[row] -= lblm.RATE * grad[row] / np.sqrt(square[row])
    assert np.allclose(got, np.hstack(tables), atol=2e-5)


@pytest.mark.parametrize("segment", [1, 5, 1 << 16])
def test_every_training_position_is_an_example(spark, documents, texts, monkeypatch, segment):
    """The shards hold each token of each text once, with the two classes before it."""
    monkeypatch.setattr(lblm, "DEALT", 5_000)
    if segment < 100:
        documents = documents.where("n_chars < 300")
    wanted = [r["text"] for r in documents.collect()]
    vocab = lblm.vocabulary(lblm.counts(documents, "text").persist())
    monkeypatch.setattr(lblm, "SEGMENT", segment)
    got = Counter()
    for text in wanted:
        line = np.frombuffer(b"".join(lblm.segments(vocab.classes([*(text or "").encode().lower().split(), lblm.END])[1])), "<u2")
        at = lblm.positions(line)
        got.update(zip(line[at].tolist(), line[at + 1].tolist(), line[at + 2].tolist()))
    want = Counter()
    for text in wanted:
        line = [lblm.BEGIN, lblm.BEGIN, *vocab.classes([*(text or "").encode().lower().split(), lblm.END])[1].tolist()]
        want.update(zip(line, line[1:], line[2:]))
    assert got == want and got.total() == vocab.total


def test_shards_hold_all_positions_and_outweigh_parameters(spark, documents):
    vocab = lblm.vocabulary(lblm.counts(documents, "text").persist())
    rows = lblm._examples(documents, "text", spark.sparkContext.broadcast(vocab), 3, 3).collect()
    places = {s: lblm.positions(np.frombuffer(b"".join(bytes(r["packed"]) for r in rows if r["shard"] == s), "<u2")) for s in range(3)}
    assert sum(map(len, places.values())) == vocab.total
    assert max(map(len, places.values())) < 2 * min(map(len, places.values()))
    assert lblm.SHARD * 2 > 5 * 4 * (3 * lblm.SIZE + 1) * (lblm.END_CLASS + lblm.WORDS + 1)
