import hashlib
from collections import Counter

import numpy as np
import pytest

from bulwark.llm import weighted_sampling
from bulwark.llm.common import splitmix


def jaccard(a, b):
    a, b = (Counter((x or "").encode().lower().split()) for x in (a, b))
    terms = {*a, *b}
    return sum(min(a[t], b[t]) for t in terms) / max(1, sum(max(a[t], b[t]) for t in terms))


def plain(rows):
    """(id, n_chars, sha, edited text, next text) in descending order of ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for (id_, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        text, follower = text or "", follower or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follower[:third]
        out.append((id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, follower))
    return out


@pytest.mark.parametrize("size", [500, 7])
def test_documents(documents, texts, monkeypatch, size):
    """Places across ranges of any size; likeness near the true similarity."""
    monkeypatch.setattr(weighted_sampling, "RANGE", size)
    rows = {r["doc_id"]: r for r in weighted_sampling.digests(weighted_sampling.edited(documents)).collect()}
    want = plain(list(texts.items()))
    assert len(rows) == len(want)
    off = []
    for id_, n_chars, sha, text, edited, follower in want:
        r = rows[id_]
        assert (r["n_chars"], r["edited_sha256"]) == (n_chars, sha)
        off += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, follower)]
    assert np.abs(off).max() < 0.25 and np.sqrt(np.mean(np.square(off))) < 0.06
    by_text = {}
    for id_, text in texts.items():
        assert by_text.setdefault(text, rows[id_]["fingerprint"]) == rows[id_]["fingerprint"]


def test_odd_rows(odd):
    rows = weighted_sampling.digests(weighted_sampling.edited(odd)).collect()
    want = plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(key, rows)) == sorted(map(key, want))
    blank = {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1


def test_empty_and_single(empty, odd):
    assert weighted_sampling.edited(empty).count() == 0
    assert weighted_sampling.fingerprints(empty).count() == 0
    single = weighted_sampling.edited(odd.where("doc_id = -5")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_collision_rate_is_the_similarity(monkeypatch):
    """60,000 slots instead of 128."""
    monkeypatch.setattr(weighted_sampling, "_SLOTS", splitmix(np.arange(60_000, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)))
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(3):
        a, b = (rng.integers(0, 6, 60) * rng.integers(0, 2, 60) for _ in range(2))
        a[0], b[0] = 40, 25
        sign = lambda w: weighted_sampling.draws(terms[w > 0], w[w > 0].astype(float)).min(axis=0).view(np.uint64) & np.uint64(0xFFFF)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sign(a) == sign(b)).mean() - true) < 0.01


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(weighted_sampling, "CACHED", 5_000)
    signer = weighted_sampling.Signer()
    texts = [" ".join(f"w{i * 700 + j}" for j in range(900)).encode() for i in range(12)]
    first = signer.signatures(texts)
    assert len(signer.place) <= 5_000
    assert (first == signer.signatures(texts)).all()
    assert (first == weighted_sampling.Signer().signatures(texts)).all()
