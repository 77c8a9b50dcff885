import re
from collections import defaultdict
from fractions import Fraction

import pytest

from bulwark.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    full, open_ = {}, set(order)
    while True:
        rest = total - sum(full.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {**full, **{s: weight[s] * level for s in open_}}
        full |= {s: Fraction(2 * sizes[s]) for s in above}
        open_ -= above


def check(docs, rows, block=8):
    sizes, count = defaultdict(int), 0
    for d in docs:
        sizes[d["source"]] += size(d["text"])
        count += 1
    targets = water_fill(sizes)
    source_of = {d["doc_id"]: d["source"] for d in docs}
    assert len(rows) == count
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    for source, target in targets.items():
        own = [r for r in rows if r["doc_id"] is not None and source_of[r["doc_id"]] == source]
        if any(d["doc_id"] is None and d["source"] == source for d in docs):
            continue
        assert all(abs(r["target"] - float(target)) < 1e-6 and r["source_size"] == sizes[source] for r in own)
        # A block at the source's share and one at each shard's end.
        shards = -(-len(own) // mixing.SHARD)
        assert abs(sum(r["taken"] for r in own) - target) <= block * (1 + shards)


def test_documents(documents):
    rows = mixing.taken(documents).collect()
    check(documents.collect(), rows)
    assert sorted(rows) == sorted(mixing.taken(documents.repartition(7)).collect())


def test_small_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 3)
    check(documents.collect(), mixing.taken(documents).collect())


def test_groups_of_shards(documents, monkeypatch):
    """Apportionment in two levels, with more groups than one per source."""
    monkeypatch.setattr(mixing, "SHARD", 2)
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = mixing.taken(documents).collect()
    check(documents.collect(), rows)
    assert sorted(rows) == sorted(mixing.taken(documents.repartition(5)).collect())


def test_odd_rows(odd):
    rows = mixing.taken(odd).collect()
    check(odd.collect(), rows)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)


def test_empty_table(empty):
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("weights, seats", [([5, 3, 1], 9), ([1, 1, 1], 4), ([100, 1, 0], 7), ([7.5, 2.5, 9.25, 0.1], 31)])
def test_highest_quotients(spark, weights, seats):
    """Against giving seats one by one."""
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    parties = spark.createDataFrame([(i, float(w), seats) for i, w in enumerate(weights)], "name int, w double, seats long")
    rows = mixing.apportion(parties, [], "name", "w", "seats", "quota").collect()
    assert [r["quota"] for r in sorted(rows)] == won


def test_mix_keeps_columns_and_words(documents):
    mixed = mixing.mix(documents, block=16)
    assert mixed.schema == documents.schema
    words, sizes = defaultdict(int), {d["doc_id"]: (d["source"], d["text"]) for d in documents.collect()}
    for r in mixed.collect():
        source, text = sizes[r["doc_id"]]
        words[source] += size(r["text"])
        assert r["text"] == text or r["n_chars"] == len(r["text"])
        assert r["text"] == text or all(part in text for part in r["text"].split("\n") if part)
    totals = defaultdict(int)
    for source, text in sizes.values():
        totals[source] += size(text)
    for source, target in water_fill(totals).items():
        assert abs(words[source] - target) <= 16 * 3


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert rows and all(size(r["text"]) for r in rows)


def test_cut():
    assert mixing.cut("a b  c d", [{"a": 0, "b": 4}]) == "a b  c d"
    assert mixing.cut("a b  c d", [{"a": 0, "b": 1}, {"a": 1, "b": 2}, {"a": 3, "b": 4}]) == "a b\nd"
    assert mixing.cut("a", []) is None
