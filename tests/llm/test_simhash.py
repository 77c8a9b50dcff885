import re

import numpy as np
import pytest
import xxhash

from bulwark.llm import simhash
from bulwark.llm.components import components, local_roots
from tests.llm.plain import roots


def plain_fingerprint(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, n=4, radius=4):
    """(id, fingerprint, component) by comparing all pairs."""
    prints = np.array([plain_fingerprint(t, n) for _, t in rows], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)
    root = roots(len(rows), i, j)
    least = {}
    for r, (id_, _) in zip(root, rows):
        if id_ is not None:
            least[r] = min(id_, least.get(r, id_))
    return [(id_, f"{int(p):016x}", least.get(r)) for (id_, _), p, r in zip(rows, prints, root)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


def test_documents(documents, texts):
    assert ordered(simhash.groups(documents).collect()) == ordered(plain_groups(list(texts.items())))


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert ordered(simhash.groups(odd).collect()) == ordered(plain_groups(rows))


def test_empty_table(empty):
    assert simhash.groups(empty).count() == 0
    kept = simhash.one_of_each(empty)
    assert kept.count() == 0 and kept.schema == empty.schema


def clustered(seed, clusters, dense):
    rng = np.random.default_rng(seed)
    values = []
    for base in rng.integers(0, 1 << 63, clusters, dtype=np.uint64):
        for _ in range(rng.integers(1, 5)):
            flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64), initial=np.uint64(0))
            values.append(base ^ flips)
    for _ in range(dense):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64), initial=np.uint64(0))
        values.append(values[0] ^ flips)
    return np.unique(np.array(values, dtype=np.uint64))


@pytest.mark.parametrize("shard, cell", [(8192, 32768), (64, 100)])
@pytest.mark.parametrize("radius, blocks", [(4, 1), (4, 3), (4, 5), (5, 3)])
def test_links_are_exact(spark, monkeypatch, shard, cell, radius, blocks):
    """All pairs within the radius, with one shard, many shards and split cells."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "CELL", cell)
    values = clustered(3, 400, 300)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    edges = [(place[r["a"]], place[r["b"]]) for r in simhash.links(table, radius, blocks).collect()]
    got = roots(len(values), np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    assert (got == roots(len(values), i, j)).all()
    assert len(edges) <= 20 * len(values)  # spanning edges, not pairs


def test_one_of_each(documents, texts):
    twice = documents.unionByName(documents)
    kept = simhash.one_of_each(twice)
    want = {id_ for id_, _, component in plain_groups(list(texts.items()), 4, 4) if id_ == component}
    rows = kept.collect()
    assert kept.schema == documents.schema and len(rows) == len(want) and {r["doc_id"] for r in rows} == want


def test_components(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    path = [(1000 + i, 1001 + i) for i in range(60)]
    star = [(5000, 5001 + i) for i in range(500)]
    edges = [*zip(a.tolist(), b.tolist()), *path, *star, (7, 7), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    names = sorted({x for e in edges for x in e if x is not None})
    at = {n: i for i, n in enumerate(names)}
    clean = [(at[x], at[y]) for x, y in edges if x is not None and y is not None]
    root = roots(len(names), np.array([x for x, _ in clean]), np.array([y for _, y in clean]))
    want = {names[i]: names[r] for i, r in enumerate(root) if i != r}
    assert {r["node"]: r["root"] for r in rows} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots_against_plain_ones():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n, m = int(rng.integers(2, 60)), int(rng.integers(0, 50))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        assert (local_roots(n, a, b) == roots(n, a, b)).all()


def test_one_of_each_keeps_rows_that_share_less(spark):
    """Pages of one template, each with its own text: as near as their fingerprints say, no nearer."""
    rng = np.random.default_rng(6)
    shared = [f"t{i}" for i in range(300)]
    lines = [" ".join([*shared, *(f"w{x}" for x in rng.integers(0, 1 << 40, 150))]) for _ in range(150)]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate([*lines, *lines])], "doc_id long, text string")
    want = {id_ for id_, _, component in plain_groups(list(enumerate(lines)), 4, 4) if id_ == component}
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == want
