import math

import numpy as np
import pytest

from bulwark.llm import hnsw
from tests.llm.plain import roots


def plain(rows, least=0.98):
    def usable(v, label):
        return label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, edges, number = len(rows), [], [0] * len(rows)
    vectors = [np.array(r[1], dtype=float) if usable(r[1], r[2]) else None for r in rows]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    edges.append((i, j))
                    number[i] += 1
                    number[j] += 1
    root = roots(n, np.array([i for i, _ in edges], dtype=int), np.array([j for _, j in edges], dtype=int))
    first = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            first[r] = min(row[0], first.get(r, row[0]))
    return sorted((str(row[0]), k, str(first.get(r)), row[0] == first.get(r)) for row, k, r in zip(rows, number, root))


def got(table):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in hnsw.groups(table).collect())


def planted(seed, groups, size, dimensions=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dimensions)
        for _ in range(rng.integers(1, size)):
            v = (centre + rng.normal(scale=rng.choice([0.0, 0.05, 0.12, 0.2]), size=dimensions)).astype(np.float32)
            rows.append((len(rows), v.tolist(), int(g % 3)))
    return rows


@pytest.mark.parametrize("shard", [8192, 60])
def test_planted_groups(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    rows = planted(1, 60, 12) + [(5000 + i, r[1], r[2]) for i, r in enumerate(planted(1, 6, 12))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(table) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (None, [1.0, 0.01], 1), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1),
        (12, [inf, 1.0], 1), (13, [-1.0, 0.0], 1), (None, [0.0, 1.0], 4),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links", "'x' AS least", "2 AS copies")
    assert got(table) == plain(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")) == []


def test_recall_of_the_graph_alone():
    """Beams without the check inside groups find at least 0.98 of the links, and never a wrong one."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 48))
    x = np.vstack([c + rng.normal(scale=0.08, size=(20, 48)) for c in centres] + [rng.normal(size=(1000, 48))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.build(x, 3)
    found = np.zeros((len(x), len(x)), dtype=bool)
    graph.within(x, 0.95, hnsw.BEAM, lambda i, j: found.__setitem__((i, j), True))
    true = x @ x.T >= 0.95
    assert not (found & ~true).any() and found.sum() >= 0.98 * true.sum()
    assert len(graph.layers) > 1 and all(links.shape[1] <= hnsw.LOWEST for _, links in graph.layers)


def test_audit_widens_beams(monkeypatch):
    """With hopeless beams the audit widens them until the links are there."""
    monkeypatch.setattr(hnsw, "BEAM", 1)
    monkeypatch.setattr(hnsw, "WIDEST", 1)
    rows = planted(3, 80, 10)
    x = np.array([r[1] for r in rows], dtype=float)
    shard = hnsw.Shard(np.array([str(i) for i in range(len(x))], dtype="S32"), np.ones(len(x), dtype=np.int64), x, seed=1)
    links = hnsw.linked(shard, shard, True, 0.98, 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = unit @ unit.T >= 0.98
    np.fill_diagonal(true, False)
    assert not (links & ~true).any() and links.sum() >= 0.97 * true.sum()
