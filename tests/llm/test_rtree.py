import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bulwark.llm import rtree


def plain(rows, is_anchor, positives=5, negatives=10):
    """All pairs, by the rule. rows: (id, label, tuple of whole numbers)."""
    rows = sorted(set(rows))
    out = []
    for a, label, q in rows:
        if not is_anchor(a):
            continue
        score = lambda v: sum(int(x) * int(y) for x, y in zip(q, v))
        others = sorted((-score(v), i, lab) for i, lab, v in rows if i != a and len(v) == len(q))
        for s, p, _ in [o for o in others if o[2] == label][:positives]:
            window = [(t, i) for t, i, lab in others if lab != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(rows):
    found = rtree.hard_negatives(rows, F.col("id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def listed(frame):
    return [(r["id"], str(r["label"]), tuple(r["vector"])) for r in frame.collect()]


def test_embeddings(spark, data_dir):
    vectors = spark.read.parquet(f"{data_dir}/embeddings.parquet").withColumn("label", F.col("label") % 3)
    rows = rtree.scaled(vectors)
    assert rows.first()["vector"] == [float(math.floor(256 * x)) for x in vectors.first()["embedding"]]
    got = mined(rows)
    assert got and got == plain(listed(rows), lambda i: i % 100 == 0)


@pytest.mark.parametrize("cells", [60, 500])
def test_many_shards_and_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(rtree, "CELLS", cells)
    monkeypatch.setattr(rtree, "BLOCK_CELLS", cells // 10)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(0, 2400, 4)]
    got = mined(spark.createDataFrame(rows, "id long, label int, vector array<double>"))
    assert got == plain([(i, str(lab), tuple(v)) for i, lab, v in rows], lambda i: i % 100 == 0)


def test_ties_hot_vectors_and_repeated_rows(spark):
    """A third of all rows hold one vector; ids decide. Rows come twice; ids may repeat."""
    rows = [(i, i % 2, [3.0, 1.0]) for i in range(200)] + [(i, i % 3, [float(i % 5), 2.0]) for i in range(150, 600)]
    got = mined(spark.createDataFrame(rows + rows[::7], "id long, label int, vector array<double>"))
    assert got == plain([(i, str(lab), tuple(v)) for i, lab, v in rows], lambda i: i % 100 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (0, 1, [0.5, 0.5], "x", 1), (1, 1, [0.6, 0.5], "x", 1), (2, 2, [0.3, 0.2], "x", 1), (3, 2, [0.1, 0.3], "x", 1), (4, None, [0.4, 0.4], "x", 1),
        (5, 2, None, "x", 1), (6, 2, [0.4, None], "x", 1), (7, 2, [0.4, nan], "x", 1), (8, 2, [inf, 0.4], "x", 1), (9, 2, [], "x", 1),
        (10, 2, [0.4, 0.4, 0.4], "x", 1), (None, 2, [0.4, 0.4], "x", 1), (100, 1, [-0.5, -0.5], None, None), (200, 3, [0.2, 0.2, 0.2], None, 3),
        (300, 3, [0.0, 0.0], None, 3), (301, 3, [0.0, 0.0], None, 3), (302, 2, [1e308, 0.0], None, 3),
    ]
    frame = spark.createDataFrame(odd, "vec_id long, label int, embedding array<double>, rank string, shard int")
    rows = rtree.scaled(frame)
    assert {r["id"] for r in rows.collect()} == {0, 1, 2, 3, 10, 100, 200, 300, 301}
    got = mined(rows)
    assert got == plain(listed(rows), lambda i: i % 100 == 0)
    assert {r[0] for r in got} == {0, 300}
    assert mined(rtree.scaled(frame.where("vec_id < 0"))) == []
    assert mined(rtree.scaled(frame.where("vec_id = 0"))) == []


def test_large_numbers_stay_exact(spark):
    big = 1 << 40
    rows = [(0, 1, [float(big), 1.0]), (1, 1, [float(big), 3.0]), (2, 1, [float(big), 2.0]), *((i, 2, [float(big // 2), float(i)]) for i in range(3, 20))]
    frame = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    limit = (1 << 63) - 1
    want = [(*r[:4], min(r[4], limit), min(r[5], limit)) for r in plain([(i, str(lab), tuple(v)) for i, lab, v in rows], lambda i: i == 0)]
    assert mined(frame) == want and want[0][1] == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 400), st.integers(1, 6))
def test_boxes_hold_their_rows(seed, n, width):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-20, 21, (n, width)).astype(float)
    tree = rtree.Tree.unpack(rtree.Tree.build(np.arange(n), rng.integers(0, 4, n), vectors).pack())
    assert sorted(tree.ids.tolist()) == list(range(n))
    query = rng.integers(-20, 21, (1, width)).astype(float)
    scores = (tree.vectors @ query.T).ravel()
    below = [np.arange(a, b) for a, b in zip(tree.starts, tree.ends)]
    assert max(map(len, below)) <= rtree.LEAF
    for (low, high), (_, _, least, most) in zip(tree.intervals(query, True), tree.levels):
        for node, rows in enumerate(below):
            assert low[0][node] <= scores[rows].min() and scores[rows].max() <= high[0][node]
            assert least[node] <= tree.codes[rows].min() and tree.codes[rows].max() <= most[node]
        below = [np.concatenate(below[i : i + rtree.FAN]) for i in range(0, len(below), rtree.FAN)]


def test_search_prunes_in_few_dimensions():
    """With boxes that tell rows apart, the queue ends long before all leaves are scored."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-500, 501, (8192, 3)).astype(float)
    tree = rtree.Tree.build(np.arange(8192), np.zeros(8192, dtype=int), vectors)
    query = np.array([[300.0, -200.0, 100.0]])
    wanted = [rtree.Wanted(5)]
    own = [(a[0], b[0]) for a, b in tree.intervals(query, True)]
    scored = rtree.search(tree, 0, None, True, query[0], tree.vectors, own, wanted)
    best = np.lexsort((np.arange(8192), -(vectors @ query[0])))[:5]
    assert wanted[0].ids.tolist() == best.tolist()
    assert scored < len(tree.starts) / 4
