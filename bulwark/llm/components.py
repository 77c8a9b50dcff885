"""Connected components of an edge table by alternating large and small stars.

Every round is stored in the shared folder. A node with very many edges (the centre of a star)
only takes part in a map-side minimum and in a join that AQE can split. The number of rounds
grows with the logarithm of the longest path; edges that arrive as stars need two or three.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import stored

ROUNDS = 100


def _signature(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node but the smallest of its component, with that smallest node.

    Edges may repeat, point either way or be loops; null ends are ignored. No edges give no rows.
    """
    pairs = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before = _signature(pairs)
    for _ in range(ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        pairs = stored(small.distinct(), "stars")
        now = _signature(pairs)
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``size`` nodes, inside one task.

    Only roots are hooked, to the smallest root that an edge shows them; their nodes follow. Edges
    between different roots stay until none is left.
    """
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label
