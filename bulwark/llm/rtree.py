"""Hard negatives of anchors by STR-packed R-trees over integer vectors.

Rows are dealt by a hash into shards of at most about ``CELLS`` numbers. A shard is sorted-tile-
recursive packed: rows are cut into slabs by label, each slab by the coordinate that varies most,
and so on, into leaves of ``LEAF`` rows; ``FAN`` neighbours make a node of the next level. A node
holds the least and largest value of every coordinate and of the label. For an anchor these give an
interval that the inner product of every row below must lie in: per coordinate the smaller and the
larger of the two end products, added up.

A search takes the node with the highest upper end first. It drops nodes whose interval misses all
score windows, whose labels can't be right, or whose upper end lies strictly below the k-th score of
every window (a tie may still win by its id). It ends when nothing in the queue can matter.

Anchors are a stated query set: they travel in blocks, each block meets every shard once for the
positives and once for the negatives, and only the best few of each shard leave the task. Ranks over
all shards are taken from those. Scores are exact: in double precision while every sum of products
stays below 2^53, in Python's whole numbers beyond.

Cases: rows with a null id, label or vector, or with null or non-finite components (also after
scaling) take no part; an empty vector takes none either. Vectors meet only those of their own
width. Rows that agree in id, label and vector count once. "Other rows" of an anchor are rows with
another id. An anchor without another row of its label, or without a row inside the window, gives no
rows; a window of a negative positive_score is empty. An empty table gives an empty result. Scores
beyond 64 bits are cut to the largest or smallest long in the result, and beyond 38 digits in
comparisons. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.llm.common import stored

#: Numbers in a shard and in a block of anchors, at most about.
CELLS = 1 << 19
BLOCK_CELLS = 1 << 15
#: Rows of a leaf, and nodes below a node.
LEAF = 64
FAN = 16
#: Coordinates by which the rows are tiled, after the label.
TILED = 3
#: Leaves scored together.
LEAVES_AT_ONCE = 8
#: Whole numbers up to this are exact in double precision.
EXACT = 1 << 53
#: Room for the factors of a window's ends.
SPARE = 1 << 7
LONG = (1 << 63) - 1
#: The largest score that travels between tasks.
LARGEST = 10**38 - 1


def _packed(order: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """Leaves by sort-tile-recursion: slabs by the first key, each tiled by the others."""
    if not keys or len(order) <= LEAF:
        return [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    order = order[np.argsort(keys[0][order], kind="stable")]
    leaves = -(-len(order) // LEAF)
    slabs = max(1, round(leaves ** (1 / len(keys))))
    size = -(-leaves // slabs) * LEAF
    return [leaf for i in range(0, len(order), size) for leaf in _packed(order[i : i + size], keys[1:])]


def _whole(numbers: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers, which know no limit."""
    return np.array([int(x) for x in numbers.ravel()], dtype=object).reshape(numbers.shape)


class Tree:
    """Rows of a shard in leaf order, and the boxes of each level from the leaves up."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, codes: np.ndarray, vectors: np.ndarray, starts: np.ndarray) -> None:
        self.ids, self.names, self.codes, self.vectors, self.starts = ids, names, codes, vectors, starts
        self.ends = np.append(starts[1:], len(ids))
        rows = vectors.astype(np.float64)
        level = (
            np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts),
            np.minimum.reduceat(codes, starts), np.maximum.reduceat(codes, starts),
        )
        self.levels = [level]
        while len(level[0]) > 1:
            heads = np.arange(0, len(level[0]), FAN)
            level = tuple(f.reduceat(part, heads) for f, part in zip((np.minimum, np.maximum) * 2, level))
            self.levels.append(level)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        names, codes = np.unique(labels.astype(str), return_inverse=True)
        widest = np.argsort(-vectors.var(axis=0), kind="stable")[:TILED]
        by_id = np.lexsort((ids,))
        leaves = _packed(by_id, [codes, *(vectors[:, d] for d in widest)])
        order = np.concatenate(leaves)
        starts = np.concatenate(([0], np.cumsum([len(leaf) for leaf in leaves])[:-1]))
        return cls(ids[order], names, codes[order].astype(np.int64), vectors[order], starts.astype(np.int64))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, names=self.names, codes=self.codes, vectors=_small(self.vectors), starts=self.starts)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        return cls(z["ids"], z["names"], z["codes"], z["vectors"].astype(np.float64), z["starts"])

    def numbers(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries in a form whose inner products are exact."""
        most = float(np.abs(self.vectors).max(initial=0.0)) * float(np.abs(queries).max(initial=0.0))
        if most * self.vectors.shape[1] * SPARE < EXACT:
            return self.vectors, queries
        return _whole(self.vectors), _whole(queries)

    def intervals(self, queries: np.ndarray, exact: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level: least and largest possible inner product of each query with each node."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = []
        for low, high, _, _ in self.levels:
            if not exact:
                low, high = _whole(low), _whole(high)
            out.append((up @ low.T + down @ high.T, up @ high.T + down @ low.T))
        return out


def _small(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes each, where they fit."""
    if not len(vectors) or np.abs(vectors).max(initial=0) < 1 << 15:
        return vectors.astype(np.int16)
    return vectors


class Wanted:
    """The best ``most`` rows whose score lies in a window: low <= scale * score <= high."""

    def __init__(self, most: int, scale: int = 1, low: int | None = None, high: int | None = None) -> None:
        self.most, self.scale, self.low, self.high = most, scale, low, high
        self.scores: np.ndarray = np.zeros(0)
        self.ids: np.ndarray = np.zeros(0, dtype=np.int64)
        self.kth = None

    def may_hold(self, low, high) -> bool:
        """Whether an interval of scores can still give a row."""
        if self.high is not None and self.scale * low > self.high:
            return False
        return not self.below(high)

    def below(self, high) -> bool:
        """Whether every score up to ``high`` is too small."""
        return (self.low is not None and self.scale * high < self.low) or (self.kth is not None and high < self.kth)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.ones(len(scores), dtype=bool)
        if self.low is not None:
            inside &= (self.scale * scores >= self.low).astype(bool)
        if self.high is not None:
            inside &= (self.scale * scores <= self.high).astype(bool)
        if self.kth is not None:
            inside &= (scores >= self.kth).astype(bool)
        if not inside.any():
            return
        scores = np.concatenate([self.scores.astype(scores.dtype), scores[inside]])
        ids = np.concatenate([self.ids, ids[inside]])
        best = np.lexsort((ids, -scores))[: self.most] if scores.dtype != object else np.array(
            sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.most], dtype=np.int64
        )
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.most:
            self.kth = self.scores[-1]


def search(tree: Tree, label: int, own: int | None, same: bool, query: np.ndarray, rows: np.ndarray, intervals: list, wanted: list[Wanted]) -> int:
    """Fill ``wanted`` from one tree, best node first; gives the number of leaves scored.

    ``intervals`` are this query's rows of ``Tree.intervals``. ``label`` is the anchor's code in the
    tree, -1 if the tree lacks it. ``same`` asks for rows of that label other than ``own``'s, else for
    rows of other labels.
    """
    if same and label < 0:
        return 0
    top = len(tree.levels) - 1
    queue = [(-intervals[top][1][0], top, 0)]
    scored = 0
    while queue:
        leaves = []
        while queue and len(leaves) < LEAVES_AT_ONCE:
            upper, level, node = heapq.heappop(queue)
            if all(w.below(-upper) for w in wanted):
                queue = []  # what is left lies lower still
                break
            _, _, least, most = tree.levels[level]
            if (same and not least[node] <= label <= most[node]) or (not same and least[node] == most[node] == label):
                continue
            low = intervals[level][0][node]
            if not any(w.may_hold(low, -upper) for w in wanted):
                continue
            if level:
                stop = min((node + 1) * FAN, len(tree.levels[level - 1][0]))
                for child in range(node * FAN, stop):
                    heapq.heappush(queue, (-intervals[level - 1][1][child], level - 1, child))
            else:
                leaves.append(node)
        if leaves:
            scored += len(leaves)
            at = np.concatenate([np.arange(tree.starts[leaf], tree.ends[leaf]) for leaf in leaves])
            at = at[(tree.codes[at] == label) & (tree.ids[at] != own) if same else tree.codes[at] != label]
            if len(at):
                scores = rows[at] @ query
                for w in wanted:
                    w.take(scores, tree.ids[at])
    return scored


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def scaled(vectors: DataFrame, by: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector) with whole-numbered components floor(by * x), x in double precision."""
    value = F.col(vector).cast("array<double>")
    whole = F.transform("_v", lambda x: F.when(F.abs(x * by) < float(LONG), F.floor(x * by).cast("double")).otherwise(x * by))
    rows = vectors.select(F.col(id).alias("_id"), F.col(label).alias("_label"), value.alias("_v"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_v")))
    rows = rows.select(F.col("_id").alias("id"), F.col("_label").alias("label"), whole.alias("vector"))
    return rows.where(usable(F.col("vector")))


class Block:
    """Anchors that travel together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scores: list[list[int]] | None = None) -> None:
        self.ids, self.labels, self.vectors, self.scores = ids, labels, vectors, scores

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, labels=self.labels.astype(str), vectors=_small(self.vectors))
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        z = np.load(io.BytesIO(data))
        return cls(z["ids"], z["labels"], z["vectors"].astype(np.float64))


def _meetings(blocks: DataFrame, trees: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every block with every shard of its width, one row each."""
    each = blocks.join(sizes.select("width", "shards"), "width").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)))
    return each.drop("shards").join(trees, ["width", "shard"])


class _Trees:
    """The last tree, as the blocks of a shard follow each other."""

    def __init__(self) -> None:
        self.key, self.tree = None, None

    def get(self, key: tuple, data: pa.Scalar) -> Tree:
        if key != self.key:
            self.key, self.tree = key, Tree.unpack(data.as_py())
        return self.tree


def _searched(meetings: DataFrame, same: bool, most: int, low: int, high: int, scale: int) -> DataFrame:
    """(width, block, at, p, found_id, score): the best rows of each shard for each anchor and window.

    For positives there is one window without ends; for negatives one per positive, from
    ``scores``: arrays of the positives' scores in the order of the block's anchors, as text.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                width, shard, number = (named[k][i].as_py() for k in ("width", "shard", "block"))
                tree = trees.get((width, shard), named["tree"][i])
                block = Block.unpack(named["anchors"][i].as_py())
                scores = None if same else {s["at"]: [int(x) for x in s["scores"]] for s in named["scores"][i].as_py()}
                yield from meet(tree, block, scores, width, number)

    def meet(tree: Tree, block: Block, scores, width: int, number: int) -> Iterator[pa.RecordBatch]:
        rows, queries = tree.numbers(block.vectors)
        intervals = tree.intervals(queries, rows is tree.vectors)
        codes = np.searchsorted(tree.names, block.labels)
        found_label = (codes < len(tree.names)) & (tree.names[np.minimum(codes, len(tree.names) - 1)] == block.labels)
        codes = np.where(found_label, codes, -1)
        out: dict[str, list] = {"at": [], "p": [], "found_id": [], "score": []}
        for at in range(len(block.ids)):
            if same:
                wanted = [Wanted(most)]
            else:
                wanted = [Wanted(most, scale, low * s, high * s) for s in (scores or {}).get(at, [])]
            if not wanted:
                continue
            own = [(a[at], b[at]) for a, b in intervals]
            search(tree, int(codes[at]), block.ids[at], same, queries[at], rows, own, wanted)
            for p, w in enumerate(wanted):
                out["at"] += [at] * len(w.ids)
                out["p"] += [p] * len(w.ids)
                out["found_id"] += w.ids.tolist()
                out["score"] += [str(max(-LARGEST, min(LARGEST, int(s)))) for s in w.scores]
        n = len(out["at"])
        yield pa.RecordBatch.from_pydict(
            {
                "width": pa.array([width] * n, pa.int32()), "block": pa.array([number] * n, pa.int32()),
                "at": pa.array(out["at"], pa.int32()), "p": pa.array(out["p"], pa.int32()),
                "found_id": pa.array(out["found_id"], pa.int64()), "score": pa.array(out["score"], pa.string()),
            }
        )

    found = meetings.mapInArrow(work, "width int, block int, at int, p int, found_id long, score string")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)"))


def _best(found: DataFrame, most: int) -> DataFrame:
    """The best rows over all shards, with their rank from 1."""
    order = Window.partitionBy("width", "block", "at", "p").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100, seed: int = 31
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (id long, label, vector of whole numbers); ``is_anchor`` is a condition on them. An
    anchor's positives are its best rows of the same label, its negatives for each of them the best
    rows of other labels with low * positive <= scale * negative <= high * positive.
    """
    known = stored(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "vector").distinct()
                   .withColumn("width", F.size("vector")), "rows")
    sizes = stored(
        known.groupBy("width").agg(
            F.ceil(F.count(F.lit(1)) * F.col("width") / CELLS).alias("shards"),
            F.ceil(F.count(F.when(is_anchor, 1)) * F.col("width") / BLOCK_CELLS).alias("blocks"),
        ),
        "sizes",
    )
    name = F.xxhash64(F.lit(seed), "id", "label", "vector")
    dealt = known.join(sizes, "width")

    def arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return part["id"].to_numpy(dtype=np.int64), part["label"].to_numpy(dtype=str), np.stack(part["vector"].tolist()).astype(np.float64)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"width": [key[0]], "shard": [key[1]], "tree": [Tree.build(*arrays(part)).pack()]})

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "label"], kind="stable")
        return pd.DataFrame({"width": [key[0]], "block": [key[1]], "anchors": [Block(*arrays(part)).pack()]})

    trees = stored(
        dealt.withColumn("shard", F.pmod(name, F.col("shards")).cast("int")).select("width", "shard", "id", "label", "vector")
        .groupBy("width", "shard").applyInPandas(build, "width int, shard int, tree binary"),
        "trees",
    )
    blocks = stored(
        dealt.where(is_anchor).withColumn("block", F.pmod(name, F.col("blocks")).cast("int")).select("width", "block", "id", "label", "vector")
        .groupBy("width", "block").applyInPandas(gather, "width int, block int, anchors binary"),
        "anchors",
    )
    near = stored(_best(_searched(_meetings(blocks, trees, sizes), True, positives, 0, 0, 1), positives), "positives")
    # At most ``positives`` scores of at most BLOCK_CELLS / width anchors.
    of_anchor = near.groupBy("width", "block", "at").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").cast("string").alias("s")))).alias("s"))
    of_block = of_anchor.groupBy("width", "block").agg(F.collect_list(F.struct("at", F.col("s.s").alias("scores"))).alias("scores"))
    asking = blocks.join(of_block, ["width", "block"])
    found = _best(_searched(_meetings(asking, trees, sizes), False, negatives, low, high, scale), negatives)
    key = ["width", "block", "at"]

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = Block.unpack(data).ids
                yield pa.RecordBatch.from_pydict(
                    {
                        "width": pa.array([width] * len(own), pa.int32()), "block": pa.array([block] * len(own), pa.int32()),
                        "at": pa.array(range(len(own)), pa.int32()), "anchor_id": pa.array(own, pa.int64()),
                    }
                )

    anchors = blocks.select("width", "block", "anchors").mapInArrow(ids, "width int, block int, at int, anchor_id long")
    positive = near.select(*key, (F.col("rank") - 1).alias("p"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive"))
    limit = lambda c: F.greatest(F.least(c, F.lit(LONG)), F.lit(-LONG - 1)).cast("long")
    return (
        found.join(positive, [*key, "p"]).join(anchors, key)
        .select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"),
                limit(F.col("positive")).alias("positive_score"), limit(F.col("score")).alias("negative_score"))
    )
