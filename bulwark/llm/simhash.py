"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints. A bit is 1 if it is set in more than half of the XXH64 values (seed 42) of the
text's word shingles, repeats included.

Search. Two fingerprints within ``radius`` bits differ by at most ``radius // blocks`` bits in one
of ``blocks`` groups of bits, so each group gets a vantage-point tree of its own: a node sends
fingerprints within its radius of its vantage point inside, the rest outside, by their distance in
that group. A tree from a bounded sample of distinct fingerprints deals all of them to shards. A
query also visits each shard whose region its ball overlaps by the triangle bound; pairs are
symmetric, so only shards after its own. Inside a shard smaller trees prune by the same bound and
the pairs left are compared over all 64 bits. The result is exact: all pairs within the radius.

Shards that hold more than ``CELL`` fingerprints (many close together) are cut into cells of
bounded size, so no task takes a whole group. Tasks give spanning edges, never all pairs, and
copies count once: only distinct fingerprints are searched.

Cases: null or empty texts, or texts of white space, have fingerprint zero and link like any
other; texts shorter than a shingle are one shingle; repeated rows and ids are kept row by row; a
null id never names a group unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import mapped, numbered, stored, uniform, utf8, words
from bulwark.llm.components import components, local_roots

SEED = 42
BITS = 64
#: Distinct fingerprints that the top trees are built from.
SAMPLE = 16_384
#: Fingerprints in a shard, about, and the most that one cell of a shard takes.
SHARD = 8_192
CELL = 32_768
#: Pairs compared at once where a tree cannot split further.
LEAF = 1 << 14


def _digests(data: bytes, shingle: int) -> Iterator[bytes]:
    """XXH64 of each word shingle of UTF-8 bytes, 8 bytes each, block by block."""
    tokens = words(data)
    if not tokens:
        return
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(shingle, len(tokens)) - 1 :]
    starts = starts[: len(ends)]
    digest = xxhash.xxh64_digest
    for at in range(0, len(ends), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())
        yield b"".join([digest(line[a:b], SEED) for a, b in spans])


def _majority(blocks: list[bytes] | Iterator[bytes]) -> int:
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for packed in blocks:
        total += np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        n += len(packed) // 8
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint(data: bytes, shingle: int) -> int:
    """The 64-bit fingerprint of UTF-8 bytes."""
    return _majority(_digests(data, shingle))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit integer, row by row."""

    def work(batch: pa.RecordBatch) -> dict:
        values = [fingerprint(data, shingle) for data in batch.column(len(keep)).to_pylist()]
        kept = {name: batch.column(i) for i, name in enumerate(keep)}
        return kept | {"fp": pa.array(np.array(values, dtype=np.uint64).view(np.int64))}

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(docs.select(*keep, utf8(text).alias("_text")), work, f"{kinds}, fp long")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def masks(blocks: int) -> list[np.uint64]:
    """The bits cut into ``blocks`` groups of nearly equal size."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def _distances(values: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ vantage) & mask)


def _vantage(values: np.ndarray, mask: np.uint64, radius: int, rng: np.random.Generator):
    """(vantage point, radius inside) that leaves fewest values near the border; None if no split."""
    best = None
    probe = values if len(values) <= 512 else rng.choice(values, 512, replace=False)
    for vantage in rng.choice(values, min(6, len(values)), replace=False):
        distance = np.sort(_distances(probe, vantage, mask))
        inside = int(distance[(len(distance) - 1) // 2])
        if inside == distance[-1]:
            inside -= 1
        share = float((distance <= inside).mean())
        if not 0.1 <= share <= 0.9:
            continue
        near = float(((distance > inside - radius) & (distance <= inside + radius)).mean())
        if best is None or near < best[0]:
            best = (near, vantage, inside)
    return best and best[1:]


@dataclass
class Node:
    vantage: np.uint64 = np.uint64(0)
    inside: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


class Tree:
    """A vantage-point tree whose leaves are numbered from the left."""

    def __init__(self, values: np.ndarray, mask: np.uint64, radius: int, leaves: int, seed: int) -> None:
        self.mask, self.radius, self.size = mask, radius, 0
        rng = np.random.default_rng(seed)
        smallest = max(8, len(values) // max(1, leaves))

        def grow(part: np.ndarray) -> Node:
            split = _vantage(part, mask, radius, rng) if len(part) >= 2 * smallest else None
            if split is None:
                self.size += 1
                return Node(leaf=self.size - 1)
            inside = _distances(part, split[0], mask) <= split[1]
            return Node(split[0], split[1], grow(part[inside]), grow(part[~inside]))

        self.root = grow(values)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, leaves, home): each value's own leaf, and later leaves its ball overlaps."""
        rows, leaves = [], []
        home = np.empty(len(values), dtype=np.int32)

        def go(node: Node, at: np.ndarray, own: np.ndarray) -> None:
            if not len(at):
                return
            if node.leaf >= 0:
                home[at[own]] = node.leaf
                rows.append(at)
                leaves.append(np.full(len(at), node.leaf, dtype=np.int32))
                return
            distance = _distances(values[at], node.vantage, self.mask).astype(np.int64)
            inside = distance <= node.inside
            near_in = distance <= node.inside + self.radius
            near_out = distance > node.inside - self.radius
            go(node.left, at[near_in], (own & inside)[near_in])
            go(node.right, at[near_out], (own & ~inside)[near_out])

        go(self.root, np.arange(len(values)), np.ones(len(values), dtype=bool))
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        keep = leaf >= home[row]
        return row[keep], leaf[keep], leaf[keep] == home[row[keep]]


def close_pairs(
    data: np.ndarray, queries: np.ndarray, mask: np.uint64, near: int, radius: int, found: Callable
) -> None:
    """Call ``found(data positions, query positions)`` for pairs within ``radius`` of 64 bits.

    ``near`` bounds their distance inside ``mask``; trees prune by it.
    """
    rng = np.random.default_rng(len(data))

    def compare(d: np.ndarray, q: np.ndarray) -> None:
        step = max(1, LEAF * 16 // max(1, len(d)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            hits = np.bitwise_count(queries[part][:, None] ^ data[d][None, :]) <= radius
            i, j = np.nonzero(hits)
            if len(i):
                found(d[j], part[i])

    def go(d: np.ndarray, q: np.ndarray) -> None:
        if not len(d) or not len(q):
            return
        split = None if len(d) * len(q) <= LEAF or len(d) < 32 else _vantage(data[d], mask, near, rng)
        if split is None:
            compare(d, q)
            return
        from_d = _distances(data[d], split[0], mask).astype(np.int64)
        from_q = _distances(queries[q], split[0], mask).astype(np.int64)
        go(d[from_d <= split[1]], q[from_q <= split[1] + near])
        go(d[from_d > split[1]], q[from_q > split[1] - near])

    go(np.arange(len(data)), np.arange(len(queries)))


def spanning_edges(cell: pd.DataFrame, mask: np.uint64, near: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smaller value of its group) that connect the linked values of one cell."""
    values, inverse = np.unique(cell["fp"].to_numpy().view(np.uint64), return_inverse=True)
    is_data = cell["data"].to_numpy()
    data, queries = np.unique(inverse[is_data]), np.unique(inverse[~is_data])
    label = np.arange(len(values))
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal label, waiting
        if kept:
            a = np.concatenate([x for x, _ in kept] + [np.arange(len(values))])
            b = np.concatenate([y for _, y in kept] + [label])
            label = local_roots(len(values), a, b)
            kept.clear()
            waiting = 0

    def found(d: np.ndarray, q: np.ndarray) -> None:
        nonlocal waiting
        kept.append((data[d], queries[q]))
        waiting += len(d)
        if waiting > 1 << 20:
            settle()

    close_pairs(values[data], values[queries], mask, near, radius, found)
    settle()
    child = np.nonzero(label != np.arange(len(values)))[0]
    return values[child].view(np.int64), values[label[child]].view(np.int64)


def links(distinct: DataFrame, radius: int = 4, blocks: int = 3, seed: int = 7) -> DataFrame:
    """(a, b): edges that connect all fingerprints of ``distinct(fp)`` within ``radius`` bits."""
    groups = masks(blocks)
    near = radius // blocks
    total = distinct.count()
    share = min(1.0, SAMPLE / max(1, total))
    # About SAMPLE values, whatever the table's size.
    sample = distinct.where(uniform("fp", seed=seed) < share).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    trees = [Tree(np.sort(sample), m, near, -(-total // SHARD), seed + i) for i, m in enumerate(groups)]

    def route(batch: pa.RecordBatch) -> dict:
        values = batch.column(0).to_numpy().view(np.uint64)
        out = [(i, *tree.route(values)) for i, tree in enumerate(trees)]
        return {
            "block": pa.array(np.concatenate([np.full(len(r), i, dtype=np.int32) for i, r, _, _ in out])),
            "leaf": pa.array(np.concatenate([leaf for _, _, leaf, _ in out])),
            "home": pa.array(np.concatenate([home for _, _, _, home in out])),
            "fp": pa.array(np.concatenate([values[r] for _, r, _, _ in out]).view(np.int64)),
        }

    routed = stored(mapped(distinct.select("fp"), route, "block int, leaf int, home boolean, fp long"), "routed")
    # One row per leaf of the sampled trees: bounded by SAMPLE.
    counts = routed.groupBy("block", "leaf").agg(F.count(F.lit(1)).alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("int").alias("parts")
    sized = routed.join(F.broadcast(counts.select("block", "leaf", parts)), ["block", "leaf"])
    part = F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = sized.select("block", "leaf", "home", "fp", part.alias("part"), every.alias("every"))
    # Cell (i, j) compares the leaf's own values of part i with the queries of part j. Two values
    # of the same leaf meet in one cell only.
    as_data = cells.where("home").select(
        "block", "leaf", F.col("part").alias("i"), F.explode("every").alias("j"), "fp", F.lit(True).alias("data")
    )
    as_query = cells.select(
        "block", "leaf", "home", F.explode("every").alias("i"), F.col("part").alias("j"), "fp"
    ).where("not home or i <= j").select("block", "leaf", "i", "j", "fp", F.lit(False).alias("data"))

    def search(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_edges(cell, groups[int(key[0])], near, radius)
        return pd.DataFrame({"a": a, "b": b})

    met = as_data.unionByName(as_query)
    return met.groupBy("block", "leaf", "i", "j").applyInPandas(search, "a long, b long")


def _grouped(marked: DataFrame, id: str, radius: int) -> DataFrame:
    """``marked`` with ``root`` (the group's name) and ``component_id`` (its smallest id)."""
    classes = stored(marked.groupBy("fp").agg(F.min(id).alias("_least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = stored(
        classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
            "fp", "_least", F.coalesce("root", "fp").alias("root")
        ),
        "named",
    )
    # Stored, so that the join with a large group's rows is one that AQE can split.
    least = stored(named.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    return marked.join(named.select("fp", "root").join(least, "root"), "fp")


def groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``; texts are read once."""
    marked = stored(fingerprints(docs, [id], text, shingle), "fingerprints")
    return _grouped(marked, id, radius).select(id, hex_digits().alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest id.

    Groups are those of :func:`groups`. Rows are told apart by two hashes of all their columns, so of
    equal rows one stays. All columns are kept as they are, whatever their names.
    """
    plain, name = numbered(docs)
    row = ["row1", "row2"]
    keyed = plain.withColumns({r: F.xxhash64(F.lit(i), *plain.columns) for i, r in enumerate(row)})
    marked = stored(fingerprints(keyed, [name[id], *row], name[text], shingle), "fingerprints")
    by_id = F.struct(F.col(name[id]).isNull().alias("none"), F.col(name[id]).alias("id"), *row)
    first = _grouped(marked, name[id], radius).groupBy("root").agg(F.min(by_id).alias("first"))
    kept = first.select(*[F.col(f"first.{r}").alias(r) for r in row])
    return keyed.join(kept, row, "left_semi").dropDuplicates(row).drop(*row).toDF(*docs.columns)
