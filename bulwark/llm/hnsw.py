"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors of one label and width are cut into shards of about ``SHARD`` by a hash, and each shard builds
a graph: layers of geometrically fewer vectors, each vector linked to up to ``LINKS`` (``LOWEST`` in
the lowest layer) near and mutually distant ones. Every vector is searched in every shard of its
label; links are mutual, so one of each two shards asks the other. Beams of many queries advance
together as array operations.

A beam that ends inside the linking distance widens, and all pairs of a group that beams have
connected are checked, so large groups are found whole. An audit compares a seeded sample of the
queries with all vectors of the shard; while fewer than ``RECALL`` of their links are found, all
beams of the two shards double, up to the whole shard. Links are decided by cosine in double
precision.

Equal vectors are searched once and count as often as they occur. Tasks give counts and spanning
edges, never the pairs; components join across shards.

Cases: vectors that are null, empty, zero or hold null or non-finite components, or whose label is
null, link with nothing and stand alone; vectors of different widths never link; repeated rows are
separate vectors; of null ids a group has the smallest other id, or null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import stored
from bulwark.llm.components import components, local_roots

SHARD = 8_192
LINKS, LOWEST = 16, 32
BUILD_BEAM, BEAM = 64, 64
#: How many times its width a beam may grow to before an audit asks for more.
WIDEST = 4
#: Vectors inserted or searched together.
TOGETHER = 512
#: Queries of an audit, and the share of their links that must be found.
AUDIT, RECALL = 128, 0.999
#: What single precision may be off by.
SLACK = 1e-4


def choose(near: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (ids, -1 for none) up to ``most`` near and mutually distant ones.

    A candidate stays if it is nearer to the row's vector than to any kept one; free places go to
    the nearest of the others.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    valid = near >= 0
    vectors = x[np.maximum(near, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    rows, width = near.shape
    closest = np.full((rows, width), -np.inf, dtype=np.float32)
    kept = np.zeros((rows, width), dtype=bool)
    number = np.zeros(rows, dtype=np.int64)
    for j in range(width):
        take = valid[:, j] & (number < most) & (closest[:, j] < sims[:, j])
        kept[take, j] = True
        number += take
        closest[take] = np.maximum(closest[take], between[take, :, j])
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, dtype=np.int32)
    picked = np.take_along_axis(near, first, axis=1)
    out[:, : picked.shape[1]] = picked
    return out


def beams(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of each query's ``width`` best vectors that the graph leads to."""
    n, total = len(queries), len(x)
    width = min(width, total)
    at_once = max(4, width // 32)
    ids = np.full((n, width), -1, dtype=np.int64)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    fresh = np.zeros((n, width), dtype=bool)
    seen = np.zeros((n, total + 1), dtype=bool)
    seen[:, total] = True
    start = min(entry.shape[1], width)
    ids[:, :start] = entry[:, :start]
    sims[:, :start] = np.einsum("nd,nkd->nk", queries, x[entry[:, :start]])
    fresh[:, :start] = True
    np.put_along_axis(seen, entry[:, :start], True, axis=1)
    active = np.arange(n)
    while len(active):
        order = np.where(fresh[active], sims[active], -np.inf)
        step = min(at_once, width)
        picked = np.argpartition(-order, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(order, picked, axis=1) > -np.inf
        going = good.any(axis=1)
        active, picked, good = active[going], picked[going], good[going]
        if not len(active):
            break
        fresh[active[:, None], picked] = False
        from_ = np.where(good, ids[active[:, None], picked], -1)
        found = np.where((from_ >= 0)[:, :, None], links[from_], -1).reshape(len(active), -1)
        found = np.where(found < 0, total, found).astype(np.int64)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = total
        found[seen[active[:, None], found]] = total
        seen[active[:, None], found] = True
        most = max(1, int((found < total).sum(axis=1).max()))
        found.sort(axis=1)
        found = found[:, :most]
        real = found < total
        new = np.einsum("nd,nkd->nk", queries[active], x[np.minimum(found, total - 1)])
        new[~real] = -np.inf
        all_ids = np.hstack([ids[active], np.where(real, found, -1)])
        all_sims = np.hstack([sims[active], new])
        all_fresh = np.hstack([fresh[active], real])
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
        fresh[active] = np.take_along_axis(all_fresh, best, axis=1)
    return ids, sims


class Graph:
    """Layers of links over unit vectors; the highest layer comes first."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int) -> Graph:
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1.0 - rng.random(len(x))) / np.log(LINKS)).astype(np.int64)
        graph = cls(x, [])
        for height in range(int(level.max()), -1, -1):
            members = np.nonzero(level >= height)[0]
            # Higher vectors first: they are the way in for the others.
            members = members[np.argsort(-level[members], kind="stable")]
            graph.layers.append((members, graph._layer(members, LOWEST if height == 0 else LINKS)))
        return graph

    def _layer(self, members: np.ndarray, most: int) -> np.ndarray:
        """Links between the members of one layer, as places in ``members``."""
        x = self.x[members]
        links = np.full((len(members), most), -1, dtype=np.int32)
        done = 0
        while done < len(members):
            size = min(TOGETHER, max(64, done), len(members) - done)
            new = np.arange(done, done + size)
            own = x[new] @ x[new].T
            own[np.arange(size), np.arange(size)] = -np.inf
            width = min(BUILD_BEAM // 2, size)
            top = np.argpartition(-own, width - 1, axis=1)[:, :width]
            near, sims = new[top], np.take_along_axis(own, top, axis=1)
            near = np.where(np.isfinite(sims), near, -1)
            if done:
                entry = self._entries(x[new], members, done)
                ids, found = beams(x[:done], links[:done], x[new], entry, BUILD_BEAM)
                near, sims = np.hstack([ids, near]), np.hstack([found, sims])
            links[new] = choose(near, sims, x, most)
            self._answer(x, links, new, most)
            done += size
        return links

    def _entries(self, queries: np.ndarray, members: np.ndarray, done: int) -> np.ndarray:
        """Where the queries enter a layer of which the first ``done`` members are linked."""
        if not self.layers:
            return np.zeros((len(queries), 1), dtype=np.int64)
        above = self.layers[-1][0]
        found = self.descend(queries, len(self.layers))
        place = np.full(len(self.x), -1, dtype=np.int64)
        place[members] = np.arange(len(members))
        at = place[above[found]]
        return np.where(at < done, at, 0)[:, None]

    def descend(self, queries: np.ndarray, layers: int) -> np.ndarray:
        """The best place in the lowest of the first ``layers`` layers, for each query."""
        at = np.zeros(len(queries), dtype=np.int64)
        for i, (members, links) in enumerate(self.layers[:layers]):
            if i:
                place = np.full(len(self.x), -1, dtype=np.int64)
                place[members] = np.arange(len(members))
                at = place[self.layers[i - 1][0][at]]
            ids, sims = beams(self.x[members], links, queries, at[:, None], 8)
            at = ids[np.arange(len(ids)), sims.argmax(axis=1)]
        return at

    @staticmethod
    def _answer(x: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
        """Link back from the chosen vectors, keeping at most ``most`` links each."""
        to = links[new].ravel()
        from_ = np.repeat(new, links.shape[1])
        real = to >= 0
        to, from_ = to[real], from_[real]
        sims = np.einsum("nd,nd->n", x[to], x[from_])
        order = np.lexsort((-sims, to))
        to, from_ = to[order], from_[order]
        heads = np.concatenate(([0], np.nonzero(np.diff(to))[0] + 1))
        nth = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
        keep = nth < most
        to, from_, nth = to[keep], from_[keep], nth[keep]
        targets, row = np.unique(to, return_inverse=True)
        extra = np.full((len(targets), most), -1, dtype=np.int64)
        extra[row, nth] = from_
        for start in range(0, len(targets), TOGETHER):
            part = targets[start : start + TOGETHER]
            near = np.hstack([links[part].astype(np.int64), extra[start : start + TOGETHER]])
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            s = np.einsum("nd,nkd->nk", x[part], x[np.maximum(near, 0)])
            s[near < 0] = -np.inf
            links[part] = choose(near, s, x, most)

    def within(self, queries: np.ndarray, least: float, width: int, found) -> None:
        """Call ``found(queries, vectors)`` with pairs of similarity at least ``least``.

        A beam that ends inside that similarity goes again, twice as wide, up to WIDEST of it.
        """
        members, links = self.layers[-1]
        place = np.full(len(self.x), -1, dtype=np.int64)
        place[members] = np.arange(len(members))
        for start in range(0, len(queries), TOGETHER):
            at = np.arange(start, min(start + TOGETHER, len(queries)))
            if len(self.layers) > 1:
                entry = place[self.layers[-2][0][self.descend(queries[at], len(self.layers) - 1)]]
            else:
                entry = np.zeros(len(at), dtype=np.int64)
            reach = width
            while len(at):
                ids, sims = beams(self.x[members], links, queries[at], entry[:, None], reach)
                row, column = np.nonzero(sims >= least)
                found(at[row], members[ids[row, column]])
                inside = (sims.min(axis=1) >= least) & (reach < min(len(self.x), WIDEST * width))
                at, entry, reach = at[inside], entry[inside], 2 * reach

    def packed(self) -> dict[str, np.ndarray]:
        out = {"height": np.array(len(self.layers))}
        for i, (members, links) in enumerate(self.layers):
            out |= {f"members{i}": members.astype(np.int32), f"links{i}": links}
        return out


class Shard:
    """A shard's classes of equal vectors with their graph."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, graph: Graph | None = None, seed: int = 0) -> None:
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / self.norms[:, None]).astype(np.float32)
        self.graph = graph or Graph.build(self.unit, seed)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, nodes=self.nodes, copies=self.copies, vectors=self.vectors, **self.graph.packed())
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        shard = cls(z["nodes"], z["copies"], z["vectors"], Graph(np.zeros((0, 0)), []))
        layers = [(z[f"members{i}"].astype(np.int64), z[f"links{i}"]) for i in range(int(z["height"]))]
        shard.graph = Graph(shard.unit, layers)
        return shard


def _verified(a: Shard, b: Shard, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs reach ``least`` by cosine in double precision."""
    keep = np.zeros(len(i), dtype=bool)
    for start in range(0, len(i), 1 << 16):
        s = slice(start, start + (1 << 16))
        dot = np.einsum("nd,nd->n", a.vectors[i[s]], b.vectors[j[s]])
        keep[s] = dot / (a.norms[i[s]] * b.norms[j[s]]) >= least
    return keep


def _roots(links: np.ndarray, same: bool) -> np.ndarray:
    """Group of each class of a (and of b after them, unless it is the same shard)."""
    n_a, n_b = links.shape
    size, shift = (n_a, 0) if same else (n_a + n_b, n_a)
    label = np.arange(size)
    for start in range(0, n_a, TOGETHER):
        i, j = np.nonzero(links[start : start + TOGETHER])
        if len(i):
            own = np.arange(size)
            label = local_roots(size, np.concatenate([i + start, own]), np.concatenate([j + shift, label]))
    return label


def linked(a: Shard, b: Shard, same: bool, least: float, seed: int) -> np.ndarray:
    """Which classes of a and b link, as a matrix; at most SHARD x SHARD flags."""
    sample = np.random.default_rng(seed).permutation(len(a.unit))[:AUDIT]
    i, j = np.nonzero(a.unit[sample] @ b.unit.T >= least - SLACK)
    i = sample[i]
    right = _verified(a, b, i, j, least) & ~((i == j) & same)
    want_i, want_j = i[right], j[right]
    width = BEAM
    links = np.zeros((len(a.unit), len(b.unit)), dtype=bool)

    def found(i: np.ndarray, j: np.ndarray) -> None:
        keep = _verified(a, b, i, j, least)
        links[i[keep], j[keep]] = True

    while True:
        b.graph.within(a.unit, least - SLACK, width, found)
        if same:
            links |= links.T
        _complete(a, b, links, same, least)
        if same:
            np.fill_diagonal(links, False)
        if links[want_i, want_j].sum() >= RECALL * len(want_i) or width >= len(b.unit):
            return links
        width *= 2


def _complete(a: Shard, b: Shard, links: np.ndarray, same: bool, least: float) -> None:
    """Check all pairs of each found group, so that no link inside a group is lost."""
    root = _roots(links, same)
    of_a, of_b = root[: len(a.unit)], root if same else root[len(a.unit) :]
    sizes = np.bincount(root)
    for group in np.nonzero(sizes > 2)[0]:
        rows, columns = np.nonzero(of_a == group)[0], np.nonzero(of_b == group)[0]
        for start in range(0, len(rows), TOGETHER):
            part = rows[start : start + TOGETHER]
            cosine = (a.vectors[part] @ b.vectors[columns].T) / (a.norms[part][:, None] * b.norms[columns][None, :])
            links[np.ix_(part, columns)] = cosine >= least


def _counts_and_edges(a: Shard, b: Shard, same: bool, least: float, seed: int) -> pd.DataFrame:
    """(node, links, root): links of each class with others, and edges that span its group."""
    links = linked(a, b, same, least, seed)
    number = np.concatenate([links[s : s + TOGETHER] @ b.copies for s in range(0, len(links), TOGETHER)])
    nodes = a.nodes
    if not same:
        back = sum(a.copies[s : s + TOGETHER] @ links[s : s + TOGETHER] for s in range(0, len(links), TOGETHER))
        number, nodes = np.concatenate([number, back]), np.concatenate([nodes, b.nodes])
    root = _roots(links, same)
    at = np.nonzero(number)[0]
    text = lambda names: pd.Series([n.decode() for n in names], dtype=object)
    return pd.DataFrame({"node": text(nodes[at]), "links": number[at].astype(np.int64), "root": text(nodes[root[at]])})


def usable(vector: str):
    """Whether a vector can link at all."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def groups(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, seed: int = 23
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``."""
    value = F.col(vector).cast("array<double>")
    # Two 64-bit hashes name a class of equal vectors.
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), F.col("_label"), F.col("_vector"))), 16, "0") for s in (1, 2)])
    rows = vectors.select(F.col(id), F.col(label).alias("_label"), value.alias("_vector"))
    can_link = F.col("_label").isNotNull() & usable("_vector")
    named = rows.withColumn("_node", F.when(can_link, name))
    classes = stored(
        named.where("_node is not null").groupBy("_node").agg(
            F.min(id).alias("least"), F.count(F.lit(1)).alias("copies"),
            F.first("_label").alias("label"), F.first("_vector").alias("vector"),
        ).withColumn("width", F.size("vector")),
        "classes",
    )
    # One row per label and width.
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    dealt = classes.join(sizes, ["label", "width"]).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "_node"), F.col("shards")).cast("int")
    )
    kind = classes.schema["label"].dataType.simpleString()

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_node")
        shard = Shard(part["_node"].to_numpy(dtype="S32"), part["copies"].to_numpy(dtype=np.int64), np.stack(part["vector"].tolist()), seed=seed)
        return pd.DataFrame({"label": [key[0]], "width": [key[1]], "shard": [key[2]], "graph": [shard.pack()]})

    shards = stored(
        dealt.select("label", "width", "shard", "_node", "copies", "vector")
        .groupBy("label", "width", "shard").applyInPandas(build, f"label {kind}, width int, shard int, graph binary"),
        "graphs",
    )
    other = shards.select("label", "width", F.col("shard").alias("other"), F.col("graph").alias("asked"))
    meetings = shards.join(other, ["label", "width"]).where("shard <= other")

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        same = key[2] == key[3]
        asked = Shard.unpack(part["asked"].iloc[0])
        asking = asked if same else Shard.unpack(part["graph"].iloc[0])
        return _counts_and_edges(asking, asked, same, least, seed)

    met = stored(
        meetings.groupBy("label", "width", "shard", "other").applyInPandas(meet, "node string, links long, root string"), "links"
    )
    numbers = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select("node", "root"), "node", "root")
    of_class = stored(
        classes.select(F.col("_node").alias("node"), "least", "copies")
        .join(numbers, "node", "left").join(roots, "node", "left")
        .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "of_class",
    )
    # Stored, so that the join with a large group's rows is one that AQE can split.
    smallest = stored(of_class.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    answers = of_class.join(smallest, "root").select(F.col("node").alias("_node"), "n_links", "component_id")
    component = F.when(F.col("_node").isNull(), F.col(id)).otherwise(F.col("component_id"))
    return named.select(id, "_node").join(answers, "_node", "left").select(
        F.col(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col(id).eqNullSafe(component).alias("kept"),
    )
