"""A log-bilinear language model trained by noise-contrastive estimation, and unigram base scores.

Tokens are lower-cased words and one end per text. Counts cover every training text.

Classes. The ``WORDS`` most frequent tokens are classes of their own; all other tokens fall into
``ENDINGS`` classes by their last two bytes. A token's probability is its class's, given the two
classes before it, times, for a token without a class of its own, its share (c + 1) of the class.

Model. The score of class w after classes u, v is (P[u] + Q[v]) . R[w] + b[w]. Training takes
every training position once. Texts are cut into segments and dealt to shards of about ``SHARD``
positions, far more bytes than the parameters have; a shard is written as one row and read again by
each round. In each of ``ROUNDS`` rounds every shard runs minibatches over its next share of positions
against noise from the unigram distribution, a task adds up the parameters of its shards, and the
mean of all starts the next round. Work and data grow with the corpus; no shard, and no average, does.

Scoring. exp(score) factors into one term per context word, so one matrix product gives the
normalisers of all pairs of context classes at once: Z = exp(P R') (exp(Q R') exp(b))'. Each token's
normalised log-probability is then three lookups. Counts of the ``COMMON`` most frequent tokens
are sent to the tasks (a bound on their number and length); all other tokens of a text find
their counts by a join.

Cases: a null text counts as empty and has one token, its end; null ids count as not held out;
repeated rows are scored and counted each; an empty table gives an empty result, and without
training texts all counts are zero; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import fold, mapped, splitmix, stored, utf8, words

#: Tokens with a class of their own, and classes for the rest.
WORDS = 2_048
ENDINGS = 64
#: Dimensions of the vectors.
SIZE = 32
#: Positions in a shard, about, and in a segment of a text.
SHARD = 3_000_000
SEGMENT = 1 << 16
#: Bytes of segments that a task holds before it passes them on.
DEALT = 8 << 20
ROUNDS = 2
BATCH = 2048
NOISE = 128
RATE = 0.1
#: Tokens whose counts every task holds, and their greatest length in bytes.
COMMON = 100_000
LONGEST = 64
#: Distinct tokens that a counting task holds before it passes them on.
HELD = 250_000
#: Rows averaged at once.
FAN_IN = 16

END = b""
BEGIN = ENDINGS  # the class that stands before a text; never predicted
END_CLASS = ENDINGS + 1
#: Stands before a segment that goes on with a text: no position with it is an example.
SKIP = 0xFFFF


def ending(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % ENDINGS


_ends: dict[bytes, int] = {}


def _ending_table() -> dict[bytes, int]:
    """The class of each possible ending of at most two bytes."""
    if not _ends:
        ones = [bytes([i]) for i in range(256)]
        _ends.update((t, ending(t)) for t in [b"", *ones, *(a + b for a in ones for b in ones)])
    return _ends


def counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, c): how often each token stands in the texts, ends included."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["token", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.update(words(data))
                held[END] += 1
                if len(held) > HELD:
                    yield passed()
        yield passed()

    parts = docs.select(utf8(text).alias("_text")).mapInArrow(count, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What every task knows: the common tokens with their counts and classes, and the classes."""

    def __init__(self, tokens: list[bytes], c: list[int], class_of: list[int], rest: np.ndarray, total: int, kinds: int) -> None:
        self.index = {t: i for i, t in enumerate(tokens)}
        self.count = np.array([*c, 0], dtype=np.int64)
        self.class_of = np.array([*class_of, 0], dtype=np.int32)
        self.rest = rest  # of each ending class: the sum of c + 1 over its tokens, and 1 for an unseen one
        self.total, self.kinds = total, kinds
        self.size = max(END_CLASS, max(class_of, default=0)) + 1

    def classes(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among the common tokens or -1, class) of each token."""
        place = np.fromiter(map(self.index.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        found = self.class_of[place]
        rare = np.nonzero(place < 0)[0]
        ends = _ending_table()
        found[rare] = [ends[tokens[i][-2:]] for i in rare.tolist()]
        return place, found


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The broadcast part of stored counts: at most COMMON tokens of at most LONGEST bytes.

    They are those at or above a count that leaves no more of them, found from the numbers of tokens
    by size of count (a few hundred rows), so no task sends more than what is kept.
    """
    short = counted.where((F.length("token") <= LONGEST) & (F.length("token") > 0))
    size = F.floor(F.log2("c") * 8)
    sizes = short.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for row in sorted(sizes, key=lambda r: -r["size"]):
        held += row["n"]
        if held > COMMON:
            break
        least = row["size"]
    top = [] if least is None else short.where(size >= least).collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["token"])))
    totals = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = counted.where(F.length("token") == 0).agg(F.sum("c")).first()[0] or 0
    tokens = [END, *(bytes(r["token"]) for r in top)]
    own = min(len(tokens), WORDS)
    class_of = [END_CLASS + i if i < own else ending(t) for i, t in enumerate(tokens)]
    rest = np.ones(ENDINGS, dtype=np.float64)
    by_ending = F.crc32(F.expr("substring(token, -2, 2)")) % ENDINGS
    for r in counted.groupBy(by_ending.alias("e")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        rest[r["e"]] += r["s"]
    c = [ends, *(r["c"] for r in top)]
    for token, n in zip(tokens[:own], c[:own]):
        if token != END:
            rest[ending(token)] -= n + 1
    if ends:
        rest[ending(END)] -= ends + 1
    return Vocabulary(tokens, c, class_of, rest, totals[0] or 0, totals[1])


def unigram(vocab: Vocabulary) -> np.ndarray:
    """Smoothed probability of each class; zero for the class before a text."""
    p = np.ones(vocab.size)
    p[:ENDINGS] += vocab.rest - 1
    own = vocab.class_of[:-1] >= END_CLASS
    p[vocab.class_of[:-1][own]] += vocab.count[:-1][own]
    p[BEGIN] = 0.0
    return p / p.sum()


def initial(p: np.ndarray, seed: int) -> np.ndarray:
    """Parameters as one matrix: columns of P, Q and R, then b."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0.0, 0.1, (len(p), 3 * SIZE))
    return np.hstack([vectors, np.log(np.maximum(p, 1e-12))[:, None]])


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sum of their rows; short integers sort by radix."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.concatenate(([0], np.nonzero(np.diff(ids))[0] + 1))
    return ids[starts], np.add.reduceat(rows[order], starts, axis=0)


def positions(line: np.ndarray) -> np.ndarray:
    """Places i of segments that stand one after the other whose (i, i + 1, i + 2) is an example."""
    skip = line == SKIP
    return np.flatnonzero((line[2:] != BEGIN) & ~skip[:-2] & ~skip[1:-1] & ~skip[2:]).astype(np.int32)


def train_shard(theta: np.ndarray, line: np.ndarray, at: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Noise-contrastive estimation over the examples at places ``at`` of a shard.

    AdaGrad steps in single precision; a minibatch shares its noise, so that its gradients are three
    matrix products.
    """
    cuts = [slice(0, SIZE), slice(SIZE, 2 * SIZE), slice(2 * SIZE, 3 * SIZE), slice(3 * SIZE, None)]
    parts = [np.ascontiguousarray(theta[:, c], dtype=np.float32) for c in cuts]
    squares = [np.ones_like(part) for part in parts]
    first, second, out, bias = range(4)
    rng = np.random.default_rng(seed)
    cumulative = np.cumsum(p)
    with np.errstate(divide="ignore"):
        offset = np.log(NOISE * p).astype(np.float32)

    def step(ids: np.ndarray, part: int, gradient: np.ndarray) -> None:
        rows, g = _summed(ids, gradient)
        square = squares[part][rows] + g * g
        squares[part][rows] = square
        parts[part][rows] -= RATE * g / np.sqrt(square)

    order = rng.permutation(at)
    for start in range(0, len(order), BATCH):
        i = order[start : start + BATCH]
        u, v, w = line[i], line[i + 1], line[i + 2]
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE), side="right"), len(p) - 1).astype(line.dtype)
        h = parts[first][u] + parts[second][v]
        r, r_noise = parts[out][w], parts[out][noise]
        true = np.einsum("nd,nd->n", h, r) + parts[bias][w, 0] - offset[w]
        g_true = -1.0 / (1.0 + np.exp(np.clip(true, -30, 30)))
        g_false = h @ r_noise.T
        np.subtract(offset[noise] - parts[bias][noise, 0], g_false, out=g_false)
        with np.errstate(over="ignore"):  # a score far below its offset has no gradient
            np.exp(g_false, out=g_false)
        g_false += 1.0
        np.reciprocal(g_false, out=g_false)
        g_h = g_true[:, None] * r + g_false @ r_noise
        ids = np.concatenate([w, noise])
        step(ids, out, np.vstack([g_true[:, None] * h, g_false.T @ h]))
        step(ids, bias, np.concatenate([g_true, g_false.sum(axis=0)])[:, None])
        step(u, first, g_h)
        step(v, second, g_h)
    return np.hstack(parts)


def segments(classes: np.ndarray) -> Iterator[bytes]:
    """A text's classes as packed segments: after two begins, or after two classes that were there before."""
    line = np.concatenate(([BEGIN, BEGIN], classes)).astype("<u2")
    yield line[: SEGMENT + 2].tobytes()
    for start in range(SEGMENT, len(classes), SEGMENT):
        yield np.concatenate(([SKIP], line[start : start + SEGMENT + 2])).astype("<u2").tobytes()


def _examples(docs: DataFrame, text: str, shared, shards: int, seed: int) -> DataFrame:
    """(shard, packed): segments of all texts, dealt in turn by a hash of their number in the task."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part, number, size = shared.value, TaskContext.get().partitionId(), 0, 0
        held: dict[int, list[bytes]] = {}

        def passed() -> pa.RecordBatch:
            packed = [b"".join(parts) for parts in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array(packed, pa.binary())], names=["shard", "packed"])

        for batch in batches:
            for data in batch.column(0):
                for segment in segments(vocab.classes([*words(data.as_py()), END])[1]):
                    key = np.array([(seed << 56) ^ (part << 32) ^ number], dtype=np.uint64)
                    held.setdefault(int(splitmix(key)[0] % np.uint64(shards)), []).append(segment)
                    number, size = number + 1, size + len(segment)
                    if size >= DEALT:
                        yield passed()
                        held, size = {}, 0
        yield passed()

    return docs.select(utf8(text).alias("_text")).mapInArrow(deal, "shard int, packed binary")


def _together(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(key[0])], "packed": [b"".join(part["packed"].sort_values())]})


def _averaged(rows: DataFrame, shards: int) -> np.ndarray | None:
    """Mean of the parameters, weighted by examples; FAN_IN rows at a time."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, dtype="<f4").astype(np.float64) for v in part["sums"])
        sums = total.astype("<f4").tobytes()
        return pd.DataFrame({"shard": [int(key[0])], "examples": [int(part["examples"].sum())], "sums": [sums]})

    while shards > 1:
        group = F.floor(F.col("shard") / FAN_IN).cast("int").alias("_group")
        rows = rows.groupBy(group).applyInPandas(add, "shard int, examples long, sums binary")
        shards = -(-shards // FAN_IN)
    row = rows.first()
    return None if row is None else np.frombuffer(row["sums"], dtype="<f4").astype(np.float64) / max(row["examples"], 1)


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", seed: int = 3) -> np.ndarray:
    """Parameters of the model, trained on the texts of ``docs``."""
    p = unigram(vocab)
    theta = initial(p, seed)
    if not vocab.total:
        return theta
    shards = max(1, -(-vocab.total // SHARD))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    dealt = _examples(docs, text, shared, shards, seed)
    examples = stored(dealt.groupBy("shard").applyInPandas(_together, "shard int, packed binary"), "examples")

    def fitter(start, round_: int):
        def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, least = np.zeros(start.value.shape), 0, None
            for batch in batches:
                for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    line = np.frombuffer(packed.as_py(), dtype="<u2")
                    # The same order in every round; each round takes its own share of it.
                    at = np.random.default_rng((seed, shard)).permutation(positions(line))[round_::ROUNDS]
                    total += train_shard(start.value, line, at, p, hash((seed, shard, round_)) % (1 << 32)) * len(at)
                    n, least = n + len(at), shard if least is None else min(least, shard)
            if least is not None:
                yield pa.RecordBatch.from_pydict({"shard": pa.array([least], pa.int32()), "examples": [n], "sums": [total.astype("<f4").tobytes()]})

        return fit

    for round_ in range(ROUNDS):
        fit = fitter(docs.sparkSession.sparkContext.broadcast(theta), round_)
        fitted = examples.mapInArrow(fit, "shard int, examples long, sums binary")
        mean = _averaged(stored(fitted, "fitted"), shards)
        if mean is not None and np.isfinite(mean).all() and mean.any():
            theta = mean.reshape(theta.shape)
    return theta


class Tables:
    """Scores and normalisers of all pairs of classes."""

    def __init__(self, theta: np.ndarray) -> None:
        p, q, r, b = theta[:, :SIZE], theta[:, SIZE : 2 * SIZE], theta[:, 2 * SIZE : 3 * SIZE], theta[:, -1].copy()
        b[BEGIN] = -np.inf
        self.first = (p @ r.T).astype(np.float32)
        self.second = (q @ r.T + b).astype(np.float32)
        top_first = self.first.max(axis=1, keepdims=True)
        top_second = self.second.max(axis=1, keepdims=True)
        z = np.exp(self.first - top_first) @ np.exp(self.second - top_second).T
        self.log_z = np.log(z) + top_first + top_second.T

    def log10(self, line: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of every class of a text; ``line`` starts with two begins."""
        u, v, w = line[:-2], line[1:-1], line[2:]
        return (self.first[u, w] + self.second[v, w] - self.log_z[u, v]) / np.log(10.0)


_tables: dict[int, Tables] = {}


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``."""
    spark = docs.sparkSession
    held_out = F.coalesce(fold(id, folds) == held, F.lit(False))
    training = docs.where(~held_out)
    counted = stored(counts(training, text), "counts")
    vocab = vocabulary(counted)
    theta = train(training, vocab, text)
    shared, model = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(theta.astype(np.float32))
    key = hash(theta.tobytes())
    base_of_all = np.log10(vocab.total + vocab.kinds + 1)

    def work(batch: pa.RecordBatch) -> dict:
        known = shared.value
        if key not in _tables:
            _tables.clear()
            _tables[key] = Tables(model.value)
        log10_count = np.log10(known.count + 1.0)
        log10_rest = np.log10(known.rest)
        # All texts of the piece at once: their tokens one after the other, every text ends with END.
        tokens: list[bytes] = []
        sizes = []
        for data in batch.column(2):
            own = words(data.as_py())
            tokens += own
            tokens.append(END)
            sizes.append(len(own) + 1)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place, classes = known.classes(tokens)
        by_count = np.where(place >= 0, log10_count[place], 0.0)
        rare = classes < ENDINGS
        share = np.where(rare, by_count - log10_rest[np.where(rare, classes, 0)], 0.0)
        # Two begins before each text; a position that predicts one belongs to no text.
        line = np.insert(classes, np.repeat(starts, 2), BEGIN)
        model_part = _tables[key].log10(line)[line[2:] != BEGIN].astype(np.float64)
        of_text = lambda x: np.add.reduceat(x, starts)
        n_tokens = np.array(sizes, dtype=np.int64)
        n_known = of_text(((place >= 0) & (known.count[place] > 0)).astype(np.int64))
        base = of_text(by_count) - n_tokens * base_of_all
        score = of_text(model_part + share)
        unknown = np.nonzero(place < 0)[0]
        cuts = np.searchsorted(unknown, [*starts, len(tokens)]).tolist()
        others = [Counter([tokens[i] for i in unknown[a:b].tolist()]) for a, b in zip(cuts, cuts[1:])]
        tokens_of, times_of = [list(o.keys()) for o in others], [list(o.values()) for o in others]
        return {
            id: batch.column(0),
            "held_out": batch.column(1),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()),
            "base": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
            "tokens": pa.array(tokens_of, pa.list_(pa.binary())),
            "times": pa.array(times_of, pa.list_(pa.int64())),
        }

    kind = docs.schema[id].dataType.simpleString()
    schema = (
        f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "tokens array<binary>, times array<long>"
    )
    rows = docs.select(F.col(id), held_out.alias("_held_out"), utf8(text).alias("_text"))
    scored = stored(mapped(rows, work, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    others = scored.select("_row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select(
        "_row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times")
    )
    looked_up = (
        others.join(counted, "token")
        .groupBy("_row")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(looked_up, "_row", "left").select(
        F.col(id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
