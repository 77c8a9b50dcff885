"""Text quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w . x): one set of hashed weights w for all grades, and ordered
thresholds t_1 < t_2 < ... The grades are whatever values the ratings have. A text's expected grade
and the tail probability P(grade >= wanted) follow; texts whose tail falls below a limit go.

Features, hashed to ``SLOTS`` slots: bare lower-case words, word shapes (letter case, digits and signs
with runs shortened) and bands of some ratios of the whole text. Each group is scaled to length
one. The fit sees a bounded sample of rated texts (``PER_GRADE`` of each grade) weighted back to the
grades' true sizes; scores cover every text as a whole.

Cases: null and empty texts have one feature, "empty"; a document with several ratings counts by the
lowest; null ratings and ids do not train; with one grade in all ratings every text gets it and a
tail of 1 or 0; without ratings the expected grade is null, the tail 1 and nothing goes; equal texts
get equal scores; other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import fold, mapped, uniform, utf8

SLOTS = 1 << 16
#: Rated texts of each grade in the sample, about.
PER_GRADE = 5_000
#: Words whose slots a worker remembers.
CACHED = 400_000
PASSES, BATCH, RATE, PENALTY = 25, 128, 0.3, 1e-5
#: The least tail probability of a text that stays.
LEAST = 0.5

_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_KIND = np.zeros(256, dtype=np.int64)  # 0 letter, 1 capital, 2 digit, 3 space, 4 sign
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[32, 9, 10, 11, 12, 13]] = 3
_KIND[list(_SIGNS)] = 4


def slot(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) % SLOTS


class Reader:
    """Feature vectors of texts; remembers the slots of recent words."""

    def __init__(self) -> None:
        self.place: dict[bytes, tuple[int, int]] = {}

    def slots(self, word: bytes) -> tuple[int, int]:
        shape = _RUN.sub(rb"\1\1", word.translate(_SHAPE))
        return slot(b"w:" + word.lower().strip(_SIGNS)), slot(b"s:" + shape)

    def vector(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values); a slot may stand twice."""
        words = data.split()
        if not words:
            return np.array([slot(b"empty")]), np.ones(1)
        tally = Counter(words)
        if len(self.place) + len(tally) > CACHED:
            self.place.clear()
        places = list(map(self.place.get, tally))
        if None in places:
            if len(tally) > CACHED:
                places = [self.slots(w) for w in tally]
            else:
                self.place.update((w, self.slots(w)) for w, at in zip(tally, places) if at is None)
                places = list(map(self.place.get, tally))
        both = np.array(places)
        n = np.fromiter(tally.values(), dtype=np.float64, count=len(tally))
        shapes, at = np.unique(both[:, 1], return_inverse=True)
        whole = np.array([slot(f"{name}:{band}".encode()) for name, band in self.bands(data, words, tally)])
        parts = [(both[:, 0], np.log1p(n)), (shapes, np.bincount(at, n)), (whole, np.ones(len(whole)))]
        return np.concatenate([s for s, _ in parts]), np.concatenate([v / np.sqrt((v * v).sum()) for _, v in parts])

    @staticmethod
    def bands(data: bytes, words: list[bytes], tally: Counter) -> list[tuple[str, int]]:
        kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=5).astype(np.float64)
        letters, lines = max(1.0, kinds[0] + kinds[1]), data.split(b"\n")
        n = len(words)
        return [
            ("capitals", int(20 * kinds[1] / letters)),
            ("signs", int(40 * kinds[4] / len(data))),
            ("digits", int(20 * kinds[2] / len(data))),
            ("width", min(30, int(letters / n))),
            ("length", int(2 * np.log2(n))),
            ("variety", int(20 * len(tally) / n) + 32 * int(np.log2(n))),
            ("lines", int(10 * len({*lines}) / len(lines))),
            ("most", int(20 * max(tally.values()) / n)),
        ]


_reader: list[Reader] = []


def reader() -> Reader:
    if not _reader:
        _reader.append(Reader())
    return _reader[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than the grades

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[slots] @ values)

    def below(self, margins: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each grade but the last."""
        return sigmoid(self.thresholds[None, :] - margins[:, None])

    def expected(self, margins: np.ndarray) -> np.ndarray:
        below = np.hstack([np.zeros((len(margins), 1)), self.below(margins), np.ones((len(margins), 1))])
        return np.diff(below, axis=1) @ np.array(self.grades)

    def tail(self, margins: np.ndarray, wanted: float) -> np.ndarray:
        """P(grade >= wanted)."""
        lower = sum(g < wanted for g in self.grades)
        if lower == 0:
            return np.ones(len(margins))
        if lower == len(self.grades):
            return np.zeros(len(margins))
        return 1.0 - self.below(margins)[:, lower - 1]


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, grades: list[float], seed: int) -> Model:
    """Maximum likelihood by AdaGrad steps. ``y`` holds places among the grades."""
    kinds = len(grades)
    w, w_sq = np.zeros(SLOTS), np.full(SLOTS, 1e-8)
    share = np.clip(np.cumsum(np.bincount(y, weight, kinds))[:-1] / weight.sum(), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    # The first threshold, and the logarithms of the gaps to the next ones.
    t = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    t_sq = np.full(len(t), 1e-8)
    rng = np.random.default_rng(seed)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))

    for _ in range(PASSES):
        order = rng.permutation(len(vectors))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH].tolist()
            slots = np.concatenate([vectors[i][0] for i in rows])
            values = np.concatenate([vectors[i][1] for i in rows])
            sizes = np.array([len(vectors[i][0]) for i in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            margin = np.bincount(row, w[slots] * values, len(rows))
            level = sigmoid(thresholds()[None, :] - margin[:, None])
            edge = np.hstack([np.zeros((len(rows), 1)), level, np.ones((len(rows), 1))])
            grade, at = y[rows], np.arange(len(rows))
            low, high = edge[at, grade], edge[at, grade + 1]
            p, scale = np.maximum(high - low, 1e-9), weight[rows] / len(rows)
            g_margin = scale * (1.0 - high - low)
            slope = np.hstack([np.zeros((len(rows), 1)), level * (1 - level), np.zeros((len(rows), 1))])
            g_cut = np.bincount(grade + 1, -scale * slope[at, grade + 1] / p, kinds + 1)
            g_cut += np.bincount(grade, scale * slope[at, grade] / p, kinds + 1)
            g_cut = g_cut[1:-1]
            # Each threshold moves with the first one and with every gap before it.
            g_t = np.cumsum(g_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(t[1:])])
            touched, inverse = np.unique(slots, return_inverse=True)
            g = np.bincount(inverse, g_margin[row] * values) + PENALTY * w[touched]
            w_sq[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(w_sq[touched])
            t_sq += g_t * g_t
            t -= 0.1 * g_t / np.sqrt(t_sq)
    return Model(grades, w, thresholds())


def train(
    docs: DataFrame, ratings: DataFrame, id: str = "doc_id", text: str = "text", rating: str = "quality", seed: int = 19
) -> Model | None:
    """A model from the rated texts of ``docs``; None without ratings."""
    rated = ratings.where(F.col(id).isNotNull() & F.col(rating).isNotNull()).groupBy(id).agg(F.min(rating).cast("double").alias("_grade"))
    sizes = {r["_grade"]: r["n"] for r in rated.groupBy("_grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    grades = sorted(sizes)
    share = F.lit(1.0)
    for grade, n in sizes.items():
        share = F.when(F.col("_grade") == grade, F.lit(min(1.0, PER_GRADE / n))).otherwise(share)
    # About PER_GRADE rows of an id and a number for each grade, whatever the tables' sizes.
    chosen = F.broadcast(rated.where(uniform(id, seed=seed) < share))

    def work(batch: pa.RecordBatch) -> dict:
        vectors = [reader().vector(data) for data in batch.column(1).to_pylist()]
        return {
            "grade": batch.column(0),
            "slots": pa.array([s.astype("<i4").tobytes() for s, _ in vectors], pa.binary()),
            "x": pa.array([v.astype("<f4").tobytes() for _, v in vectors], pa.binary()),
        }

    texts = docs.select(F.col(id), utf8(text).alias("_text")).join(chosen, id).select("_grade", "_text")
    rows = mapped(texts, work, "grade double, slots binary, x binary").collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["slots"]), bytes(r["x"])))
    if not rows:
        return None
    y = np.array([grades.index(r["grade"]) for r in rows])
    weight = np.array([sizes[g] for g in grades])[y] / np.bincount(y, minlength=len(grades))[y]
    if len(grades) == 1:
        return Model(grades, np.zeros(SLOTS), np.zeros(0))
    vectors = [(np.frombuffer(r["slots"], dtype="<i4").astype(np.int64), np.frombuffer(r["x"], dtype="<f4").astype(np.float64)) for r in rows]
    return fit(vectors, y, weight / weight.mean(), grades, seed)


def _margins(shared, texts: list[bytes]) -> np.ndarray:
    read = reader()
    return np.array([shared.value.margin(*read.vector(data)) for data in texts])


def graded(
    docs: DataFrame, ratings: DataFrame, id: str = "doc_id", text: str = "text", rating: str = "quality",
    wanted: float = 1.0, least: float = LEAST, folds: int = 5, held: int = 1,
) -> DataFrame:
    """(id, held_out, expected_grade, tail_probability, kept), trained on the rows not held out."""
    held_out = fold(id, folds) == held
    model = train(docs.where(~held_out), ratings.where(~held_out), id, text, rating)
    marked = F.coalesce(held_out, F.lit(False))
    if model is None:
        return docs.select(
            F.col(id), marked.alias("held_out"), F.lit(None).cast("double").alias("expected_grade"),
            F.lit(1.0).alias("tail_probability"), F.lit(True).alias("kept"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        margins = _margins(shared, batch.column(2).to_pylist())
        tail = shared.value.tail(margins, wanted)
        return {
            id: batch.column(0),
            "held_out": batch.column(1),
            "expected_grade": pa.array(shared.value.expected(margins), pa.float64()),
            "tail_probability": pa.array(tail, pa.float64()),
            "kept": pa.array(tail >= least),
        }

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id), marked.alias("_held_out"), utf8(text).alias("_text"))
    schema = f"`{id}` {kind}, held_out boolean, expected_grade double, tail_probability double, kept boolean"
    return mapped(rows, work, schema)


def good(
    docs: DataFrame, ratings: DataFrame, id: str = "doc_id", text: str = "text", rating: str = "quality",
    wanted: float = 1.0, least: float = LEAST,
) -> DataFrame:
    """The rows of ``docs`` whose text reaches the limit, all columns kept."""
    model = train(docs, ratings, id, text, rating)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tail(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.tail(_margins(shared, texts.tolist()), wanted))

    return docs.where(tail(utf8(text)) >= least)
