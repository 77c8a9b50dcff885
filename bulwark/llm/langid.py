"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are n-grams of 1 to ``GRAMS`` code points of the lower-cased text, hashed to ``SLOTS`` slots,
weighted (1 + log tf) x idf and scaled to length one. Document frequencies cover every training text.
Weights come from follow-the-regularised-leader steps with L1 and L2 penalties, so most are zero,
over a bounded sample of labelled texts (``PER_LABEL`` for each language); a part of the sample,
kept out of the steps, sets one temperature that calibrates the probabilities.

Cases: a text that is null or has no letter is ``und`` with score 0; null languages, and null ids,
never train; a single language, or none, gives that language with score 1, or ``und`` with 0; texts of
any length are read whole; equal texts get equal predictions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import fold, mapped, uniform, utf8

GRAMS = 3
SLOTS = 1 << 15
#: Labelled texts of each language that the steps and the calibration see, about.
PER_LABEL = 1_500
#: The part of the sample that sets the temperature.
CALIBRATION = 0.2
PASSES = 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 0.02
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Code points hashed at a time.
_CHUNK = 1 << 16


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a text's n-grams, slots ascending."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    total = np.zeros(SLOTS, dtype=np.int64)
    for start in range(0, len(codes), _CHUNK):
        # Neighbouring chunks overlap so that every n-gram is seen once.
        part = codes[start : start + _CHUNK + GRAMS - 1]
        own = min(_CHUNK, len(codes) - start)
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(GRAMS):
            h = h[: len(part) - n]
            h = (h * np.uint32(0x01000193)) ^ part[n:]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            total += np.bincount((mixed >> np.uint32(17))[:own], minlength=SLOTS)
    slots = np.nonzero(total)[0]
    return slots, total[slots]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of a text: TF-IDF scaled to length one."""
    slots, n = gram_counts(text)
    x = (1.0 + np.log(n)) * idf[slots]
    length = np.sqrt((x * x).sum())
    return slots, x / length if length else x


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and how many texts there are; all texts count."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total[gram_counts(data.decode("utf-8", "replace"))[0]] += 1
                total[SLOTS] += 1
        slots = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots])], names=["slot", "n"])

    parts = docs.select(utf8(text).alias("_text")).mapInArrow(count, "slot int, n long")
    df = np.zeros(SLOTS + 1, dtype=np.int64)
    for row in parts.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS + 1 rows
        df[row["slot"]] = row["n"]
    return df[:SLOTS], int(df[SLOTS])


def sample(docs: DataFrame, id: str, text: str, label: str, idf: np.ndarray, seed: int):
    """Vectors and labels of about PER_LABEL texts of each label, in seeded order."""
    sizes = {r[label]: r["n"] for r in docs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return [], [], []
    draw = uniform(id, label, seed=seed)
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col(label) == name, F.lit(min(1.0, PER_LABEL / n))).otherwise(share)
    weights = docs.sparkSession.sparkContext.broadcast(idf)

    def work(batch: pa.RecordBatch) -> dict:
        vectors = [vector(data.decode("utf-8", "replace"), weights.value) for data in batch.column(2).to_pylist()]
        return {
            "draw": batch.column(0),
            "label": batch.column(1),
            "slots": pa.array([s.astype("<i4").tobytes() for s, _ in vectors], pa.binary()),
            "x": pa.array([x.astype("<f4").tobytes() for _, x in vectors], pa.binary()),
        }

    chosen = docs.where(draw < share).select(draw.alias("_draw"), F.col(label).alias("_label"), utf8(text).alias("_text"))
    rows = mapped(chosen, work, "draw double, label string, slots binary, x binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["label"], bytes(r["slots"]), bytes(r["x"])))
    rows = [r for r in rows if r["slots"]]
    vectors = [(np.frombuffer(r["slots"], dtype="<i4"), np.frombuffer(r["x"], dtype="<f4").astype(np.float64)) for r in rows]
    return labels, vectors, [labels.index(r["label"]) for r in rows]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(vectors: list, targets: list[int], kinds: int, seed: int) -> np.ndarray:
    """Weights (SLOTS + 1) x kinds; the last row is the bias."""
    z, n = np.zeros((SLOTS + 1, kinds)), np.zeros((SLOTS + 1, kinds))
    rng = np.random.default_rng(seed)

    def weights(rows) -> np.ndarray:
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    for _ in range(PASSES):
        for i in rng.permutation(len(vectors)).tolist():
            slots, x = vectors[i]
            rows, x = np.append(slots, SLOTS), np.append(x, 1.0)
            w = weights(rows)
            p = softmax(x @ w)
            p[targets[i]] -= 1.0
            g = x[:, None] * p
            squares = g * g
            z[rows] += g - (np.sqrt(n[rows] + squares) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += squares
    return weights(slice(None))


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm."""
    if not len(targets):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(targets)), targets], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[slots] + self.weights[SLOTS]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.labels or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", seed: int = 13) -> Model:
    """A model from the texts of ``docs`` that have a label."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    df, total = document_frequencies(labelled, text)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    labels, vectors, targets = sample(labelled, id, text, label, idf, seed)
    if not vectors:
        return Model(labels[:1], idf, np.zeros((SLOTS + 1, max(1, len(labels[:1])))), 1.0)
    cut = int(len(vectors) * (1 - CALIBRATION))
    fitted = Model(labels, idf, ftrl(vectors[:cut], targets[:cut], len(labels), seed), 1.0)
    logits = np.array([fitted.logits(*v) for v in vectors[cut:]]).reshape(-1, len(labels))
    fitted.temperature = temperature(logits, np.array(targets[cut:], dtype=np.int64))
    return fitted


def predictions(docs: DataFrame, model: Model, keep: list, schema: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` (with their ``schema``), lang_pred and score, a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        found = [shared.value.predict(data.decode("utf-8", "replace")) for data in batch.column(batch.num_columns - 1).to_pylist()]
        names = batch.schema.names[:-1]
        kept = {name: batch.column(i) for i, name in enumerate(names)}
        return kept | {
            "lang_pred": pa.array([name for name, _ in found], pa.string()),
            "score": pa.array([p for _, p in found], pa.float64()),
        }

    return mapped(docs.select(*keep, utf8(text).alias("_text")), work, f"{schema}, lang_pred string, score double")


def identified(
    docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 4, held: int = 2
) -> DataFrame:
    """(id, held_out, lang_pred, score), trained on the rows that are not held out."""
    held_out = fold(id, folds) == held
    model = train(docs.where(~held_out), id, text, label)
    kind = docs.schema[id].dataType.simpleString()
    marked = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return predictions(docs, model, [F.col(id), marked], f"`{id}` {kind}, held_out boolean", text)
