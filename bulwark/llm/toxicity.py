"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicon. Words, and word beginnings of 4 to 6 letters, that stand in clearly more toxic than other
texts (log-likelihood ratio at least ``EVIDENCE``) join a short general list. Words are compared
without the signs around them, and again after undoing digits and signs written for letters.

Features. Densities of lexicon words and beginnings, their weights, how many stand near a second
person, capitals, punctuation, obfuscation and repetition rates, and length.

Fitting. A bounded sample of labelled texts (``TOXIC`` and ``OTHER``; equal texts once) is cut into two
halves. Each half's features come from the other half's lexicon, and the calibration curve from
trees that have not seen the half they score. Rows are weighted back to the classes' true sizes.

Cases: null and empty texts have features of zero and get the score of those; a document with
several labels counts by the highest; null labels and ids do not train; without both classes in the
labels every score is the share of toxic ones (0.0 without labels); repeated rows are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import fold, mapped, stored, uniform, utf8

#: Labelled texts of the sample, about.
TOXIC, OTHER = 4_000, 8_000
#: Least log-likelihood ratio of a lexicon entry, and the most entries.
EVIDENCE = 8.0
ENTRIES = 4_000
BEGINNINGS = (4, 5, 6)
#: Words whose attributes a worker remembers.
CACHED = 400_000
#: Words between an entry and a second person.
NEAR = 4

TREES, DEPTH, RATE, BINS, LEAST_ROWS, SHRINK = 120, 4, 0.1, 64, 8.0, 1.0

# A short general list of insults, and pronouns of the second person.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb "
    "imbecile jerk bastard idiotisch dumm trottel abschaum wertlos arschloch crétin imbécile stupide connard "
    "minable idiota idiotas estúpido estúpida imbécil basura asqueroso inútil"
).split()
SECOND_PERSON = "you your yours you're yourself du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes".split()

_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_INNER = regex.compile(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+(?=[\p{L}\p{N}])")
_MIXED = regex.compile(r"\p{L}[\p{N}@$!*._\-]+\p{L}|\p{L}\p{N}|\p{N}\p{L}")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_AS_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_MASKS = "@$!013457"
_CAPITALS = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![a-z])")
_RUNS = re.compile(rb"([!?.*$#%&])\1+")

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 !, 6 ?, 7 sign
for _b in range(33, 127):
    _KIND[_b] = 7
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 10, 11, 12, 13]], _KIND[33], _KIND[63] = 4, 5, 6

FEATURES = (
    "entries_rate entries weight_rate weight_most kinds beginnings_rate beginnings hidden_rate near_second_person "
    "second_person_rate upper_rate capitals_rate exclamation_rate question_rate sign_rate run_rate mixed_rate "
    "stretched_rate digit_rate log_words word_length variety"
).split()


def bare(word: str) -> str:
    """A lower-case word without the signs around it."""
    return _EDGES.sub("", word)


def unmasked(word: str) -> str:
    """A word with digits and signs read as the letters they stand for."""
    return _INNER.sub("", bare(word.translate(_AS_LETTERS)))


def terms(word: str) -> list[str]:
    """A bare word and its beginnings, which end in a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, half, toxic, other): in how many texts of each half a term stands."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            keys = list(held)
            n = [held[k] for k in keys]
            out = {
                "term": pa.array([k[0] for k in keys], pa.string()),
                "half": pa.array([k[1] for k in keys], pa.int32()),
                "toxic": pa.array([v if k[2] else 0 for k, v in zip(keys, n)], pa.int64()),
                "other": pa.array([0 if k[2] else v for k, v in zip(keys, n)], pa.int64()),
            }
            held.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for half, label, data in zip(*(c.to_pylist() for c in batch.columns)):
                words = {bare(w) for w in data.decode("utf-8", "replace").lower().split()}
                held.update((t, half, label) for t in {t for w in words if w for t in terms(w)})
                if len(held) > 1_000_000:
                    yield passed()
        yield passed()

    parts = sample.select("half", "label", "text").mapInArrow(count, "term string, half int, toxic long, other long")
    return parts.groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(counts: DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Weights of the terms with enough evidence, at most ENTRIES, and of the general list."""
    n, k = F.col("toxic") + F.col("other"), F.col("toxic")
    share = toxic / max(1, toxic + other)
    evidence = k * F.log(k / (n * share)) + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (n * (1 - share)))).otherwise(0.0)
    weight = F.log((k + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    out = {word: 3.0 for word in INSULTS}
    if toxic and other:
        rows = (
            counts.where((k > n * share) & (evidence >= EVIDENCE))
            .select("term", weight.alias("weight"), evidence.alias("evidence"))
            .orderBy(F.col("evidence").desc(), "term").limit(ENTRIES).collect()
        )
        out |= {r["term"]: float(r["weight"]) for r in rows if r["weight"] > 1.0}
    return out


class Reader:
    """Features of texts by one lexicon; remembers the attributes of recent words."""

    WIDTH = 7  # whole weight, whole, beginning weight, hidden, second person, mixed, stretched

    def __init__(self, entries: dict[str, float]) -> None:
        self.entries = entries
        self.second = {*SECOND_PERSON}
        self.place: dict[str, int] = {}
        self.table = np.zeros((CACHED, self.WIDTH))

    def attributes(self, word: str) -> list[float]:
        find = self.entries.get
        begin = lambda w: max((find(t, 0.0) for t in terms(w)[1:]), default=0.0)
        letters = word.isalpha()
        plain = word if letters else bare(word)
        whole, start, hidden = find(plain, 0.0), begin(plain), 0.0
        mixed = not letters and bool(_MIXED.search(plain))
        if not whole and not letters and (word[0] in _MASKS or not plain.isalpha()):
            clear = unmasked(word)
            if clear != plain and (find(clear, 0.0) or begin(clear)):
                whole, start, hidden = find(clear, 0.0), begin(clear), 1.0
        return [whole, float(whole > 0), start, hidden, float(plain in self.second), float(mixed), float(len({*plain}) < len(plain) - 1 and bool(_STRETCHED.search(plain)))]

    def rows(self, distinct: list[str]) -> np.ndarray:
        """Attributes of a text's distinct words."""
        if len(distinct) > CACHED:  # more than fit: read them without memory
            return np.array([self.attributes(w) for w in distinct])
        if len(self.place) + len(distinct) > CACHED:
            self.place.clear()
        places = list(map(self.place.get, distinct))
        if None in places:
            new = [w for w, at in zip(distinct, places) if at is None]
            start = len(self.place)
            self.table[start : start + len(new)] = [self.attributes(w) for w in new]
            self.place.update(zip(new, range(start, start + len(new))))
            places = list(map(self.place.get, distinct))
        return self.table[places]

    def features(self, data: bytes) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        words = data.decode("utf-8", "replace").lower().split()
        if not words:
            return out
        tally = Counter(words)
        distinct = list(tally)
        times = np.fromiter(tally.values(), dtype=np.float64, count=len(tally))
        rows = self.rows(distinct)
        weight = np.maximum(rows[:, 0], rows[:, 2])
        hit = weight > 0
        total = float(len(words))
        hits = float(times[hit].sum())
        sums = times @ rows
        kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=8).astype(np.float64)
        letters = max(1.0, kinds[0] + kinds[1] + kinds[2])
        out[:10] = (
            sums[1] / total, np.log1p(sums[1]), float(times @ weight) / total, float(weight.max()), float(hit.sum()),
            hits / total, np.log1p(hits), sums[3] / total, self._near(words, distinct, hit, rows[:, 4] > 0) if hits else 0.0, sums[4] / total,
        )
        out[10:] = (
            kinds[1] / letters, len(_CAPITALS.findall(data)) / total, kinds[5] / total, kinds[6] / total,
            (kinds[5] + kinds[6] + kinds[7]) / total, len(_RUNS.findall(data)) / total, sums[5] / total, sums[6] / total,
            kinds[3] / total, np.log1p(total), letters / total, len(distinct) / total,
        )
        return out

    @staticmethod
    def _near(words: list[str], distinct: list[str], hit: np.ndarray, second: np.ndarray) -> float:
        """Share of lexicon words with a second person at most NEAR words away."""
        hits = {w for w, h in zip(distinct, hit) if h}
        persons = {w for w, s in zip(distinct, second) if s}
        at = np.array([i for i, w in enumerate(words) if w in hits])
        if not persons or not len(at):
            return 0.0
        who = np.array([i for i, w in enumerate(words) if w in persons])
        right = np.searchsorted(who, at)
        gap = np.minimum(
            np.abs(who[np.minimum(right, len(who) - 1)] - at), np.abs(who[np.maximum(right - 1, 0)] - at)
        )
        return float((gap <= NEAR).mean())


@dataclass
class Trees:
    """Boosted trees of equal depth; node i has children 2 i + 1 and 2 i + 2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # go right when the feature is greater
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in zip(self.feature, self.border, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees for the logistic loss, grown level by level on histograms."""
    inner = 2**DEPTH - 1
    borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(borders)], axis=1)
    share = np.clip((weight @ y) / weight.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    raw = np.full(len(x), start)
    out_feature, out_border, out_value = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, border = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j, edges in enumerate(borders):
                if not len(edges):
                    continue
                key = (node - first) * (BINS + 1) + bins[:, j]
                size = width * (BINS + 1)
                left_g, left_h, left_n = (
                    np.bincount(key, w, size).reshape(width, -1).cumsum(axis=1) for w in (g, h, np.ones(len(x)))
                )
                all_g, all_h, all_n = left_g[:, -1:], left_h[:, -1:], left_n[:, -1:]
                gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
                gain[(left_n < LEAST_ROWS) | (all_n - left_n < LEAST_ROWS)] = 0.0
                gain = gain[:, : len(edges)]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best + 1e-12
                best[better] = top[better]
                at = first + np.nonzero(better)[0]
                feature[at], border[at] = j, edges[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > border[node])
        leaf = node - inner
        leaf_g, leaf_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -RATE * leaf_g / (leaf_h + SHRINK)
        raw += value[leaf]
        out_feature.append(feature), out_border.append(border), out_value.append(value)
    return Trees(start, np.array(out_feature), np.array(out_border), np.array(out_value))


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw, probability) points of the best non-decreasing curve, by pooling violators."""
    level, at = np.unique(raw, return_inverse=True)  # equal scores share a probability
    weights = np.bincount(at, weight)
    blocks: list[list[float]] = []  # weighted mean of y, weight, weighted sum of raw
    for r, t, w in zip(level, np.bincount(at, weight * y) / weights, weights):
        blocks.append([t, w, r * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Model:
    entries: dict[str, float]
    share: float  # of toxic texts, the score where nothing could be fitted
    trees: Trees | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.curve), 0.0, 1.0)


def _weighted_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, seed: int):
    """(half, label, text) of the sample, stored, and the true sizes of both classes."""
    rated = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias("_label"))
    rated = rated.select(id, (F.col("_label") > 0).alias("_label"))
    sizes = {r["_label"]: r["n"] for r in rated.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("_label"), F.lit(TOXIC / max(1, sizes.get(True, 0)))).otherwise(F.lit(OTHER / max(1, sizes.get(False, 0))))
    # About TOXIC + OTHER rows of an id and a flag, whatever the tables' sizes.
    chosen = F.broadcast(rated.where(uniform(id, seed=seed) < share))
    texts = docs.select(F.col(id), utf8(text).alias("text")).join(chosen, id)
    once = texts.groupBy(F.xxhash64("text").alias("_hash")).agg(F.max("_label").alias("label"), F.first("text").alias("text"))
    half = F.pmod(F.xxhash64(F.lit(seed), F.col("_hash")), F.lit(2)).cast("int").alias("half")
    return stored(once.select(half, "label", "text"), "rated"), sizes


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 17
) -> Model:
    """A model from the labelled texts of ``docs``."""
    sample, sizes = _weighted_sample(docs, labels, id, text, label, seed)
    counts = stored(term_counts(sample), "terms")
    in_half = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = lambda half, toxic: in_half.get((half, toxic), 0)
    by_half = [lexicon(counts.where(F.col("half") == h), number(h, True), number(h, False)) for h in (0, 1)]
    both = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    toxic, other = (number(0, flag) + number(1, flag) for flag in (True, False))
    entries = lexicon(both, toxic, other)
    true_share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    if not toxic or not other:
        return Model(entries, true_share)

    def work(batch: pa.RecordBatch) -> dict:
        of_half = readers(by_half)
        found = [of_half[1 - h].features(data) for h, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        return {
            "half": batch.column(0),
            "label": batch.column(1),
            "x": pa.array([f.astype("<f8").tobytes() for f in found], pa.binary()),
        }

    rows = mapped(sample.select("half", "label", "text"), work, "half int, label boolean, x binary").collect()
    rows.sort(key=lambda r: (r["half"], r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], dtype="<f8") for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    half = np.array([r["half"] for r in rows])
    weight = np.where(y > 0, sizes[True] / toxic, sizes[False] / other)
    weight /= weight.mean()
    raw = np.zeros(len(x))
    for h in (0, 1):
        seen, unseen = half != h, half == h
        if not seen.any() or not unseen.any():
            seen = unseen = np.ones(len(x), dtype=bool)
        raw[unseen] = boost(x[seen], y[seen], weight[seen]).raw(x[unseen])
    return Model(entries, true_share, boost(x, y, weight), isotonic(raw, y, weight))


_readers: dict[tuple, list[Reader]] = {}


def readers(lexicons: list[dict[str, float]]) -> list[Reader]:
    """Readers of a worker for these lexicons."""
    key = tuple(hash(frozenset(entries.items())) for entries in lexicons)
    if key not in _readers:
        _readers.clear()
        _readers[key] = [Reader(entries) for entries in lexicons]
    return _readers[key]


def scored(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = 3, held: int = 1, least: float = 0.7,
) -> DataFrame:
    """(id, held_out, score, predicted), trained on the rows that are not held out."""
    held_out = fold(id, folds) == held
    model = train(docs.where(~held_out), labels.where(~held_out), id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        reader = readers([shared.value.entries])[0]
        score = shared.value.score(np.array([reader.features(data) for data in batch.column(2).to_pylist()]))
        return {
            id: batch.column(0),
            "held_out": batch.column(1),
            "score": pa.array(score, pa.float64()),
            "predicted": pa.array((score >= least).astype(np.int32)),
        }

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id), F.coalesce(held_out, F.lit(False)).alias("_held_out"), utf8(text).alias("_text"))
    return mapped(rows, work, f"`{id}` {kind}, held_out boolean, score double, predicted int")
