"""Document fingerprints by consistent weighted sampling.

Terms are lower-cased words, weights their counts. For each of ``SAMPLES`` slots every term draws
r and c from Gamma(2, 1) and b from [0, 1), all fixed by the term and the slot. With weight w,
t = floor(ln w / r + b) and a = c / exp(r (t - b) + r); the slot's sample is (term, t) of the
smallest a. Two texts agree in a slot with a chance equal to their generalised Jaccard similarity,
the sum of smaller weights over the sum of larger ones. A fingerprint keeps 16 bits of each sample.

``edited`` also compares each text with an edited one whose last third comes from the next
document. Documents are dealt by ranges of ids, so a text crosses the network once; the first
document of each range is sent to the range before it as well. Inside a range a task streams over
sorted rows and holds ``ROWS_AT_ONCE`` of them.

Cases: a null text counts as empty; texts without words have the fingerprint of the empty text,
which is like itself (1) and unlike all others (0); equal texts have equal fingerprints; repeated ids
stand in order of their texts; null ids come last; a single document is its own next; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import ROWS_AT_ONCE, mapped, splitmix, utf8, words

SAMPLES = 128
#: (term, weight) rows that a worker remembers; 1 KB each.
CACHED = 100_000
#: Documents in a range, about, and the most ranges.
RANGE = 500
RANGES = 8_192

_LOW = np.uint64(0xFFFF)
_NAME = np.uint32(0xFFFF)
_HALF = np.uint64(32)
_SLOTS = splitmix(np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
#: Terms drawn at once; small enough for the processor's cache.
_TERMS = 64


def _gamma(bits: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) in single precision, from 64 bits each: the sum of two exponentials."""
    halves = bits.view(np.uint32).astype(np.float32)
    halves += np.float32(0.5)
    both = halves[:, ::2] * halves[:, 1::2]
    both *= np.float32(2.0**-64 * (1 - 1e-6))  # below 1, so the result is above 0
    return np.negative(np.log(both, out=both), out=both)


def draws(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """a of every (term hash, weight) in each slot, with the sample's 16-bit hash in the low bits.

    The single-precision bits of a fill the upper half of a double, so doubles order as a does.
    """
    out = np.empty((len(terms), len(_SLOTS)))
    words_of = out.view(np.uint32)
    log_weights = np.log(weights).astype(np.float32)
    for at in range(0, len(terms), _TERMS):
        part = slice(at, at + _TERMS)
        x = terms[part, None] ^ _SLOTS[None, :]
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> _HALF
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        y = x * np.uint64(0xA0761D6478BD642F)
        y ^= y >> _HALF
        z = y * np.uint64(0xE7037ED1A0B428DB)
        z ^= z >> np.uint64(29)
        r, log_c = _gamma(x), np.log(_gamma(y))
        parts = z.view(np.uint32)
        b = parts[:, 1::2].astype(np.float32)
        b *= np.float32(2.0**-32 * (1 - 1e-6))
        name = parts[:, ::2]
        w = log_weights[part, None]
        if w.any():
            t = np.floor(w / r + b)
            a = np.exp(log_c - r * (t - b) - r)
            name = name ^ t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        else:  # of weight 1, t is 0
            b -= np.float32(1)
            b *= r
            b += log_c
            a = np.exp(b)
        words_of[part, 1::2] = a.view(np.uint32)
        words_of[part, ::2] = name & _NAME
    return out


class Signer:
    """Fingerprints with a bounded memory of (term, weight) rows."""

    def __init__(self) -> None:
        self.place: dict[tuple[bytes, int], int] = {}
        self.table = np.empty((CACHED, SAMPLES))

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """One row of 16-bit samples per text."""
        out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
        for i, text in enumerate(texts):
            terms = Counter(words(text))
            if terms:
                out[i] = self._least(terms)
        return out

    def _least(self, terms: Counter) -> np.ndarray:
        items = list(terms.items())
        rows = list(map(self.place.get, items))
        best = None
        if None in rows:
            missing = [item for item, row in zip(items, rows) if row is None]
            rows = [row for row in rows if row is not None]
            once = [item for item in missing if item[1] == 1]
            often = [item for item in missing if item[1] > 1]
            for some in (once, often):
                for at in range(0, len(some), 4096):
                    part = some[at : at + 4096]
                    new = self._new(part)
                    low = new.min(axis=0)
                    best = low if best is None else np.minimum(best, low)
                    self._remember(part, new)
        for at in range(0, len(rows), 4096):
            low = self.table[rows[at : at + 4096]].min(axis=0)
            best = low if best is None else np.minimum(best, low)
        return (best.view(np.uint64) & _LOW).astype(np.uint16)

    @staticmethod
    def _new(items: list[tuple[bytes, int]]) -> np.ndarray:
        hashes = np.array([xxhash.xxh64_intdigest(term) for term, _ in items], dtype=np.uint64)
        return draws(hashes, np.array([n for _, n in items], dtype=np.float64))

    def _remember(self, items: list[tuple[bytes, int]], rows: np.ndarray) -> None:
        free = CACHED - len(self.place)
        if free < len(items):  # the memory is full: the words of today's texts come first
            self.place.clear()
        start = len(self.place)
        self.table[start : start + len(items)] = rows
        self.place.update(zip(items, range(start, start + len(items))))


_signer: list[Signer] = []


def signer() -> Signer:
    if not _signer:
        _signer.append(Signer())
    return _signer[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint): hexadecimal digits, one row per row of ``docs``."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = signer().signatures(batch.column(1).to_pylist())
        return {id: batch.column(0), "fingerprint": pa.array([r.tobytes().hex() for r in rows], pa.string())}

    kind = docs.schema[id].dataType.simpleString()
    return mapped(docs.select(F.col(id), utf8(text).alias("_text")), work, f"`{id}` {kind}, fingerprint string")


def _ranged(docs: DataFrame, id: str, text: str) -> DataFrame | None:
    """(id, text) dealt by ranges of descending ids and sorted, each range closed by its follower.

    Rows come as (_range, _follower, id, _text). None for an empty table.
    """
    ids = docs.select(F.col(id).cast("double").alias("id"))
    total = ids.count()
    if not total:
        return None
    ranges = min(RANGES, -(-total // RANGE))
    probabilities = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.where("id is not null").approxQuantile("id", probabilities, 1 / (4 * ranges))) if ranges > 1 else ())

    def place(values: pd.Series) -> list[int]:
        """The range of each id; range 0 has the largest ids, nulls are in the last."""
        return [len(bounds) if v is None or v != v else len(bounds) - bisect_left(bounds, v) for v in values]

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(place(values), dtype="int32")

    placed = docs.select(F.col(id), utf8(text).alias("_text")).withColumn("_range", range_of(F.col(id).cast("double")))
    # One row per range: at most RANGES.
    heads = {
        row["_range"]: row["head"]
        for row in ids.select(range_of("id").alias("_range"), "id").groupBy("_range").agg(F.max("id").alias("head")).collect()
    }
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}

    @F.pandas_udf("array<int>")
    def places(ranges: pd.Series, values: pd.Series) -> pd.Series:
        """A row's range and, for the head of a range, the range before it as a negative number."""
        same = lambda v, w: v == w or (pd.isna(v) and pd.isna(w))
        return pd.Series([[r, -1 - before[r]] if same(v, heads[r]) else [r] for r, v in zip(ranges, values)])

    at = F.explode(places("_range", F.col(id).cast("double"))).alias("_at")
    rows = placed.select(at, F.col(id), "_text").select(
        F.when(F.col("_at") < 0, -1 - F.col("_at")).otherwise(F.col("_at")).alias("_range"),
        (F.col("_at") < 0).alias("_follower"),
        F.col(id),
        "_text",
    )
    return rows.repartition(max(1, len(filled)), "_range").sortWithinPartitions(
        "_range", "_follower", F.col(id).desc_nulls_last(), "_text"
    )


def edit(text: str, follower: str) -> str:
    """The text with its last third replaced by as much of the start of ``follower``."""
    third = len(text) // 3
    return text[: len(text) - third] + follower[:third]


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next)."""
    kind = docs.schema[id].dataType.simpleString()
    schema = (
        f"`{id}` {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    rows = _ranged(docs, id, text)
    if rows is None:
        return docs.sparkSession.createDataFrame([], schema)

    def emit(window: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """The rows of a window but its last, each with the row after it."""
        own = [i for i in range(len(window) - 1) if not window[i][1]]
        texts = [row[3].decode("utf-8", "replace") for row in window]
        changed = [edit(texts[i], texts[i + 1]) for i in own]
        signed = signer().signatures([row[3] for row in window])
        other = signer().signatures([t.encode("utf-8", "replace") for t in changed])
        return pa.RecordBatch.from_pydict(
            {
                id: pa.array([window[i][2] for i in own], id_type),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_text": pa.array(changed, pa.string()),
                "fingerprint": pa.array([signed[i].tobytes().hex() for i in own], pa.string()),
                "edited_fingerprint": pa.array([row.tobytes().hex() for row in other], pa.string()),
                "near_edited": pa.array([likeness(signed[i], row) for i, row in zip(own, other)], pa.float64()),
                "near_next": pa.array([likeness(signed[i], signed[i + 1]) for i in own], pa.float64()),
            }
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[tuple] = []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(2).type
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                window += zip(*(c.to_pylist() for c in batch.slice(start, ROWS_AT_ONCE).columns))
                yield emit(window, id_type)
                window = window[-1:]

    return rows.mapInArrow(run, schema)


def digests(compared: DataFrame, id: str = "doc_id") -> DataFrame:
    """The comparison with the SHA-256 of the edited text in its place."""
    return compared.select(
        id,
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


