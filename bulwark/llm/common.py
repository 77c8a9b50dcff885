"""Helpers shared by the training-data operators.

Text rules that several operators share: a null text counts as empty, words are runs of bytes
other than space, tab, line feed, vertical tab, form feed and carriage return, and lower-casing
touches A to Z only. On UTF-8 bytes these are ``bytes.lower`` and ``bytes.split``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.session import scratch

#: The same word rule as a pattern for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one piece of work inside a task; the bound on what a Python step holds at once.
ROWS_AT_ONCE = 256


def utf8(text: str | Column) -> Column:
    """The text as UTF-8 bytes, empty when null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes."""
    return data.lower().split()


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids give null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % folds


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands in the files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... and the new name of each, so that no name can clash."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def uniform(*columns: str | Column, seed: int) -> Column:
    """A seeded number in [0, 1) from the columns' values; the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(df: DataFrame, by: str, size: int, seed: int) -> DataFrame:
    """All rows, or about ``size`` of them chosen by a seeded hash of ``by``.

    The share is ``size`` over the row count, so the sample keeps its size at any scale.
    """
    total = df.count()
    if total <= size:
        return df
    return df.where(uniform(by, seed=seed) < size / total)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``work`` to pieces of at most ROWS_AT_ONCE rows; it returns columns by name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(start, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_pydict(work(piece))

    return df.mapInArrow(run, schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix unsigned 64-bit integers (the finaliser of the SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
