"""Similarity detectors over embedding columns.

Arrow batches go to numpy as one matrix per batch: a single product instead of an interpreted
lambda per element.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.session import stored

#: Numbers of all topics together up to which they travel to the rows (8 MB).
SMALL = 1 << 20
#: Topics and vectors of a block.
TOPICS = 1024
VECTORS = 4096


def _widths(column: pa.Array) -> np.ndarray:
    """Length of each row; -1 where it is absent or holds a NULL."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).copy()
    if column.flatten().null_count:
        for i, row in enumerate(column.to_pylist()):
            if row is not None and None in row:
                lengths[i] = -1
    return lengths


def _matrix(column: pa.Array, width: int, usable: np.ndarray) -> np.ndarray:
    """The usable rows, which all have ``width`` numbers, as float64."""
    rows = column.filter(pa.array(usable))
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _spread(values: np.ndarray, valid: np.ndarray) -> pa.Array:
    out = np.zeros(len(valid))
    out[valid] = values
    return pa.array(out, mask=~valid)


def topic_similarity(vector: Column, topics: Sequence[Sequence[float]]) -> Column:
    """Highest cosine similarity to any topic, floored at 0; 1.0 when there are no topics.

    Topics are configuration: a short list of vectors of one width, fixed before the job starts.
    A vector of another width has no score; :func:`vector_error` says why.
    """
    if not topics:
        return F.lit(1.0)
    wanted = _unit(np.asarray(topics, dtype=np.float64)).T

    @F.arrow_udf(T.DoubleType())
    def best(column: pa.Array) -> pa.Array:
        usable = _widths(column) == len(wanted)
        rows = _matrix(column, len(wanted), usable)
        sims = (_unit(rows) @ wanted).max(axis=1) if len(rows) else np.zeros(0)
        return _spread(np.maximum(sims, 0.0), usable)

    return best(vector)


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    widths = _widths(a)
    usable = (widths == _widths(b)) & (widths >= 0)
    sims = np.zeros(len(widths))
    for width in np.unique(widths[usable]):  # one product per width, nearly always a single one
        rows = usable & (widths == width)
        sims[rows] = (_unit(_matrix(a, width, rows)) * _unit(_matrix(b, width, rows))).sum(axis=1)
    return _spread(np.clip(sims[usable], 0.0, 1.0), usable)


def relevance(input_vector: Column, output_vector: Column) -> Column:
    """Cosine similarity of two vectors, clamped to [0, 1]."""
    return _cosine(input_vector, output_vector)


def vector_error(vector: Column, width: Column | int) -> Column:
    """Why a vector has no score: it is absent, holds a NULL, or has another width; else NULL."""
    wanted = F.lit(width) if isinstance(width, int) else width
    broken = F.exists(vector, lambda x: x.isNull())
    return (
        F.when(vector.isNull(), "no vector")
        .when(broken, "vector with a missing number")
        .when(F.size(vector) != wanted, F.format_string("vector of width %d, not %d", F.size(vector), wanted))
    )


def topic_guardrail(df: DataFrame, vector: str, topics: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``score`` and ``error``: a vector that cannot be scored fails open."""
    error = vector_error(F.col(vector), len(topics[0])) if topics else F.lit(None).cast("string")
    return df.withColumns({"score": topic_similarity(F.col(vector), topics), "error": error})


def topic_guardrail_by(df: DataFrame, vector: str, topics: DataFrame, topic: str) -> DataFrame:
    """Like :func:`topic_guardrail` with the topics in a table, as when each tenant has its own.

    ``topics`` holds ``topic`` vectors; columns of equal name in both tables must match, without any
    every row meets every topic. The smallest topic of a group gives the group's width; topics of
    other widths are left out. Up to ``SMALL`` numbers the topics travel to the rows; beyond, see
    :func:`_by_blocks`. Rows of a group without topics score 1.0.
    """
    shared = [c for c in topics.columns if c in df.columns and c != topic]
    group = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(shared)])) if shared else F.lit("")
    # As in a join on the shared columns, a NULL matches nothing.
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in shared], F.lit(True))
    known = topics.where(whole & F.col(topic).isNotNull()).select(group.alias("_group"), F.col(topic).cast("array<double>").alias("_topic"))
    n, width = known.agg(F.count(F.lit(1)), F.max(F.size("_topic"))).first()
    rows = df.withColumn("_group", F.when(whole, group))
    if n * (width or 0) > SMALL:
        return _by_blocks(rows, vector, known, bool(shared)).drop("_group")
    # At most SMALL numbers, by the count above.
    lists: dict[str, list] = {}
    for g, t in known.collect():
        lists.setdefault(g, []).append(t)
    widths = {g: len(min(ts)) for g, ts in lists.items()}
    matrices = {g: _unit(np.asarray([t for t in ts if len(t) == widths[g]], dtype=np.float64)).T for g, ts in lists.items()}

    @F.arrow_udf(T.DoubleType())
    def best(column: pa.Array, groups: pa.Array) -> pa.Array:
        found = _widths(column)
        names = groups.dictionary_encode()
        of_row = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
        sims, valid = np.ones(len(found)), np.ones(len(found), dtype=bool)
        for i, g in enumerate(names.dictionary.to_pylist()):
            if g in matrices:
                usable = (of_row == i) & (found == len(matrices[g]))
                sims[usable] = np.maximum((_unit(_matrix(column, len(matrices[g]), usable)) @ matrices[g]).max(axis=1, initial=0.0), 0.0)
                valid &= (of_row != i) | usable
        return pa.array(sims, mask=~valid)

    width_of = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair]) if widths else F.lit(None).cast("map<string,int>")
    limit = F.try_element_at(width_of, F.col("_group"))
    error = F.when(limit.isNotNull(), vector_error(F.col(vector), limit))
    return rows.withColumns({"score": best(F.col(vector), F.col("_group")), "error": error}).drop("_group")


def _beside(df: DataFrame, facts: DataFrame, grouped: bool, how: str = "inner") -> DataFrame:
    """``df`` with the facts of its group; the one row of facts there is without groups, as constants."""
    if grouped:
        return df.join(facts, "_group", how)
    only = facts.first()
    facts = facts.drop("_group")
    return df.withColumns({c: F.lit(only[c] if only else None).cast(facts.schema[c].dataType) for c in facts.columns})


def _by_blocks(rows: DataFrame, vector: str, known: DataFrame, grouped: bool) -> DataFrame:
    """Highest similarities against a large table of topics, as blocked matrix products.

    Topics of a group are dealt by a hash into blocks of about ``TOPICS``, its distinct vectors into
    blocks of about ``VECTORS``. Each block of vectors meets each block of topics in one product, and
    only a maximum per vector leaves the task. Blocks meet by an equi-join on (group, block of
    topics), so that the work spreads over executors however large one group is.
    """
    known = known.withColumn("_w", F.size("_topic"))
    sizes = stored(
        known.groupBy("_group").agg(F.size(F.min("_topic")).alias("_width"), F.ceil(F.count(F.lit(1)) / TOPICS).cast("int").alias("_parts")), "topic-groups"
    )
    name = F.concat(*[F.hex(F.xxhash64(F.lit(i), "_group", vector)) for i in (1, 2)])
    measured = _beside(rows, sizes, grouped, "left").withColumn("error", F.when(F.col("_width").isNotNull(), vector_error(F.col(vector), F.col("_width"))))
    scored = F.col("_width").isNotNull() & F.col("error").isNull()
    measured = measured.withColumn("_name", F.when(scored, name))
    distinct = stored(
        measured.where(scored).select("_group", "_parts", "_name", F.col(vector).cast("array<double>").alias("_vector")).distinct(), "topic-vectors"
    )
    counts = distinct.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / VECTORS).alias("_n"))
    asked = (
        _beside(distinct, counts, grouped).withColumn("_part", F.pmod(F.xxhash64("_vector"), F.col("_n")))
        .groupBy("_group", "_parts", "_part").agg(F.collect_list("_name").alias("names"), F.flatten(F.collect_list("_vector")).alias("vectors"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    )
    offered = (
        _beside(known, sizes, grouped).where("_w = _width").withColumn("_block", F.pmod(F.xxhash64("_topic"), F.col("_parts")).cast("int"))
        .groupBy("_group", "_block").agg(F.flatten(F.collect_list("_topic")).alias("topics"))
    )

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, vectors, topics in zip(*batch.columns):
                flat = vectors.values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                sims = _unit(flat) @ _unit(topics.values.to_numpy(zero_copy_only=False).reshape(-1, flat.shape[1])).T
                yield pa.RecordBatch.from_pydict({"_name": names.values, "_similarity": pa.array(sims.max(axis=1))})

    met = asked.join(offered, ["_group", "_block"] if grouped else ["_block"]).select("names", "vectors", "topics")
    best = met.mapInArrow(products, "_name string, _similarity double").groupBy("_name").agg(F.max("_similarity").alias("_similarity"))
    similarity = F.when(F.col("_similarity").isNotNull(), F.greatest(F.col("_similarity"), F.lit(0.0)))
    return (
        measured.join(best, "_name", "left")
        .withColumn("score", F.when(F.col("_width").isNull(), F.lit(1.0)).otherwise(similarity))
        .select(*[c for c in rows.columns], "score", "error")
    )
