"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets. Sources share a multiple of all words by weight; no source gives more than ``most``
times its words, and what it cannot give is shared by weight among the others.

Apportionment. The mix is made of blocks of ``block`` words. Blocks go to sources one by one to
the highest quotient target / (2 k - 1), k being the block the source would get next. A source's
documents lie in shards of about ``SHARD`` documents (by a seeded hash, so a large source has many),
and shards in groups of about ``GROUP``. The source's blocks go to its groups and a group's blocks to its
shards by the same rule, which gives each shard an integer quota without ranking all of them in one task.

Selection. A shard's documents stand in seeded order, one after another, twice. That line is cut
into blocks; a seeded permutation of the blocks of the first pass, then of the second, says which
ones fill the quota. The permutation is arithmetic, so no block is listed, sorted or moved: a
document counts the chosen words of the blocks that it overlaps.

Scale. Words are counted once. Sources and shards are summaries; apportionment ranks a few
quotients around each proportional share, never all of them. The only window over documents is by
shard, of bounded size.

Cases: null or empty texts have size zero, are never taken and count for nothing; a null source is
a source of its own, ordered last; repeated rows and ids are separate documents (equal rows are
interchangeable); an empty table or one without words has targets of zero; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.llm.common import ROWS_AT_ONCE, WORD, numbered, stored

#: Documents in a shard, and shards in a group of shards, about.
SHARD = 512
GROUP = 512
#: Primes above 2**31; multiplying by one permutes the blocks of any shard.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sized: DataFrame, source: str, size: str, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, no, source_size, docs, target): one row per source.

    Weights repeat over the sources in code-point order. Sources are a summary of one short row
    each, so ranking them in one task is bounded by their number, not by the documents.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("no") - 1) % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    everyone = Window.partitionBy()
    # Filling by weight reaches a source's limit in the order of limit / weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    ) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    ranked = (
        totals.withColumn("no", no).withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
        .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everyone)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * common)
    return ranked.withColumn("target", target).select("source", "no", "source_size", "docs", "target")


def apportion(parties: DataFrame, within: Sequence[str], name: str, weight: str, seats: str, quota: str) -> DataFrame:
    """Add ``quota``: how many of the group's ``seats`` go to each party by highest quotients.

    ``seats`` holds the group's number in each of its rows. With n parties whose rounded
    proportional shares miss the seats by d, no party's seats differ from its share by more than
    2 + (d + n) times its part of the weight; only those quotients are ranked. Ties go to the
    smaller ``name``.
    """
    group = Window.partitionBy(*within)
    sum_w, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    part = F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(F.lit(0.0))
    shares = (
        parties.withColumn("_sum", sum_w).withColumn("_n", n).withColumn("_part", part)
        .withColumn("_share", F.floor(F.col("_part") * F.col(seats) + 0.5))
        .withColumn("_miss", F.abs(F.col(seats) - F.sum("_share").over(group)))
        .withColumn("_near", (F.lit(2) + F.ceil((F.col("_miss") + F.col("_n")) * F.col("_part"))).cast("long"))
        .withColumn("_sure", F.greatest(F.lit(0), F.col("_share") - F.col("_near")).cast("long"))
        .withColumn("_open", (F.col(seats) - F.sum("_sure").over(group)).cast("long"))
    )
    nth = F.explode(F.sequence(F.col("_sure") + 1, (F.col("_share") + F.col("_near")).cast("long")))
    quotients = (
        shares.where(F.col(weight) > 0)
        .select(*within, name, "_open", F.col(weight).alias("_weight"), nth.alias("_nth"))
        .withColumn("_quotient", F.col("_weight") / (2 * F.col("_nth") - 1))
    )
    place = F.row_number().over(group.orderBy(F.col("_quotient").desc(), F.col(name), "_nth"))
    won = (
        quotients.withColumn("_place", place).where("_place <= _open").groupBy(*within, name)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    out = (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long")
    return shares.join(won, [*within, name], "left").select(*parties.columns, out.alias(quota))


def _overlap(place: str, seed: int, block: int) -> Column:
    """Chosen words of the document in one pass; the pass starts at the word ``place``."""
    start, end = F.col(place), F.col(place) + F.col("_bw_size")

    def words_of(j: Column) -> Column:
        return F.least(end, (j + 1) * block) - F.greatest(start, j * block)

    return F.aggregate(
        _blocks(start, end, block), F.lit(0).cast("long"), lambda sum_, j: sum_ + F.when(_chosen(j, seed), words_of(j)).otherwise(F.lit(0))
    )


def _blocks(start: Column, end: Column, block: int) -> Column:
    return F.sequence(F.floor(start / block), F.floor((end - 1) / block))


def _chosen(j: Column, seed: int) -> Column:
    """Whether block ``j`` of the shard's two passes is among its quota."""
    first, all_, quota = F.col("_bw_first"), F.col("_bw_all"), F.col("_bw_quota")
    primes = F.array(*[F.lit(p) for p in PRIMES])

    def placed(k: Column, of: Column, salt: int) -> Column:
        mix = F.xxhash64(F.lit(seed + salt), F.col("_bw_no"), F.col("_bw_shard"))
        step = F.element_at(primes, (F.pmod(mix, F.lit(len(PRIMES))) + 1).cast("int"))
        return F.pmod(F.pmod(step, of) * k + F.pmod(mix, of), of)

    second = all_ - first
    return F.when(j < first, placed(j, first, 1) < quota).otherwise(
        (second > 0) & (placed(j - first, F.greatest(second, F.lit(1)), 2) < quota - first)
    )


def laid_out(
    docs: DataFrame, narrow: DataFrame, id: str, source: str, block: int, seed: int,
    weights: Sequence[float], share: float, most: float,
) -> DataFrame:
    """``docs`` with their place in the shard's line and the shard's quota, in ``_bw_`` columns.

    ``narrow`` has the same rows with only (id, source, _bw_size).
    """
    named = stored(targets(narrow, source, "_bw_size", weights, share, most), "sources")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    sources = stored(
        apportion(named.withColumn("_seats", seats), [], "no", "target", "_seats", "_blocks").select(
            F.col("source").alias("_bw_source"), F.col("no").alias("_bw_no"), F.col("source_size").alias("_bw_source_size"),
            F.col("target").alias("_bw_target"), F.col("_blocks").alias("_bw_blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD)).cast("long").alias("_bw_shards"),
        ),
        "apportioned",
    )
    place = F.xxhash64(F.lit(seed), F.col(id), F.col("_bw_size"))

    def sharded(df: DataFrame) -> DataFrame:
        return df.join(sources, F.col(source).eqNullSafe(F.col("_bw_source"))).withColumn(
            "_bw_shard", F.pmod(place, F.col("_bw_shards"))
        )

    shards = sharded(narrow).groupBy("_bw_no", "_bw_shard").agg(
        F.sum("_bw_size").cast("double").alias("_words"), F.first("_bw_blocks").alias("_blocks")
    )
    # A source of d documents ranks d / (SHARD x GROUP) groups at once, a group GROUP shards.
    shards = stored(shards.withColumn("_group", F.floor(F.col("_bw_shard") / GROUP)), "shards")
    of_groups = shards.groupBy("_bw_no", "_group").agg(F.sum("_words").alias("_group_words"), F.first("_blocks").alias("_blocks"))
    given = apportion(of_groups, ["_bw_no"], "_group", "_group_words", "_blocks", "_given").select("_bw_no", "_group", "_given")
    shards = shards.join(given, ["_bw_no", "_group"])
    quotas = apportion(shards, ["_bw_no", "_group"], "_bw_shard", "_words", "_given", "_bw_quota").select(
        "_bw_no", "_bw_shard", "_bw_quota", F.col("_words").cast("long").alias("_bw_words")
    )
    shard = Window.partitionBy("_bw_no", "_bw_shard")
    before = shard.orderBy(place, F.col(id), "_bw_size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sharded(docs)
        .withColumn("_bw_start", F.coalesce(F.sum("_bw_size").over(before), F.lit(0)).cast("long"))
        .join(quotas, ["_bw_no", "_bw_shard"])
        .withColumn("_bw_again", F.col("_bw_start") + F.col("_bw_words"))
        .withColumn("_bw_first", F.ceil(F.col("_bw_words") / block))
        .withColumn("_bw_all", F.ceil(2 * F.col("_bw_words") / block))
    )


def taken(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", block: int = 8, seed: int = 11,
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(id, size, source_size, target, taken): one row per row of ``docs``."""
    narrow = stored(docs.select(F.col(id), F.col(source), word_count(text).alias("_bw_size")), "sizes")
    placed = laid_out(narrow, narrow, id, source, block, seed, weights, share, most)
    both = _overlap("_bw_start", seed, block) + _overlap("_bw_again", seed, block)
    return placed.select(
        F.col(id),
        F.col("_bw_size").alias("size"),
        F.col("_bw_source_size").alias("source_size"),
        F.col("_bw_target").alias("target"),
        F.when(F.col("_bw_size") > 0, both).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


_WORDS = regex.compile(r"[^ \t-\r]+")


def cut(text: str, spans: list[dict] | None) -> str | None:
    """The chosen words of a text: all of it unchanged, or its chosen stretches, one per line."""
    if not spans:
        return None
    bounds = [m.span() for m in _WORDS.finditer(text)]
    if sum(s["b"] - s["a"] for s in spans) >= len(bounds):
        return text
    runs: list[list[int]] = []
    for s in spans:
        if runs and runs[-1][1] == s["a"]:
            runs[-1][1] = s["b"]
        else:
            runs.append([s["a"], s["b"]])
    return "\n".join(text[bounds[a][0] : bounds[b - 1][1]] for a, b in runs)


def mix(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", block: int = 256, seed: int = 11,
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass that takes words of it, cut to those words.

    All columns are kept; ``n_chars``, where there is one, follows a text that was cut.
    """
    plain, name = numbered(docs)
    sized = plain.withColumn("_bw_size", word_count(name[text]))
    narrow = stored(sized.select(name[id], name[source], "_bw_size"), "sizes")
    placed = laid_out(
        sized.where("_bw_size > 0"), narrow.where("_bw_size > 0"), name[id], name[source], block, seed, weights, share, most
    )

    def spans(place: str) -> Column:
        start, end = F.col(place), F.col(place) + F.col("_bw_size")
        chosen = F.filter(_blocks(start, end, block), lambda j: _chosen(j, seed))
        return F.transform(
            chosen,
            lambda j: F.struct(
                (F.greatest(start, j * block) - start).alias("a"), (F.least(end, (j + 1) * block) - start).alias("b")
            ),
        )

    passes = placed.withColumn("_bw_pass", F.explode(F.array(spans("_bw_start"), spans("_bw_again")))).where(
        F.size("_bw_pass") > 0
    )
    names = docs.columns
    at, long_at = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(first, ROWS_AT_ONCE)
                columns = list(piece.columns[:-1])
                before = columns[at].to_pylist()
                after = [cut(t, s) for t, s in zip(before, piece.columns[-1].to_pylist())]
                columns[at] = pa.array(after, columns[at].type)
                if long_at is not None:
                    sizes = [n if a == b else len(a) for n, a, b in zip(columns[long_at].to_pylist(), after, before)]
                    columns[long_at] = pa.array(sizes, columns[long_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return passes.select(*name.values(), "_bw_pass").mapInArrow(run, docs.schema)
