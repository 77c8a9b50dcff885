"""Secrets in texts: fixed patterns, and character Markov models for the rest.

Base spans. Each kind has one pattern, matched from the left without overlap; matches shorter than
the kind's minimum are dropped afterwards. Places come from the pieces between matches, so they
are exact code points whatever the text holds.

Model. Two first-order character models, one of random strings and one of ordinary identifiers,
give a log-likelihood ratio per character. Their bigram counts come from labelled samples: the
secrets inside base spans are random; other words and identifiers are ordinary. A pair's
probability leans on its second character's own frequency by ``LEAN`` counts. The documents that train are a bounded sample (``SAMPLE``);
all documents are scanned. A run of at least 12 signs outside the base spans (the rest of a run that
a base span touches included) becomes a span of kind ``markov`` when it mixes digits with letters and
its mean ratio reaches ``RATIO``, or, below ``FULL`` signs, as much in total as a run of ``FULL`` needs.

Everything is DataFrame functions; the model is one array literal of 128 x 128 numbers.

Cases: a null text counts as empty and has no span; texts without ASCII are scanned alike; equal
rows give equal rows; an empty table gives an empty result; without any labelled sample the ratio is
zero and the model adds nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.llm.common import bounded_sample, numbered


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    secret: int  # the group that holds the secret
    least: int  # its least length


# The kinds of base spans.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Kind("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    Kind("hex", r"([0-9a-f]{16,})", 1, 16),
)
ADDED = "markov"
#: Runs that the model judges: whole, of 12 or more, with digits and letters.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}"
#: From so many characters on ``RATIO`` alone decides.
FULL = 20
#: Mean log-likelihood ratio per pair of characters.
RATIO = 1.5
#: Documents that train the model, about.
SAMPLE = 20_000
CODES = 128
LEAN = 5.0
#: Items that grow one array together.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items: Column, kind: str, step, first: int = 0) -> Column:
    """array<kind> of what ``step(at, item)`` = (next at, out) gives item by item, ``at`` from ``first``.

    An array grows by being copied, so it grows block by block and blocks are joined once.
    """
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def of_block(part: Column, at: Column) -> Column:
        def grown(done: Column, item: Column) -> Column:
            after, out = step(done["at"], item)
            return F.struct(after.alias("at"), F.concat(done["out"], F.array(out)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), grown)

    def joined(done: Column, part: Column) -> Column:
        return _bound(of_block(part, done["at"]), lambda b: F.struct(b["at"].alias("at"), F.concat(done["out"], F.array(b["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int") - 1), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(first).alias("at"), no_blocks.alias("out"))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(blocks, start, joined, lambda done: done["out"]))).otherwise(none)

    return _bound(items, whole)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern without inner alternatives, in code points.

    The pieces between the matches and the matches alternate, so their lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    paired = F.zip_with(
        F.slice(pieces, 1, F.greatest(F.size(found), F.lit(1))), found, lambda before, hit: F.struct(before.alias("before"), hit.alias("hit"))
    )

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["before"])
        end = start + F.length(p["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("found"))

    spans = _scan(F.filter(paired, lambda p: p["hit"].isNotNull()), "struct<start:int,end:int,found:string>", step)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """The kind's spans with its order, without those whose secret is too short."""
    long_enough = (
        (lambda m: F.length(F.regexp_extract(m["found"], kind.pattern, kind.secret)) >= kind.least)
        if kind.secret > 1
        else (lambda m: F.length(m["found"]) >= kind.least)
    )
    kept = F.filter(matches(text, kind.pattern), long_enough)
    named = F.transform(
        kept,
        lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"), m["found"].alias("found")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(text.rlike(kind.pattern), named).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, kind, i) for i, kind in enumerate(KINDS)]))


def _pairs(strings: Column) -> Column:
    """Pairs of neighbouring characters of a string of two or more, as one number each."""
    return _bound(
        F.split(strings, ""),
        lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.ascii(a) * CODES + F.ascii(b)
        ),
    )


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Log-likelihood ratios, random over ordinary, by pair of character codes.

    The driver receives pair counts: at most 2 x 128 x 128 rows.
    """
    sample = bounded_sample(docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("_text")), id, size, seed)
    marked = sample.select(F.explode(base_spans(F.col("_text"))).alias("span"))
    value = F.col("span.found")
    for i, kind in enumerate(KINDS):
        if kind.secret > 1:
            inner = F.regexp_extract("span.found", kind.pattern, kind.secret)
            value = F.when(F.col("span.kind") == i, inner).otherwise(value)
    random = marked.select(F.lit(1).alias("random"), value.alias("s"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))))
    ordinary = sample.select(F.lit(0).alias("random"), names.alias("s")).join(random.select("s"), "s", "left_anti").select("random", "s")
    pairs = (
        random.unionByName(ordinary).where(F.length("s") > 1)
        .select("random", F.explode(_pairs(F.col("s"))).alias("pair"))
        .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = np.zeros((2, CODES * CODES))
    for row in pairs.collect():
        if 0 <= row["pair"] < CODES * CODES:
            counts[row["random"], row["pair"]] = row["n"]
    if not counts.sum(axis=1).all():
        return np.zeros(CODES * CODES)
    counts = counts.reshape(2, CODES, CODES)
    single = counts.sum(axis=1) + 1.0
    single /= single.sum(axis=1, keepdims=True)
    log_p = np.log((counts + LEAN * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + LEAN))
    return (log_p[1] - log_p[0]).ravel()


def _ratio(run: Column, model: np.ndarray) -> Column:
    """Mean log-likelihood ratio of a run's pairs."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    total = F.aggregate(_pairs(run), F.lit(0.0), lambda sum_, pair: sum_ + F.element_at(table, pair + 1))
    return total / (F.length(run) - 1)


def least_ratio(length: Column) -> Column:
    """The mean ratio that a run of this length must reach: a short run as much evidence as one of ``FULL``."""
    return F.lit(RATIO * (FULL - 1)) / (F.least(length, F.lit(FULL)) - 1)


def _uncovered(spans: Column) -> Column:
    """array<struct<start, size, hole>>: what lies before each of the ordered spans and outside all earlier
    ones, and how much the span covers beyond them."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        after = F.greatest(at, s["end"])
        size = F.greatest(F.lit(0), s["start"] - at)
        return after, F.struct(at.alias("start"), size.alias("size"), (after - at - size).alias("hole"))

    return _scan(spans, "struct<start:int,size:int,hole:int>", step)


def _outside(text: Column, base: Column) -> Column:
    """The text with the base spans blanked out, so that all places stay."""

    def blanked(chars: Column) -> Column:
        piece = lambda start, size: F.array_join(F.slice(chars, start + 1, size), "")
        parts = F.transform(_uncovered(base), lambda p: F.concat(piece(p["start"], p["size"]), F.repeat(F.lit(" "), p["hole"])))
        covered = F.array_max(F.transform(base, lambda s: s["end"]))
        return F.array_join(F.concat(parts, F.array(piece(covered, F.size(chars) - covered))), "")

    return F.when(F.size(base) > 0, _bound(F.split(text, ""), blanked)).otherwise(text)


def _added(text: Column, base: Column, model: np.ndarray) -> Column:
    order = len(KINDS)

    def judged(runs: Column) -> Column:
        random = F.filter(runs, lambda m: _ratio(m["found"], model) >= least_ratio(F.length(m["found"])))
        return F.transform(
            random, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"), m["found"].alias("found"))
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    return F.when(text.rlike(RUN), _bound(_outside(text, base), lambda rest: judged(matches(rest, RUN)))).otherwise(none)


def scan(docs: DataFrame, model: np.ndarray, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (start, kind, end, found): base spans, and all spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, base_spans(whole)).withColumn(
        spans, F.array_sort(F.concat(F.col(base), _added(whole, F.col(base), model)))
    )


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit(ADDED))
    one = F.transform(
        F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``docs``."""
    found = scan(docs.select(F.col(id), F.col(text).alias("_text")), train(docs, id, text), "_text", "_base", "_spans")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k].name}")
    return found.select(
        F.col(id),
        *[count(k) for k in range(len(KINDS))],
        F.sha2(written("_base").cast("binary"), 256).alias("base_sha256"),
        written("_spans").alias("spans"),
    )


def redacted(docs: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one.

    All rows and columns are kept; ``n_chars``, where there is one, follows the new text.
    """
    plain, name = numbered(docs)
    found = scan(plain, train(docs, id, text), name[text], "base", "spans")

    # Spans come by start; one that starts inside an earlier one only extends what is covered.
    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("start"), (s["start"] - at).alias("size")))

    def filled(chars: Column) -> Column:
        kept = F.filter(_scan(F.col("spans"), "struct<start:int,size:int>", step), lambda p: p.isNotNull())
        piece = lambda start, size: F.array_join(F.slice(chars, start + 1, size), "")
        covered = F.array_max(F.transform("spans", lambda s: s["end"]))
        rest = piece(covered, F.size(chars) - covered)
        return F.array_join(F.concat(F.transform(kept, lambda p: piece(p["start"], p["size"])), F.array(rest)), mark)

    # A column of its own, so that it is computed once.
    changed = F.when(F.size("spans") > 0, _bound(F.split(F.col(name[text]), ""), filled))
    filled_in = found.withColumn("filled", changed)
    out = []
    for column in docs.columns:
        value = F.col(name[column])
        if column == text:
            value = F.coalesce("filled", value)
        elif column == "n_chars":
            value = F.when(F.col("filled").isNotNull(), F.length("filled")).otherwise(value).cast(docs.schema[column].dataType)
        out.append(value.alias(column))
    return filled_in.select(*out)
