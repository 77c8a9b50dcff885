"""Personal data by pattern: typed entities with a confidence, redaction and a report.

Name-like entity types need a language model: it runs through the batch scorer and returns entities
with places, which join those of the patterns in :func:`scan_spans`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.arrays import bound, pieces, running

# Word boundaries over ASCII letters, digits and underscore.
_LEAD = "(?<![A-Za-z0-9_])"
_TRAIL = "(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Pattern:
    type: str
    body: str
    confidence: float
    guard: str  # a simple expression that any text with a match contains
    lead: bool = True
    trail: bool = True
    check: str | None = None  # luhn | iban | medical
    start: str = ""  # instead of a word boundary: where a match may start

    @property
    def numeric(self) -> bool:
        return "[0-9]" in self.guard

    @property
    def regex(self) -> str:
        return (_LEAD if self.lead else self.start) + f"(?:{self.body})" + (_TRAIL if self.trail else "")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Entity patterns and confidences, in redaction priority. Patterns whose
# confidence is below the threshold cannot report anything and are left out of the plan.
PATTERNS: tuple[Pattern, ...] = (
    Pattern("URL", r'https?://[^ \t\r\n<>"]+', 0.6, "://", trail=False),
    Pattern(
        "EMAIL_ADDRESS",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        1.0,
        "@",
        lead=False,
        trail=False,
        # Not inside a run of address characters, so a long run is read once; the matches are the same.
        start=r"(?:\G|(?<![A-Za-z0-9._%+-]))",
    ),
    Pattern("IBAN_CODE", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 1.0, "[A-Z][0-9]{2}", check="iban"),
    Pattern(
        "CREDIT_CARD",
        "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}",
        1.0,
        "[0-9]{4}",
        check="luhn",
    ),
    Pattern("US_SSN", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.5, "[0-9]-[0-9]{2}-[0-9]"),
    Pattern(
        "PHONE_NUMBER",
        r"1[ .-]\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}"
        r"|(?:1[ .-])?[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}",
        0.75,
        "[0-9]{3}[ .-][0-9]{4}",
    ),
    Pattern("IP_ADDRESS", rf"(?:{_OCTET}\.){{3}}{_OCTET}", 0.6, r"[0-9]\.[0-9]"),
    Pattern("MEDICAL_LICENSE", "[A-HJ-MPRSTUXa-hj-mprstux][A-Za-z][0-9]{7}", 1.0, "[0-9]{7}", check="medical"),
    Pattern("US_DRIVER_LICENSE", "[A-Z][0-9]{3,6}|[A-Z][0-9]{5,9}", 0.3, "[A-Z][0-9]{3}"),
    Pattern("US_PASSPORT", "[0-9]{9}|[A-Z][0-9]{8}", 0.1, "[0-9]{8}"),
    Pattern("US_BANK_NUMBER", "[0-9]{8,17}", 0.05, "[0-9]{8}"),
)
# Entity types reported unless the caller names others. PERSON and NRP come from
# the batch scorer; places and dates are not reported.
SENSITIVE_TYPES = (
    "PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "US_SSN", "US_BANK_NUMBER",
    "US_PASSPORT", "US_DRIVER_LICENSE", "IP_ADDRESS", "IBAN_CODE", "MEDICAL_LICENSE", "NRP", "URL",
)


def active_patterns(threshold: float = 0.5, types: Sequence[str] | None = None) -> list[Pattern]:
    wanted = set(types or SENSITIVE_TYPES)
    return [p for p in PATTERNS if p.type in wanted and p.confidence >= threshold]


def _iban_ok(code: Column) -> Column:
    """Country and check digits moved to the end, letters as 10..35, remainder 1 modulo 97."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    digits = F.split(moved, "")

    def step(acc: Column, ch: Column) -> Column:
        value = F.conv(ch, 36, 10).cast("int")
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(digits, F.lit(0), step) == 1


def _medical_ok(code: Column) -> Column:
    """Last digit equals the last digit of (d1+d3+d5) + 2*(d2+d4+d6)."""

    def digit(i: int) -> Column:
        return F.substring(code, i + 2, 1).cast("int")

    odd = digit(1) + digit(3) + digit(5)
    even = digit(2) + digit(4) + digit(6)
    return (odd + even * 2) % 10 == digit(7)


def _verified(matches: Column, pattern: Pattern) -> Column:
    if pattern.check == "luhn":
        return F.filter(matches, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")))
    if pattern.check == "iban":
        return F.filter(matches, _iban_ok)
    if pattern.check == "medical":
        return F.filter(matches, _medical_ok)
    return matches


def _guarded(text: Column, p: Pattern) -> Column:
    """A cheap necessary condition; most texts stop here for most types."""
    return text.rlike(p.guard) if p.numeric else text.contains(p.guard)


def _any_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def _matches(text: Column, pattern: Pattern) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(_guarded(text, pattern), _verified(found, pattern)).otherwise(none)


def entities(text: Column, threshold: float = 0.5, types: Sequence[str] | None = None) -> Column:
    """``array<struct<type, score, match>>`` of the entities at or above the threshold."""
    def typed(p: Pattern) -> Column:
        return F.transform(
            _matches(text, p),
            lambda m: F.struct(
                F.lit(p.type).alias("type"), F.lit(p.confidence).alias("score"), m.alias("match")
            ),
        )

    active = active_patterns(threshold, types)
    none = F.array().cast("array<struct<type:string,score:double,match:string>>")
    plain = [typed(p) for p in active if not p.numeric]
    numeric = [typed(p) for p in active if p.numeric]
    if numeric:
        plain.append(F.when(_any_digit(text), F.concat(*numeric)).otherwise(none))
    return F.concat(*plain) if plain else none


SPAN = "struct<start:int,end:int,type:string,score:double,match:string>"


def spans(text: Column, pattern: Pattern) -> Column:
    """Spans of a pattern's verified matches, with 0-based character offsets.

    Gaps and matches alternate; one pass adds up their lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    gaps = F.slice(F.split(text, pattern.regex, -1), F.lit(1), F.greatest(F.size(matches), F.lit(1)))
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return end, F.struct(
            start.alias("start"), end.alias("end"), F.lit(pattern.type).alias("type"),
            F.lit(pattern.confidence).alias("score"), pair["match"].alias("match"),
        )

    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    found = running(F.filter(pairs, lambda p: p["match"].isNotNull()), SPAN, step, F.lit(0))
    if pattern.check is not None:
        found = F.filter(found, lambda s: F.size(_verified(F.array(s["match"]), pattern)) > 0)
    return F.when(_guarded(text, pattern), found).otherwise(none)


def resolved(found: Column) -> Column:
    """Spans in order without overlaps: of two that overlap the one with the higher score stays, then
    the longer, then the earlier one, then the first type by name."""

    def better(new: Column, old: Column) -> Column:
        length = lambda s: s["end"] - s["start"]
        return (new["score"] > old["score"]) | ((new["score"] == old["score"]) & (length(new) > length(old)))

    # The last span that stays is decided when one comes that lies apart, or none more (the NULL at the end).
    def step(last: Column, new: Column) -> tuple[Column, Column]:
        apart = last.isNull() | new.isNull() | (last["end"] <= new["start"])
        return F.when(apart | better(new, last), new).otherwise(last), F.when(apart, last)

    nothing = F.lit(None).cast(SPAN)
    kept = running(F.concat(F.array_sort(found), F.array(nothing)), SPAN, step, nothing)
    return F.when(F.size(found) > 0, F.filter(kept, lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def located(
    text: Column, threshold: float = 0.5, types: Sequence[str] | None = None, extra: Column | None = None
) -> Column:
    """``array<struct<start, end, type, score, match>>`` by start, without overlaps.

    ``extra`` holds a model's entities, ``array<struct<type, score, start, end>>``; like patterns they
    count from the threshold on and only for the reported types, and only inside the text.
    """
    parts = [spans(text, p) for p in active_patterns(threshold, types)]
    if extra is not None:
        wanted = list(types or SENSITIVE_TYPES)
        sure = F.filter(
            F.coalesce(extra, F.array()),
            lambda e: e["type"].isin(*wanted) & (e["score"] >= threshold)
            & (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)),
        )
        def named(piece: Callable[[Column, Column], Column]) -> Column:
            return F.transform(
                sure,
                lambda e: F.struct(
                    e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["type"].alias("type"),
                    e["score"].cast("double").alias("score"), piece(e["start"], e["end"] - e["start"]).alias("match"),
                ),
            )

        parts.append(F.when(F.size(sure) > 0, pieces(text, named)).otherwise(F.array().cast(f"array<{SPAN}>")))
    return resolved(F.concat(*parts)) if parts else F.array().cast(f"array<{SPAN}>")


def scan_spans(
    df: DataFrame,
    text: str = "text",
    extra: str | None = None,
    threshold: float = 0.5,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``entities`` with places, and ``score``: the highest confidence, 0.0 without entities."""
    model = None if extra is None else F.col(extra)
    found = df.withColumn("entities", located(F.col(text), threshold, types, model))
    best = F.array_max(F.transform("entities", lambda e: e["score"]))
    return found.withColumn("score", F.coalesce(best, F.lit(0.0)))


def redacted_spans(text: Column, found: Column) -> Column:
    """The text with each of the ordered spans replaced by ``<TYPE>``."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return s["end"], F.struct(at.alias("at"), (s["start"] - at).alias("size"), s["type"].alias("type"))

    def filled(piece: Callable[[Column, Column], Column]) -> Column:
        before = running(found, "struct<at:int,size:int,type:string>", step, F.lit(0))
        parts = F.transform(before, lambda p: F.concat(piece(p["at"], p["size"]), F.lit("<"), p["type"], F.lit(">")))
        end = F.element_at(found, -1)["end"]
        return F.array_join(F.concat(parts, F.array(piece(end, F.length(text) - end))), "")

    return F.when(F.size(found) > 0, pieces(text, filled)).otherwise(F.when(found.isNotNull(), text))


def scan(
    df: DataFrame, text: str = "text", threshold: float = 0.5, types: Sequence[str] | None = None
) -> DataFrame:
    """Add ``entities`` and ``score``: the highest confidence, 0.0 without entities."""
    with_entities = df.withColumn("entities", entities(F.col(text), threshold, types))
    best = F.array_max(F.transform("entities", lambda e: e["score"]))
    return with_entities.withColumn("score", F.coalesce(best, F.lit(0.0)))


def redacted(text: Column, threshold: float = 0.5, types: Sequence[str] | None = None) -> Column:
    """The text with every entity replaced by ``<TYPE>``.

    Types are replaced in pattern order, so a later pattern sees the earlier placeholders and
    cannot match inside them. Checked types are replaced match by match.
    """

    def replace(current: Column, p: Pattern) -> Column:
        tag = f"<{p.type}>"
        if p.check is None:
            new = F.regexp_replace(current, p.regex, tag)
        else:
            tags = F.transform(
                F.regexp_extract_all(current, F.lit(p.regex), F.lit(0)),
                lambda m: F.when(F.size(_verified(F.array(m), p)) > 0, F.lit(tag)).otherwise(m),
            )
            parts = F.zip_with(
                F.split(current, p.regex, -1), tags, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))
            )
            new = F.array_join(parts, "")
        return F.when(_guarded(current, p), new).otherwise(current)

    def replace_all(current: Column, patterns: Sequence[Pattern]) -> Column:
        return reduce(lambda c, p: bound(c, lambda v: replace(v, p)), patterns, current)

    active = active_patterns(threshold, types)
    plain = replace_all(text, [p for p in active if not p.numeric])
    numeric = [p for p in active if p.numeric]
    return bound(plain, lambda v: F.when(_any_digit(v), replace_all(v, numeric)).otherwise(v))


def report(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    threshold: float = 0.5,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Documents and matches per key and entity type.

    Matches are counted inside each row, so nothing is exploded per match and a document counts
    once per type without a distinct aggregate.
    """
    active = active_patterns(threshold, types)
    kinds = df.select(
        *keys, F.transform(entities(F.col(text), threshold, types), lambda e: e["type"]).alias("_types")
    )

    def found(kind: str) -> Column:
        return F.size(F.filter("_types", lambda t: t == kind))

    counts = kinds.select(*keys, *[found(p.type).alias(p.type) for p in active])
    totals = counts.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(p.type).alias("entity_type"),
                F.count_if(F.col(p.type) > 0).alias("documents"),
                F.sum(F.col(p.type).cast("long")).alias("matches"),
            ).alias(p.type)
            for p in active
        ]
    )
    rows = totals.select(*keys, F.inline(F.array(*[F.col(p.type) for p in active])))
    return rows.where(F.col("matches") > 0)
