"""Markdown images that point to hosts outside an allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markdown image syntax ![alt](url "title"), with Unicode white space spelled out.
_SPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
IMAGE = rf'!\[([^\]]*)\]\(([^){_SPACE}]+)(?:[{_SPACE}]+"[^"]*")?\)'
MARKER = "[image removed: external URL blocked]"


def _scheme_is_web(url: Column) -> Column:
    return url.rlike("^[\\x00-\\x20]*(?i:https?):")


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL; NULL when the URL has none."""
    authority = F.regexp_extract(url, "^[\\x00-\\x20]*(?i:https?)://([^/?#]*)", 1)
    name = F.regexp_extract(authority, r"^(?:.*@)?(?:\[([^\]]*)\]|([^:\[]*))", 2)
    bracketed = F.regexp_extract(authority, r"^(?:.*@)?(?:\[([^\]]*)\]|([^:\[]*))", 1)
    return F.nullif(F.lower(F.concat(bracketed, name)), F.lit(""))


def _offends(url: Column, allowed: Sequence[str]) -> Column:
    web = _scheme_is_web(url)
    if not allowed:
        return web
    return web & ~F.coalesce(host(url).isin(*allowed), F.lit(False))


def matches(text: Column, allowed: Sequence[str] = ()) -> Column:
    """``array<struct<alt, url, host>>`` of the offending images."""
    alts = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))
    urls = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2))
    images = F.zip_with(alts, urls, lambda a, u: F.struct(a.alias("alt"), u.alias("url")))
    bad = F.filter(images, lambda m: _offends(m["url"], allowed))
    found = F.transform(
        bad, lambda m: F.struct(m["alt"].alias("alt"), m["url"].alias("url"), host(m["url"]).alias("host"))
    )
    empty = F.array().cast("array<struct<alt:string,url:string,host:string>>")
    return F.when(text.contains("]("), found).otherwise(empty)


def stripped(text: Column, allowed: Sequence[str] = (), marker: str = MARKER) -> Column:
    """The text with offending images replaced by the marker; other images stay as written."""
    tags = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0))
    urls = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2))
    shown = F.zip_with(tags, urls, lambda t, u: F.when(_offends(u, allowed), F.lit(marker)).otherwise(t))
    pieces = F.zip_with(
        F.split(text, IMAGE, -1), shown, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit("")))
    )
    return F.when(text.contains("]("), F.array_join(pieces, "")).otherwise(text)


def detect(df: DataFrame, text: str = "output_text", allowed: Sequence[str] = ()) -> DataFrame:
    """Add ``matches`` and ``score`` (1.0 with any match, else 0.0); empty outputs are skipped."""
    scored = df.withColumn("matches", matches(F.col(text), allowed))
    present = F.length(text) > 0
    score = F.when(F.size("matches") > 0, 1.0).otherwise(0.0)
    return scored.withColumn("score", F.when(present, score))


def strip(
    df: DataFrame, text: str = "output_text", allowed: Sequence[str] = (), marker: str = MARKER
) -> DataFrame:
    return df.withColumn("stripped_text", stripped(F.col(text), allowed, marker))
