"""Hashes and keys over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def cache_key(tenant_id: Column, text: Column, config_version: str, prefix: str = "guard") -> Column:
    """``prefix:tenant:scores:<sha256 of text|version>``: a config bump or tenant change misses."""
    digest = sha256(F.concat(text, F.lit("|" + config_version)))
    return F.concat(F.lit(prefix + ":"), tenant_id.cast("string"), F.lit(":scores:"), digest)


def uuid_or_null(text: Column) -> Column:
    """A canonical lower-case UUID, or NULL when the text is not one. Braces, a urn prefix and
    missing hyphens are accepted."""
    bare = F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), "^[{}]+|[{}]+$", "")
    digits = F.lower(F.regexp_replace(bare, "-", ""))
    grouped = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), grouped)


def key_prefix(key: Column, length: int = 20) -> Column:
    """The leading part of an API key that may be shown."""
    return F.substring(key, 1, length)
