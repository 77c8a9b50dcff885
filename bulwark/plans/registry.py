"""Named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.plans.oracle_sql import cte

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``sql`` may use the derived tables named in ``uses``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = cte(uses) + sql
        return fn

    return register


def stamp(column: str | Column) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def stamped(df: DataFrame) -> DataFrame:
    """Timestamps as text."""
    times = {f.name for f in df.schema.fields if f.dataType.simpleString().startswith("timestamp")}
    return df.select(*[stamp(c).alias(c) if c in times else F.col(c) for c in df.columns])


def as_doubles(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be NULL as doubles, which dataframe libraries read alike."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})
