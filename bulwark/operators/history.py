"""Reads over the request log: nested view, filters, review queue, pages, feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.catalog import NAMES
from bulwark.functions.flags import any_flag, flag_names
from bulwark.schemas import REVIEW_LABELS, requests_schema

FLAGGED_VIEW_COLUMNS = (
    "id", "created_at", "model", "input_redacted", "blocked", "block_reason",
    *(f"score_{n}" for n in NAMES),
    *(f"flag_{n}" for n in NAMES),
    "latency_total", "reviewed", "review_label",
)


def for_tenant(df: DataFrame, tenant_id=None) -> DataFrame:
    """Tenant scope; every read takes it as an optional argument."""
    return df if tenant_id is None else df.where(F.col("tenant_id") == F.lit(tenant_id))


def _present(df: DataFrame, names) -> list[Column]:
    """The named columns, absent ones as NULLs of the request log's types."""
    have = set(df.columns)
    kinds = {f.name: f.dataType for f in requests_schema(NAMES).fields}
    return [F.col(n) if n in have else F.lit(None).cast(kinds[n]).alias(n) for n in names]


def nested(requests: DataFrame) -> DataFrame:
    """Request rows with ``flags`` as an array and scores and latencies as structs."""
    have = set(requests.columns)

    def pick(prefix: str, names, kind: str) -> Column:
        return F.struct(
            *[
                (F.col(f"{prefix}_{n}") if f"{prefix}_{n}" in have else F.lit(None).cast(kind)).alias(n)
                for n in names
            ]
        )

    kept = (
        "id", "created_at", "tenant_id", "model", "blocked", "block_reason", "latency_total",
        "input_text", "input_redacted", "has_context", "reviewed", "review_label", "reviewer_note",
    )
    return requests.select(
        *[n for n in kept if n in have],
        flag_names().alias("flags"),
        pick("score", NAMES, "double").alias("scores"),
        pick("latency", (*NAMES, "llm", "total"), "int").alias("latency_ms"),
    )


def in_time(requests: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with ``start <= created_at <= end``. On a stored log the same range is also put on
    its partition column ``dt``, so that days outside it are not listed or read."""
    kind = requests.schema["created_at"].dataType
    stored = "dt" in requests.columns
    if start is not None:
        requests = requests.where(F.col("created_at") >= start.cast(kind))
        if stored:
            requests = requests.where(F.col("dt") >= F.to_date(start.cast(kind)))
    if end is not None:
        requests = requests.where(F.col("created_at") <= end.cast(kind))
        if stored:
            requests = requests.where(F.col("dt") <= F.to_date(end.cast(kind)))
    return requests


def score_history(
    requests: DataFrame,
    tenant_id=None,
    start=None,
    end=None,
    flagged_only: bool = False,
    evaluator: str | None = None,
) -> DataFrame:
    """Rows in the inclusive time range, optionally flagged only; an unknown evaluator is ignored."""
    df = in_time(
        for_tenant(requests, tenant_id),
        None if start is None else F.lit(start),
        None if end is None else F.lit(end),
    )
    if flagged_only:
        df = df.where(any_flag())
    if evaluator in NAMES:
        df = df.where(F.col(f"flag_{evaluator}"))
    return df


def by_id(requests: DataFrame, request_id, tenant_id) -> DataFrame:
    """One request of one tenant; another tenant's id gives no row."""
    return requests.where((F.col("id") == F.lit(request_id)) & (F.col("tenant_id") == F.lit(tenant_id)))


def by_ids(requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bulk form of :func:`by_id`: ``wanted`` holds (id, tenant_id) pairs."""
    return requests.join(wanted.select("id", "tenant_id"), ["id", "tenant_id"], "left_semi")


def review_queue(requests: DataFrame, tenant_id=None, limit: int = 20) -> DataFrame:
    """Unreviewed flagged rows, oldest first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    queue = for_tenant(requests, tenant_id).where(~F.col("reviewed") & any_flag())
    return queue.orderBy("created_at", "id").limit(limit)


def flagged_view(requests: DataFrame) -> DataFrame:
    """Rows with any flag or a block, in the view's 25 columns. Consumers order it."""
    rows = requests.where(any_flag() | F.col("blocked"))
    return rows.select(*_present(requests, FLAGGED_VIEW_COLUMNS))


def page(requests: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One page, newest first. Use :func:`page_after` for deep pages."""
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1 and limit must be between 1 and 200")
    ordered = requests.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered.offset((page - 1) * limit).limit(limit)


def page_after(requests: DataFrame, created_at, id, limit: int = 50) -> DataFrame:
    """The page after the given last row: a range filter and a top-k, whatever the depth."""
    kind = requests.schema["created_at"].dataType
    last = F.lit(created_at).cast(kind)
    older = (F.col("created_at") < last) | ((F.col("created_at") == last) & (F.col("id") < F.lit(id)))
    return requests.where(older).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def total(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("total"))


def newest(requests: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` rows of every tenant.

    The rank filter lets Spark keep only ``n`` rows per tenant and task before the shuffle, so a
    dominant tenant does not move whole.
    """
    order = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("id"))
    return requests.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews with a label outside the accepted three."""
    return reviews.where(~F.coalesce(F.col("label").isin(*REVIEW_LABELS), F.lit(False)))


def apply_reviews(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """Requests with the latest valid review of their own tenant; later reviews overwrite.

    ``reviews`` is append-only: (review_id, request_id, tenant_id, label, reviewed_at[, note]).
    """
    note = F.col("note") if "note" in reviews.columns else F.lit(None).cast("string")
    latest = (
        reviews.where(F.col("label").isin(*REVIEW_LABELS))
        .groupBy(F.col("request_id").alias("id"), "tenant_id")
        .agg(
            F.max_by(
                F.struct("label", note.alias("note"), "reviewed_at"),
                F.struct("reviewed_at", "review_id"),
            ).alias("review")
        )
    )
    replaced = ("reviewed", "review_label", "reviewer_note", "reviewed_at")
    seen = F.col("review").isNotNull()
    have = set(requests.columns)

    def merged(field: str, old: str, kind: str) -> Column:
        before = F.col(old) if old in have else F.lit(None).cast(kind)
        return F.when(seen, F.col(f"review.{field}")).otherwise(before).alias(old)

    reviewed = F.col("reviewed") if "reviewed" in have else F.lit(False)
    joined = requests.join(latest, ["id", "tenant_id"], "left")
    return joined.select(
        *[c for c in requests.columns if c not in replaced],
        (seen | reviewed).alias("reviewed"),
        merged("label", "review_label", "string"),
        merged("note", "reviewer_note", "string"),
        merged("reviewed_at", "reviewed_at", reviews.schema["reviewed_at"].dataType.simpleString()),
    )
