"""Tenants and API keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_tenant(tenants: DataFrame) -> DataFrame:
    """The single default tenant's id, as a one-row frame for use as a scalar subquery."""
    return tenants.where("is_default").select(F.max("tenant_id"))


def backfill_tenant(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows without a tenant get the default tenant."""
    return df.withColumn("tenant_id", F.coalesce(F.col("tenant_id"), default_tenant(tenants).scalar()))


def resolve_tenants(
    log: DataFrame,
    api_keys: DataFrame,
    tenants: DataFrame,
    auth_required: bool = True,
    master_key: str | None = None,
) -> DataFrame:
    """Tenant of each logged call from the hash of its ``api_key``.

    A key counts until its ``revoked_at``. The master key, and any unknown key while authentication is off,
    map to the default tenant; otherwise the call is rejected with no tenant. The key tables are
    joined without a hint: Spark broadcasts them while they are under its size threshold and
    otherwise shuffles, splitting a dominant key.
    """
    keys = api_keys.join(tenants.select("tenant_id", "slug"), "tenant_id").select(
        F.col("key_hash").alias("_hash"), F.col("tenant_id").alias("_tenant"), "revoked_at"
    )
    hashed = log.withColumn("key_hash", F.sha2("api_key", 256))
    active = F.col("revoked_at").isNull() | (F.col("ts") < F.col("revoked_at"))
    found = hashed.join(keys, (F.col("key_hash") == F.col("_hash")) & active, "left")
    default = default_tenant(tenants).scalar()
    is_master = F.coalesce(F.col("api_key") == F.lit(master_key), F.lit(False))
    if not auth_required:
        is_master = F.lit(False)
    known = F.col("_hash").isNotNull()
    status = F.when(is_master, "master").when(known, "resolved")
    status = status.otherwise("rejected" if auth_required else "default")
    tenant = F.when(is_master, default).when(known, F.col("_tenant"))
    if not auth_required:
        tenant = F.coalesce(tenant, default)
    return found.select(*log.columns, "key_hash", tenant.alias("tenant_id"), status.alias("auth_status"))


def key_usage(api_keys: DataFrame, tenants: DataFrame, log: DataFrame, tenant_id=None) -> DataFrame:
    """Each key with its tenant, status, last use and calls; ``log`` has ``key_hash`` and ``ts``.

    Calls after a key was revoked were rejected and do not count.
    """
    keys = api_keys if tenant_id is None else api_keys.where(F.col("tenant_id") == F.lit(tenant_id))
    listed = keys.join(tenants.select("tenant_id", F.col("slug").alias("tenant_slug")), "tenant_id")
    calls = log.select(F.col("key_hash").alias("_hash"), "ts")
    revocations = listed.select(F.col("key_hash").alias("_hash"), "revoked_at")
    accepted = calls.join(revocations, "_hash").where(
        F.col("revoked_at").isNull() | (F.col("ts") < F.col("revoked_at"))
    )
    used = accepted.groupBy("_hash").agg(F.max("ts").alias("last_used_at"), F.count("*").alias("n_calls"))
    joined = listed.join(used, F.col("key_hash") == F.col("_hash"), "left")
    return joined.select(
        "key_prefix",
        "tenant_id",
        "tenant_slug",
        F.when(F.col("revoked_at").isNull(), "active").otherwise("revoked").alias("status"),
        "last_used_at",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
    )


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` plus the rows whose key it does not hold yet (insert, do nothing on conflict).

    Of several new rows with one key the smallest stays, comparing their other columns in order;
    a NULL key conflicts with nothing, so all its rows are inserted.
    """
    others = [c for c in rows.columns if c != key]
    named = rows.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")) if others else named.distinct()
    one = first.select(key, "_row.*") if others else first
    fresh = one.join(table.select(key), key, "left_anti").select(*rows.columns)
    return table.unionByName(fresh).unionByName(rows.where(F.col(key).isNull()))
