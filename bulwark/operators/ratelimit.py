"""Rate limiting over a request log, with windows anchored at their first event.

A caller's window opens with its first event and lasts 60 seconds; the first event after it
opens the next one. Where a window opens depends on all earlier ones, so neither clock-aligned
nor session windows fit. The replay stays parallel within a single busy caller:

1. events collapse to distinct (identity, time), so a caller's rows are bounded by the clock;
2. each (identity, hour) chunk computes, for every time a window could first open in it, when
   the last window opened there would end: a step table of at most one window of times;
3. step tables of FAN_IN chunks compose to one of the same size, level by level, until a caller
   has at most FAN_IN of them; those are chained, and each level passes its entries down. No task
   sees more than FAN_IN step tables, however long or dense a caller's traffic;
4. each chunk lists the windows opened in it;
5. events find their window by an equi-join on (identity, minute). Their position is the running
   total of earlier times in the window plus their place among the events of the same time.

A NULL identity is one caller of its own. Events without a time are passed on undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bulwark.session import stored

# Window length and default quota.
WINDOW_MS = 60_000
DEFAULT_LIMIT = 60
CHUNK_MS = 3_600_000
# Step tables that one task composes or chains.
FAN_IN = 64
_NEVER = np.iinfo(np.int64).min


def caller(tenant_id: Column, client_ip: Column) -> Column:
    """Identity a limit applies to: the tenant, else the client address."""
    return F.coalesce(tenant_id.cast("string"), client_ip, F.lit("unknown"))


def _next_starts(times: np.ndarray, width: int) -> np.ndarray:
    """Index of the first event that no longer fits a window opened at each event."""
    return np.searchsorted(times, times + width, side="left")


def chunk_exits(times: np.ndarray, chunk_start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, exit): a window chain entering the chunk at a threshold ``<= upto`` leaves at ``exit``.

    Only thresholds in the first ``width`` of the chunk can occur. Chains from different entries
    soon merge, so equal exits collapse to few rows.
    """
    n = len(times)
    nxt = _next_starts(times, width)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    reach = min(int(np.searchsorted(times, chunk_start + width, side="left")) + 1, n)
    upto, exits = times[:reach], times[last[:reach]] + width
    ends = np.append(exits[1:] != exits[:-1], True)
    return upto[ends], exits[ends]


def chain_starts(times: np.ndarray, entry: int, width: int) -> np.ndarray:
    """Times at which windows open, when none may open before ``entry``."""
    starts = []
    i = int(np.searchsorted(times, entry, side="left"))
    while i < len(times):
        starts.append(times[i])
        i = int(np.searchsorted(times, times[i] + width, side="left"))
    return np.asarray(starts, dtype=np.int64)


def _steps(pdf: pd.DataFrame, column: str = "chunk") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, upto, exit) of each chunk in time order."""
    pdf = pdf.sort_values([column, "upto"])
    chunk, first = np.unique(pdf[column].to_numpy(np.int64), return_index=True)
    upto, exit_ = pdf["upto"].to_numpy(np.int64), pdf["exit"].to_numpy(np.int64)
    bounds = np.append(first, len(pdf))
    return [(int(c), upto[lo:hi], exit_[lo:hi]) for c, lo, hi in zip(chunk, bounds, bounds[1:])]


def compose(tables: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One step table for consecutive chunks: where a chain that enters the first leaves the last.

    A threshold beyond all rows of a table passes it unchanged.
    """
    _, upto, exits = tables[0]
    for _, next_upto, next_exit in tables[1:]:
        at = np.searchsorted(next_upto, exits, side="left")
        inside = at < len(next_upto)
        moved = exits.copy()
        moved[inside] = next_exit[at[inside]]
        beyond = next_upto > upto[-1]
        upto, exits = np.concatenate([upto, next_upto[beyond]]), np.concatenate([moved, next_exit[beyond]])
    ends = np.append(exits[1:] != exits[:-1], True)
    return upto[ends], exits[ends]


def chain(tables: list[tuple[int, np.ndarray, np.ndarray]], entry: int) -> np.ndarray:
    """The entry of each chunk, when ``entry`` is that of the first."""
    out = np.empty(len(tables), dtype=np.int64)
    for j, (_, upto, exits) in enumerate(tables):
        out[j] = entry
        at = int(np.searchsorted(upto, entry, side="left"))
        if at < len(upto):
            entry = int(exits[at])
    return out


def windows(
    log: DataFrame, identity: str, time_ms: str, width_ms: int = WINDOW_MS, chunk_ms: int = CHUNK_MS, fan_in: int = FAN_IN
) -> DataFrame:
    """(identity, window_start): every window of every caller; events without a time are ignored."""
    kind = log.schema[identity].dataType.simpleString()
    times = (
        log.select(F.col(identity).alias("identity"), F.col(time_ms).alias("t"))
        .where(F.col("t").isNotNull())
        .groupBy("identity", "t")
        .agg(F.floor(F.col("t") / chunk_ms).alias("chunk"))
    )
    table = f"identity {kind}, chunk long, upto long, exit long"

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy(np.int64))
        upto, exit_ = chunk_exits(t, int(key[1]) * chunk_ms, width_ms)
        return _rows(key, chunk=int(key[1]), upto=upto, exit=exit_)

    def composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        upto, exit_ = compose(_steps(pdf))
        return _rows(key, chunk=int(key[1]), upto=upto, exit=exit_)

    def top(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = _steps(pdf)
        return _rows(key, chunk=[c for c, _, _ in tables], entry=chain(tables, _NEVER))

    def below(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = _steps(pdf)
        return _rows(key, chunk=[c for c, _, _ in tables], entry=chain(tables, int(pdf["entry"].iloc[0])))

    def starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy(np.int64))
        return _rows(key, window_start=chain_starts(t, int(pdf["entry"].iloc[0]), width_ms))

    parent = F.floor(F.col("chunk") / fan_in)
    levels = [stored(times.groupBy("identity", "chunk").applyInPandas(exits, table), "steps")]
    first, last = levels[0].agg(F.min("chunk"), F.max("chunk")).first()
    while first is not None and last - first >= fan_in:
        up = levels[-1].groupBy("identity", parent.alias("chunk_")).applyInPandas(composed, table)
        levels.append(stored(up, "steps"))
        first, last = first // fan_in, last // fan_in
    entry = levels[-1].groupBy("identity").applyInPandas(top, f"identity {kind}, chunk long, entry long")
    for steps in reversed(levels[:-1]):
        held = entry.select(F.col("identity").alias("_who"), F.col("chunk").alias("_parent"), "entry")
        met = steps.join(held, F.col("identity").eqNullSafe(F.col("_who")) & (parent == F.col("_parent")))
        entry = met.groupBy("identity", "_parent").applyInPandas(below, f"identity {kind}, chunk long, entry long")
    held = entry.select(F.col("identity").alias("_who"), F.col("chunk").alias("_chunk"), "entry")
    met = times.join(held, F.col("identity").eqNullSafe(F.col("_who")) & (F.col("chunk") == F.col("_chunk")))
    return met.groupBy("identity", "chunk").applyInPandas(starts, f"identity {kind}, window_start long")


def _rows(key: tuple, **columns) -> pd.DataFrame:
    """Rows of one caller; a missing identity stays missing."""
    out = pd.DataFrame(columns)
    who = None if pd.isna(key[0]) else key[0]
    out.insert(0, "identity", pd.Series([who] * len(out), dtype=object))
    return out


def replay_limits(
    log: DataFrame,
    identity: str = "identity",
    time_ms: str = "arrival_ms",
    event_id: str = "event_id",
    limit: int = DEFAULT_LIMIT,
    width_ms: int = WINDOW_MS,
    enabled: bool = True,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Each event with its window, its position in it, and whether it is allowed.

    Events beyond the limit are rejected and still count. ``retry_after_s`` is the whole seconds
    left in the window, at least 1. ``carried`` holds each caller's last window of an earlier part
    of the log, (identity, window_start, count): it goes on from there, and an event that comes
    late for it counts in it. An event without a time has no window and no decision.
    """
    none = F.lit(None).cast("long")
    if not enabled:
        return log.withColumns(
            {"window_start": none, "position": none, "allowed": F.lit(True), "retry_after_s": none}
        )
    undecided = log.where(F.col(time_ms).isNull()).withColumns(
        {"window_start": none, "position": none, "allowed": F.lit(None).cast("boolean"), "retry_after_s": none}
    )
    log = log.where(F.col(time_ms).isNotNull())
    if carried is not None:
        held = carried.select(
            F.col("identity").alias("_held_by"),
            F.col("window_start").alias("_held_start"),
            F.col("count").alias("_held_count"),
        )
        timed = log.join(held, F.col(identity).eqNullSafe(F.col("_held_by")), "left").withColumn(
            "_at", F.greatest(F.col(time_ms), F.col("_held_start"))
        )
        opening = timed.select(F.col(identity).alias("identity"), F.col("_at")).unionByName(
            held.select(F.col("_held_by").alias("identity"), F.col("_held_start").alias("_at"))
        )
    else:
        timed = log.withColumns({"_at": F.col(time_ms), "_held_start": none, "_held_count": none})
        opening = timed.select(F.col(identity).alias("identity"), "_at")
    # A window touches its own slot of the clock and the one after it.
    slot = F.floor(F.col("window_start") / width_ms)
    opened = windows(opening, "identity", "_at", width_ms).select(
        F.col("identity").alias("_identity"),
        "window_start",
        F.explode(F.array(slot, slot + 1)).alias("_slot"),
    )
    same = (
        F.col(identity).eqNullSafe(F.col("_identity"))
        & (F.floor(F.col("_at") / width_ms) == F.col("_slot"))
        & (F.col("_at") >= F.col("window_start"))
        & (F.col("_at") < F.col("window_start") + width_ms)
    )
    before = F.when(F.col("window_start") == F.col("_held_start"), F.col("_held_count")).otherwise(0)
    placed = timed.join(opened, same).withColumn("_before", before)
    # Distinct times of a window are bounded by the clock; events of one time by their number alone.
    moment = [F.col(identity).alias("_w_identity"), F.col("window_start").alias("_w_start"), F.col("_at").alias("_w_at"), F.col(time_ms).alias("_w_time")]
    earlier = Window.partitionBy("_w_identity", "_w_start").orderBy("_w_at", "_w_time").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*moment).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    )
    at_once = Window.partitionBy(identity, "window_start", "_at", time_ms).orderBy(event_id)
    of_moment = (
        F.col(identity).eqNullSafe(F.col("_w_identity")) & (F.col("window_start") == F.col("_w_start"))
        & (F.col("_at") == F.col("_w_at")) & (F.col(time_ms) == F.col("_w_time"))
    )
    numbered = placed.withColumn("_place", F.row_number().over(at_once)).join(totals, of_moment).withColumn(
        "position", F.col("_earlier") + F.col("_place") + F.col("_before")
    )
    left = F.col("window_start") + width_ms - F.col("_at")
    over = F.col("position") > limit
    wait = F.greatest(F.ceil(left / F.lit(1000)).cast("long"), F.lit(1).cast("long"))
    decided = numbered.select(
        *log.columns,
        "window_start",
        F.col("position").cast("long").alias("position"),
        (~over).alias("allowed"),
        F.when(over, wait).alias("retry_after_s"),
    )
    return decided.unionByName(undecided)


def last_windows(
    decided: DataFrame, carried: DataFrame | None = None, identity: str = "identity"
) -> DataFrame:
    """Each caller's newest window with its count: the state to carry to the next part."""
    state = decided.where(F.col("window_start").isNotNull()).select(
        F.col(identity).alias("identity"), "window_start", F.col("position").alias("count")
    )
    if carried is not None:
        state = state.unionByName(carried.select("identity", "window_start", "count"))
    newest = F.max(F.struct("window_start", "count")).alias("w")
    return state.groupBy("identity").agg(newest).select("identity", "w.*")
