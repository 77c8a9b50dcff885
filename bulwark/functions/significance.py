"""Two-sided p-value of the Mann-Whitney U statistic, applied to a few aggregated rows."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the exact distribution is used up to this smaller sample when there are no ties.
EXACT_MAX = 8


def normal_p(u: float, n1: float, n2: float, ties: float) -> float:
    """Tie-corrected normal approximation with continuity correction; 1 when all values tie."""
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, max(0.0, math.erfc(z / math.sqrt(2.0))))


@lru_cache(maxsize=EXACT_MAX)
def _cycle(parts: int) -> tuple[int, tuple[int, ...]]:
    """(D, N): 1 / ((1 - q) (1 - q) ... (1 - q^parts)) = N(q) / (1 - q^D)^(parts + 1)."""
    cycle = math.lcm(*range(1, parts + 1))
    poly = [1]
    for step in (1, *range(1, parts + 1)):
        longer = [0] * (len(poly) + cycle - step)
        for shift in range(0, cycle, step):
            for i, c in enumerate(poly):
                longer[i + shift] += c
        poly = longer
    return cycle, tuple(poly)


def _sums_up_to(m: int, parts: int) -> int:
    """How many multisets of 1..``parts`` have a sum of at most ``m``."""
    if m < 0:
        return 0
    cycle, poly = _cycle(parts)
    return sum(poly[r] * math.comb((m - r) // cycle + parts, parts) for r in range(m % cycle, min(m, len(poly) - 1) + 1, cycle))


def exact_p(u: float, n1: int, n2: int) -> float:
    """Exact null distribution for samples of any size, in whole numbers.

    U is distributed as the sum of a partition that fits a box of the two sample sizes. With
    ``small`` rows, that is prod (1 - q^(large + i)) / (1 - q^i): at most 2^small signed powers
    over a product whose coefficients have a closed form, so the large sample costs nothing.
    """
    small, large = min(n1, n2), max(n1, n2)
    # U is symmetric, so the upper tail equals the lower one.
    tail = n1 * n2 - int(max(u, n1 * n2 - u))
    signed = {0: 1}
    for i in range(1, small + 1):
        for power, c in list(signed.items()):
            if power + large + i <= tail:
                signed[power + large + i] = signed.get(power + large + i, 0) - c
    ways = sum(c * _sums_up_to(tail - power, small) for power, c in signed.items())
    return min(1.0, 2 * ways / math.comb(small + large, small))


def p_value(u: float, n1: float, n2: float, ties: float) -> float:
    exact = min(n1, n2) <= EXACT_MAX and ties == 0
    return exact_p(u, int(n1), int(n2)) if exact else normal_p(u, n1, n2, ties)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """The p-value of rows that are tested; a row with a NULL is not, and costs nothing."""
    known = {}  # groups of equal sizes often share a statistic
    out = []
    for row in zip(u, n1, n2, ties):
        if any(v != v or v is None for v in row):
            out.append(None)
            continue
        if row not in known:
            known[row] = p_value(*row) if min(row[1], row[2]) > 0 else 1.0
        out.append(known[row])
    return pd.Series(out, dtype="float64")
