"""Double-exponential survivor curves as column expressions.

A curve is kept as *runs*: all ranks that share one interval length ``t`` form one
row (``k_lo``..``k_hi`` of ``n``), and a point of the run has height ``k / n``. The
sums a fit needs over the points of a run have closed forms, so no run is ever
expanded, however many rows fell on one value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_FLOOR = 1e-10
EXACT_TERMS = 32


def survivor(t: Column, a1: Column, l1: Column, a2: Column, l2: Column) -> Column:
    return a1 * F.exp(-l1 * t) + a2 * F.exp(-l2 * t)


def log_survivor(t: Column, a1: Column, l1: Column, a2: Column, l2: Column) -> Column:
    return F.log(survivor(t, a1, l1, a2, l2) + F.lit(LOG_FLOOR))


def run_mean(k_lo: Column, k_hi: Column, n: Column) -> Column:
    """Mean height of a run."""
    return (k_lo + k_hi) / (2.0 * n)


def run_mean_log(k_lo: Column, k_hi: Column, n: Column) -> Column:
    """Mean of ``ln(k/n + floor)`` over a run.

    The first terms are summed one by one. What is left of a long run follows from
    the Euler-Maclaurin formula, whose error past rank 32 is below 1e-12; the
    integral is written with ``log1p`` so that large ranks lose no digits.
    """
    shift = n * F.lit(LOG_FLOOR)
    head_end = F.least(k_hi, k_lo + (EXACT_TERMS - 1))
    head = F.aggregate(
        F.sequence(k_lo, head_end), F.lit(0.0), lambda total, k: total + F.log(k + shift)
    )
    first = k_lo + EXACT_TERMS + shift
    last = k_hi + shift
    width = last - first
    integral = width * (F.log(first) - 1.0) + last * F.log1p(width / first)
    ends = (F.log(first) + F.log(last)) / 2.0
    curvature = (1.0 / last - 1.0 / first) / 12.0
    third = (1.0 / F.pow(last, F.lit(3.0)) - 1.0 / F.pow(first, F.lit(3.0))) / 360.0
    tail = F.when(k_hi >= k_lo + EXACT_TERMS, integral + ends + curvature - third).otherwise(0.0)
    return (head + tail) / (k_hi - k_lo + 1) - F.log(n.cast("double"))


def run_spread(k_lo: Column, k_hi: Column, n: Column) -> Column:
    """Sum of squared deviations of the points of a run from their mean."""
    m = (k_hi - k_lo + 1).cast("double")
    return m * (m * m - 1.0) / (12.0 * n * n)


def run_absolute_error(k_lo: Column, k_hi: Column, n: Column, value: Column) -> Column:
    """Sum of ``|k/n - value|`` over a run: the ranks below ``value * n`` and those above it."""
    split = F.greatest(k_lo - 1, F.least(k_hi, F.floor(value * n)))
    below = split - k_lo + 1
    above = k_hi - split
    sum_below = (k_lo + split) * below / (2.0 * n)
    sum_above = (split + 1 + k_hi) * above / (2.0 * n)
    return (value * below - sum_below) + (sum_above - value * above)
