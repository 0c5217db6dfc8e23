"""Two-sided p-value of a correlation, from built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounds of the continued fraction, which needs about the square root of the number of points: enough for 10,000.
ROUNDS = 200
# From here on the series of the beta function is exact to 1e-12.
LARGE = 64.0


def _log_beta_half(a: Column, df: Column) -> Column:
    """``ln B(df/2, 1/2)``: by the recurrence that lowers its first argument by one, or its series for large ones."""
    base = F.when(df % 2 == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    start = F.when(df % 2 == 1, F.log(F.lit(3.141592653589793))).otherwise(F.log(F.lit(2.0)))
    steps = F.floor(F.least(a, F.lit(LARGE)) - base).cast("int")
    indexes = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(
        F.array().cast("array<int>")
    )
    exact = F.aggregate(
        indexes, start, lambda total, i: total + F.log((base + i) / (base + i + 0.5))
    )
    u = 1.0 / a
    ratio = 1.0 - u / 8 + u * u / 128 + 5 * u * u * u / 1024 - 21 * u * u * u * u / 32768
    series = 0.5 * F.log(F.lit(3.141592653589793)) - 0.5 * F.log(a) - F.log(ratio)
    return F.when(a < LARGE, exact).otherwise(series)


def _continued_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards."""
    d0 = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    state = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def advance(s, factor):
        d = 1.0 / (1.0 + factor * s["d"])
        c = 1.0 + factor / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def both(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        return advance(advance(s, even), odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, both)["h"]


def correlation_p_value(r: Column, n: Column) -> Column:
    """P-value of a zero correlation (equally: of a zero slope) from ``r`` over ``n`` points,
    for up to 10,000 points; an array of at most 200 numbers is laid out per row.

    With ``x = 1 - r^2`` and ``n - 2`` degrees of freedom it is the regularised
    incomplete beta function ``I_x((n-2)/2, 1/2)``.
    """
    df = n - 2
    a = df / 2.0
    half = F.lit(0.5)
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - r * r))
    inner = F.greatest(F.lit(1e-300), x)
    outer = F.greatest(F.lit(1e-300), 1.0 - x)
    front = F.exp(a * F.log(inner) + half * F.log(outer) - _log_beta_half(a, df))
    direct = front * _continued_fraction(a, half, x) / a
    mirrored = 1.0 - front * _continued_fraction(half, a, 1.0 - x) / half
    p = F.when(x < (a + 1.0) / (a + 2.5), direct).otherwise(mirrored)
    return (
        F.when(df < 1, F.lit(None).cast("double"))
        .when(x <= 0.0, F.lit(0.0))
        .when(x >= 1.0, F.lit(1.0))
        .otherwise(p)
    )
