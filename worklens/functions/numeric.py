"""Arithmetic shared by the scoring, profile and detector operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c, digits: int) -> Column:
    """Half-up rounding through DECIMAL, so that a double's last bit cannot flip a tie."""
    return F.round(col(c).cast("decimal(38,8)"), digits).cast("double")


def ramp(value, floor: float, ceiling: float) -> Column:
    """0 at or below ``floor`` and for NULL, 100 at or above ``ceiling``, linear between."""
    v = col(value).cast("double")
    span = float(ceiling) - float(floor)
    return (
        F.when(v.isNull() | (v <= F.lit(float(floor))), F.lit(0.0))
        .otherwise(F.least((v - F.lit(float(floor))) / F.lit(span) * 100, F.lit(100.0)))
    )


def clamp(c, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.least(col(c), F.lit(float(high))), F.lit(float(low)))


def safe_rate(numerator, denominator, digits: int | None = 1) -> Column:
    """Percentage, NULL unless the denominator is positive."""
    num, den = col(numerator).cast("double"), col(denominator).cast("double")
    rate = F.try_divide(num, den) * 100
    return F.when(den > 0, rate if digits is None else rounded(rate, digits))


def share_of(part, whole, digits: int = 1) -> Column:
    """Percentage of a count, 0 when there is nothing to take a share of."""
    return F.coalesce(safe_rate(part, whole, digits), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value) -> Column:
    """SUM over matching rows, 0 when none match; money stays DECIMAL while summing."""
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0)).cast("double")


def total(value) -> Column:
    return F.coalesce(F.sum(col(value)), F.lit(0)).cast("double")


def mean_of(value, digits: int | None = None) -> Column:
    """Exact-order-free mean: the values have at most 8 decimals, so they sum as DECIMAL."""
    v = col(value).cast("decimal(24,8)")
    mean = F.sum(v).cast("double") / F.count(v)
    mean = F.when(F.count(v) > 0, mean)
    return mean if digits is None else rounded(mean, digits)


def fiscal_start(date) -> Column:
    """First calendar year of the April-March fiscal year a date falls in."""
    return F.year(F.add_months(col(date), -3))


def fiscal_year(date) -> Column:
    """``2024-04-01`` -> ``2024-25``."""
    return fiscal_label(fiscal_start(date))


def fiscal_label(first_year) -> Column:
    """``2024`` -> ``2024-25``."""
    start = col(first_year)
    tail = F.lpad(((start % 100) + 1).cast("string"), 2, "0")
    # 1999-00 style roll-over is not special-cased: the label keeps "100".
    tail = F.when(start % 100 == 99, F.lit("100")).otherwise(tail)
    return F.concat_ws("-", start.cast("string"), tail)


def first_digit(amount) -> Column:
    """Leading digit of the absolute value; NULL under 1."""
    size = F.abs(col(amount).cast("double"))
    scale = F.pow(F.lit(10.0), F.floor(F.log10(size)).cast("double"))
    return F.when(size >= 1, F.floor(size / scale).cast("int"))


def share_bin(share, edges=(5, 15, 25, 35)) -> Column:
    """Index of the first class whose upper edge lies above the share; NULL stays NULL."""
    s = col(share)
    binned = F.when(s.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        binned = binned.when(s < edge, F.lit(i))
    return binned.otherwise(F.lit(len(edges)))


def performance_band(rate, high: float = 80.0, average: float = 50.0) -> Column:
    r = col(rate)
    return F.when(r >= high, "high").when(r >= average, "average").otherwise("low")
