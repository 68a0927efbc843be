"""Aggregates and scalar helpers as Column expressions; nulls stand for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean(x) -> Column:
    return F.coalesce(F.avg(_c(x)), F.lit(0.0))


def variance(x) -> Column:
    """With n - 1; 0 for fewer than two values."""
    return F.coalesce(F.var_samp(_c(x)), F.lit(0.0))


def stdev(x) -> Column:
    return F.coalesce(F.stddev_samp(_c(x)), F.lit(0.0))


def skew(x) -> Column:
    """Adjusted Fisher-Pearson; 0 for fewer than three values or no spread."""
    x = _c(x)
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))), n - 2)
    return F.when((F.count(x) >= 3) & (stdev(x) > 0), F.skewness(x) * factor).otherwise(0.0)


def excess_kurtosis(x) -> Column:
    """Mean fourth power of z with the sample deviation, less 3; 0 for fewer than four values or no spread."""
    x = _c(x)
    n = F.count(x).cast("double")
    ratio = F.try_divide(n - 1, n)
    return F.when((F.count(x) >= 4) & (stdev(x) > 0), (F.kurtosis(x) + 3) * ratio * ratio - 3).otherwise(0.0)


def correlation(x, y) -> Column:
    """Pearson; 0 for fewer than three pairs or a constant side."""
    x, y = _c(x), _c(y)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 3, F.coalesce(r, F.lit(0.0))).otherwise(0.0)


def quantile(x, q: float) -> Column:
    """Linear interpolation; 0 on nothing."""
    return F.coalesce(F.percentile(_c(x), q), F.lit(0.0))


def median(x) -> Column:
    return quantile(x, 0.5)


def upper_median(x) -> Column:
    """The value at place floor(n / 2) in ascending order."""
    a = F.array_sort(F.collect_list(_c(x)))
    return F.coalesce(F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1), F.lit(0.0))


def lower_median(x) -> Column:
    """The value at place floor(n / 2) in descending order."""
    a = F.sort_array(F.collect_list(_c(x)), asc=False)
    return F.coalesce(F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1), F.lit(0.0))


def clamp(x, low, high) -> Column:
    """Null stays null: greatest and least pass nulls over."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x, fallback: float = 0.0) -> Column:
    x = _c(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(x)


def half_up(x) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(_c(x) + 0.5)


def sharpe(mu: Column, sd: Column, days: int = 252) -> Column:
    return F.coalesce(F.try_divide(mu, F.when(sd > 0, sd)) * F.sqrt(F.lit(float(days))), F.lit(0.0))
