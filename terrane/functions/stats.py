"""Statistics of defined values, as aggregate or window expressions. NULL is undefined and is skipped.

They follow the rules of the field rather than SQL's: the variance of fewer than two values is 0, the median of an even
count is its lower middle, the extreme is the greater of minimum and maximum by absolute value (the maximum on a tie).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def variance(v: Column) -> Column:
    return F.coalesce(F.when(F.count(v) > 1, F.var_samp(v)), F.lit(0.0))


def stddev(v: Column) -> Column:
    return F.sqrt(F.greatest(variance(v), F.lit(0.0)))


def norm_variance(v: Column) -> Column:
    """variance / (mean^2 + variance / 10); 0 for fewer than two values."""
    return F.coalesce(F.try_divide(variance(v), F.avg(v) * F.avg(v) + 0.1 * variance(v)), F.lit(0.0))


def extreme(v: Column) -> Column:
    return F.when(F.abs(F.max(v)) < F.abs(F.min(v)), F.min(v)).otherwise(F.max(v))






def weighted_mean(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))


def weighted_rms(v: Column, w: Column) -> Column:
    return F.sqrt(F.sum(v * v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)))


def grubbs(v: Column) -> Column:
    """The greatest distance from the mean in population standard deviations; 0 for fewer than three or equal values."""
    far = F.greatest(F.avg(v) - F.min(v), F.max(v) - F.avg(v))
    return F.when((F.count(v) < 3) | (F.max(v) == F.min(v)), 0.0).otherwise(far / F.stddev_pop(v))


#: Statistics by name, for operators that take the name of one.
BY_NAME = {
    "count": F.count, "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "rms": rms, "variance": variance,
    "stddev": stddev, "norm_variance": norm_variance, "extreme": extreme,
}
