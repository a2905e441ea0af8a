"""Arithmetic with the rounding and missing-value rules of the race data.

Numbers round half up (towards positive infinity), a missing or zero value takes
a stated default where a rule says so, a rate over nothing is 0, and a mean over
nothing is null.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def half_up(x, digits: int = 0) -> Column:
    """``x`` rounded half up; a long for no digits, a double otherwise; null stays null."""
    x = col(x)
    if not digits:
        return F.floor(x + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x, low, high) -> Column:
    """``x`` held between two bounds; null stays null (``least`` alone would skip it)."""
    x = col(x).cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def clamp_or_zero(x, low=0, high=100) -> Column:
    """Like :func:`clamp`, with a missing or non-numeric value as 0."""
    return clamp(F.coalesce(col(x).try_cast("double"), F.lit(0.0)), low, high)


def score(x) -> Column:
    """A score from 0 to 100, rounded."""
    return clamp(half_up(x), 0, 100).cast("long")


def default(x, value) -> Column:
    """``value`` where ``x`` is null, zero, an empty string or not a number."""
    x = col(x)
    return F.when(x.isNull() | x.cast("string").isin("", "0", "0.0", "NaN"), F.lit(value)).otherwise(x)


def rate(part, whole) -> Column:
    """``part / whole`` as a double, 0 over nothing."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, part.cast("double") / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def mean_or_null(total, n) -> Column:
    total, n = col(total), col(n)
    return F.when(n > 0, total / F.when(n > 0, n))


def count_where(condition) -> Column:
    """Rows for which ``condition`` holds, as a long."""
    return F.count(F.when(condition, F.lit(1)))


def total(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def peak_and_mean(xs, peak: float, mean: float) -> Column:
    """A pool of non-negative scores: ``peak`` of its largest and ``mean`` of its average, rounded."""
    xs = list(xs)
    largest = F.greatest(F.lit(0), *xs) if len(xs) > 1 else F.greatest(F.lit(0), xs[0])
    return half_up(largest * peak + total(xs) / len(xs) * mean)
