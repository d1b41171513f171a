"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Right-closed upper bounds of the creator-frequency buckets.
FREQUENCY_BUCKETS = ((1, "1"), (2, "2"), (5, "3-5"), (20, "6-20"), (100, "21-100"))
FREQUENCY_TOP = "100+"
FREQUENCY_LABELS = [label for _, label in FREQUENCY_BUCKETS] + [FREQUENCY_TOP]


def rounded(value: Column, digits: int) -> Column:
    """Round half up on the binary value, the same in every engine.

    `F.round` works on the decimal text of a double and so differs from other
    engines on values such as 1.005.
    """
    number, scale = value.cast("double"), float(10**digits)
    # beyond 2^53 a double has no digits to round; infinite and NaN stay as they are
    fits = F.abs(number) < F.lit(2.0**53 / scale)
    return F.when(fits, F.floor(number * scale + 0.5) / F.lit(scale)).otherwise(number)


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(condition: Column) -> Column:
    """Fraction of all rows where the condition holds; NULL counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def share_pct(condition: Column, digits: int) -> Column:
    return rounded(F.lit(100.0) * share(condition), digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """A boolean that is never NULL: an unknown comparison is False."""
    return F.coalesce(condition, F.lit(False))


def tier_of(score: Column, bounds: tuple, labels: tuple) -> Column:
    """Upper-inclusive bands; a NULL score has no band."""
    bands = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels):
        bands = bands.when(score <= bound, label)
    return bands.otherwise(labels[-1])


def label_order(value: Column, labels: list[str] | tuple[str, ...]) -> Column:
    """Position of a label in a fixed list, to sort by meaning."""
    position = F.lit(len(labels))
    for index, label in reversed(list(enumerate(labels))):
        position = F.when(value == label, index).otherwise(position)
    return position


def period_of(year: Column, width: int) -> Column:
    return (F.floor(year / F.lit(width)) * width).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to a range; NULL stays NULL (`greatest`/`least` skip NULLs)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def frequency_bucket(count: Column) -> Column:
    buckets = F.when(count.isNull() | (count <= 0), F.lit(None).cast("string"))
    for bound, label in FREQUENCY_BUCKETS:
        buckets = buckets.when(count <= bound, label)
    return buckets.otherwise(FREQUENCY_TOP)


def bin_index(value: Column, low: float, width: float, bins: int) -> Column:
    """Left-closed bin number; the top edge falls into the last bin."""
    return F.least(F.floor((value - F.lit(float(low))) / F.lit(float(width))), F.lit(bins - 1))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; NULL below three values or without spread."""
    n = F.count(value).cast("double")
    factor = F.sqrt(n * (n - 1.0)) / (n - 2.0)
    return F.when((n >= 3) & (F.stddev_pop(value) > 0), factor * F.skewness(value))


def content_key(columns: list[str]) -> Column:
    """Digest of the given values; NULL and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
