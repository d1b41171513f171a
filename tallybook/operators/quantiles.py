"""Exact quantiles by radix selection, in at most four counting passes whatever the data.

The 64 bits of a double, the lower 63 flipped where it is negative, order like the number.
A pass counts the next 16 bits of the values that share the bits found so far around a
wanted rank; running counts tell where the rank lies and how far into the next digit.
After four passes the value is known to the last bit, and before that wherever all values
around the rank are equal. Nothing is sorted but at most 65,536 counts per group and rank,
no sketch is used, and the counts are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import join_null_safe, materialise

DIGIT = 16
FIRST = 64 - DIGIT
LOWER_BITS = 2**63 - 1

_V, _I, _N, _D = "_value", "_image", "_count", "_digit"
_PREFIX, _TOTAL, _RANK, _PROB, _SIDE = "_prefix", "_total", "_rank", "_prob", "_side"
_LOW, _HIGH = "_low", "_high"


def ordered_image(value: Column) -> Column:
    """A long that orders like the double; -0.0 as 0.0, NaN last."""
    name = (F.lit("java.lang.Double"), F.lit("doubleToLongBits"))
    bits = F.call_function("java_method", *name, value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(LOWER_BITS))).otherwise(bits)


def _wanted(probs: list[float]) -> Column:
    """Both ranks around each position p * (n - 1), 0-based."""
    ranks = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col(_TOTAL) - 1).cast("double")
        for side, take in enumerate((F.floor, F.ceil)):
            rank = take(position).cast("bigint")
            ranks.append(F.struct(F.lit(i).alias(_PROB), F.lit(side).alias(_SIDE), rank.alias(_RANK)))
    return F.array(*ranks)


def _running(keys: list[str]):
    order = Window.partitionBy(*keys).orderBy(_D)
    return F.sum(_N).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | tuple[str, ...] = (),
    expand: Callable[[DataFrame], DataFrame] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles, one row per group of `by`, one column per entry of
    `probs`, plus `n`, the number of values that are not NULL.

    With `expand` values are counted by `by`, and `expand` turns each row of counts into
    rows of the groups in `keys` that it belongs to: overlapping groups need no copies of
    the values.
    """
    by = list(by)
    keys = by if keys is None else list(keys)
    shared = [k for k in by if k in keys]
    values = df.select(*by, F.col(value).cast("double").alias(_V)).where(F.col(_V).isNotNull())
    held = materialise(values.withColumn(_I, ordered_image(F.col(_V))))

    def counted(rows: DataFrame, groups: list[str], digit: Column) -> DataFrame:
        """Values per group and digit, with the least and the greatest of them."""
        out = [*keys, *(g for g in groups if g not in by)]
        counts = rows.groupBy(*groups, digit.alias(_D)).agg(
            F.count(F.lit(1)).alias(_N), F.min(_V).alias(_LOW), F.max(_V).alias(_HIGH)
        )
        if expand is not None:
            counts = expand(counts).groupBy(*out, _D).agg(
                F.sum(_N).alias(_N), F.min(_LOW).alias(_LOW), F.max(_HIGH).alias(_HIGH)
            )
        return counts.withColumn("_upto", _running(out))

    before = F.col("_upto") - F.col(_N)
    ranked = counted(held, by, F.shiftright(_I, FIRST))
    ranked = ranked.withColumn(_TOTAL, F.sum(_N).over(Window.partitionBy(*keys)))
    inside = F.filter(_wanted(list(probs.values())), lambda r: (r[_RANK] >= before) & (r[_RANK] < F.col("_upto")))
    state = ranked.select(
        *keys, _TOTAL, F.col(_D).alias(_PREFIX), _LOW, _HIGH, before.alias("_before"), F.inline(inside)
    )
    state = state.withColumn(_RANK, F.col(_RANK) - F.col("_before")).drop("_before")
    found = None
    for step in range(FIRST - DIGIT, -1, -DIGIT):
        state = materialise(state)
        known = state.where(F.col(_LOW) >= F.col(_HIGH))
        found = known if found is None else found.unionByName(known)
        state = state.where(F.col(_LOW) < F.col(_HIGH))
        if state.isEmpty():
            return _interpolated(found, probs, keys)
        near = state.select(*shared, _PREFIX).distinct()
        marked = held.withColumn(_PREFIX, F.shiftright(_I, step + DIGIT))
        marked = join_null_safe(marked, near, [*shared, _PREFIX], "left_semi")
        digit = F.shiftright(_I, step).bitwiseAND(F.lit(2**DIGIT - 1))
        facts = counted(marked, [*by, _PREFIX], digit)
        met = join_null_safe(state.drop(_LOW, _HIGH), facts, [*keys, _PREFIX], "inner")
        met = met.where((F.col(_RANK) < F.col("_upto")) & (F.col(_RANK) >= before))
        prefix = F.shiftleft(_PREFIX, DIGIT) + F.col(_D)
        rank = F.col(_RANK) - before
        state = met.select(
            *keys, _TOTAL, prefix.alias(_PREFIX), _LOW, _HIGH, _PROB, _SIDE, rank.alias(_RANK)
        )
    return _interpolated(found.unionByName(state), probs, keys)


def _interpolated(state: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    def side(i: int, which: int) -> Column:
        return F.max(F.when((F.col(_PROB) == i) & (F.col(_SIDE) == which), F.col(_HIGH)))

    ends = [side(i, s).alias(f"_v{i}_{s}") for i in range(len(probs)) for s in (0, 1)]
    found = state.groupBy(*keys).agg(F.coalesce(F.max(_TOTAL), F.lit(0)).alias("n"), *ends)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        low, high = F.col(f"_v{i}_0"), F.col(f"_v{i}_1")
        position = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        between = low + (high - low) * (position - F.floor(position))
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(*keys, "n", *out)


def exact_medians(
    df: DataFrame, columns: list[str], label: str = "column_name", value: str = "median"
) -> DataFrame:
    """Median of each column, as `label, value` rows."""
    numbers = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    found = exact_quantiles(numbers.unpivot([], columns, label, _V), _V, {value: 0.5}, [label])
    return found.select(label, value)
