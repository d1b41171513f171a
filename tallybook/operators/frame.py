"""The modeling sample: typed features, grouping keys, no silent drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import count_where
from tallybook.operators.splits import GROUP, ROW, is_recognised, with_groups
from tallybook.spec import CatalogSpec, ModelSpec

TARGET = "target"


class LeakageError(ValueError):
    """A feature restates the target."""


def check_features(spec: CatalogSpec, features: list[str]) -> None:
    leaked = sorted(set(features) & (spec.target_derived | {spec.score, TARGET}))
    if leaked:
        raise LeakageError(f"features derived from the target: {leaked}")


def known_number(name: str) -> Column:
    """The column as a double; NaN is missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def modeling_frame(df: DataFrame, spec: CatalogSpec, models: list[ModelSpec]) -> DataFrame:
    """One row per modeled observation: target, features, creator and keys.

    Rows without a period are left out. A zero measure is missing, a missing
    category is a level of its own, and the period is a category, not a trend. Rows
    without a score stay: they are predicted, but neither fitted nor evaluated.
    """
    numeric = list(dict.fromkeys(c for m in models for c in m.numeric))
    categorical = list(dict.fromkeys(c for m in models for c in m.categorical))
    check_features(spec, [*numeric, *categorical])
    keyed = with_groups(df, spec).where(F.col(spec.period).isNotNull())

    def number(name: str):
        value = known_number(name)
        if name == spec.measure:
            value = F.nullif(value, F.lit(0.0))
        return value.alias(name)

    def level(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(spec.unknown_category)).alias(name)

    return keyed.select(
        known_number(spec.score).alias(TARGET),
        *(number(c) for c in numeric),
        *(level(c) for c in categorical),
        F.col(spec.creator).alias("creator"),
        ROW,
        GROUP,
    )


def frame_notes(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """One row that accounts for every dropped or recoded row."""
    kept = F.col(spec.period).isNotNull()
    creator = F.col(spec.creator)
    placeholder = creator.isNotNull() & ~is_recognised(creator, spec)
    return df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~kept).alias("rows_dropped_missing_period"),
        count_where(kept & (F.col(spec.measure) == 0)).alias("measures_treated_as_missing"),
        F.count_if(kept & F.col(spec.category).isNull()).alias("rows_with_unknown_category"),
        F.count_if(kept).alias("output_rows"),
        F.count_if(kept & known_number(spec.score).isNull()).alias("rows_without_target"),
        F.count_if(kept & creator.isNull()).alias("rows_missing_creator"),
        F.count_if(kept & placeholder).alias("rows_with_placeholder_creator"),
    )
