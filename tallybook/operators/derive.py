"""Derived columns and quality flags; no row is added or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import flag, period_of, tier_of
from tallybook.operators.dedup import (
    distinct_rows,
    flag_exact_repeats,
    flag_keys_of_distinct,
    one_row_per_key,
    repeat_stats,
    split_by_key,
)
from tallybook.session import materialise
from tallybook.spec import CatalogSpec


def row_level_fields(spec: CatalogSpec, columns: list[str]) -> dict[str, Column]:
    """Derivations that need one row only, as far as their inputs are present."""
    fields: dict[str, Column] = {}
    periods = []
    if spec.year in columns:
        year = F.col(spec.year).try_cast("int")
        fields[spec.year_value] = year
        fields[spec.is_sentinel_year] = flag(year == spec.sentinel_year)
        periods.append(period_of(year, spec.period_width))
    if spec.period_fallback in columns:
        periods.append(F.col(spec.period_fallback).try_cast("int"))
    if periods:
        fields[spec.period] = F.coalesce(*periods)
    if spec.size in columns:
        fields[spec.size_scaled] = F.col(spec.size) / F.lit(spec.size_divisor)
    if spec.score in columns:
        score = F.col(spec.score)
        fields[spec.tier] = tier_of(score, spec.tier_bounds, spec.tier_labels)
        fields[spec.is_high] = flag(score >= spec.high_min)
    if spec.category in columns:
        fields[spec.has_category] = F.col(spec.category).isNotNull()
    if spec.measure in columns:
        measure = F.col(spec.measure)
        quality = F.when(measure.isNull(), "missing").when(measure == 0, spec.zero_label)
        fields[spec.measure_quality] = quality.otherwise("ok")
    return fields


def add_row_fields(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    return df.withColumns(row_level_fields(spec, df.columns))


def add_derived_fields(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """All derived columns, both duplicate flags included.

    Equal rows share their key: only rows with a repeated key are compared.
    """
    columns = spec.raw_columns(df.columns)
    alone, shared = split_by_key(df.select(*columns), spec.key)
    no = F.lit(False)
    flagged = alone.withColumn(spec.exact_repeat, no).withColumn(spec.key_repeat, no)
    if shared is not None:
        repeated = flag_exact_repeats(materialise(shared), columns, spec.exact_repeat)
        flagged = flagged.unionByName(repeated.withColumn(spec.key_repeat, F.lit(True)))
    return add_row_fields(flagged, spec)


def primary_with_stats(raw: DataFrame, spec: CatalogSpec) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates removed, key repeats kept and flagged; and what was removed."""
    raw = raw.select(*spec.raw_columns(raw.columns))
    alone, shared = split_by_key(raw, spec.key)
    flagged, groups = alone.withColumn(spec.key_repeat, F.lit(False)), None
    if shared is not None:
        shared = materialise(shared)
        distinct = distinct_rows(shared, raw.columns)
        groups = distinct.groups
        kept = flag_keys_of_distinct(shared, distinct, spec.key, spec.key_repeat)
        flagged = flagged.unionByName(kept)
    # distinct rows cannot repeat, so their flag needs no further pass
    primary = add_row_fields(flagged.withColumn(spec.exact_repeat, F.lit(False)), spec)
    return primary, repeat_stats(raw, groups)


def primary_dataset(raw: DataFrame, spec: CatalogSpec) -> DataFrame:
    return primary_with_stats(raw, spec)[0]


def sensitivity_dataset(primary: DataFrame, spec: CatalogSpec) -> DataFrame:
    """One row per key of the primary dataset."""
    return one_row_per_key(primary, spec)
