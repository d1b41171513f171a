"""Descriptive queries by period, category, tier and segment.

Windows run over the aggregated counts, whose size is set by the number of
distinct labels and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import (
    all_of,
    count_where,
    label_order,
    rounded,
    share_pct,
)
from tallybook.spec import CatalogSpec

TOP_RANK = 5


def _n() -> Column:
    return F.count(F.lit(1)).alias("n_rows")


def _center(spec: CatalogSpec) -> list[Column]:
    score = F.col(spec.score)
    return [F.median(score).alias("median_score"), rounded(F.avg(score), 2).alias("mean_score")]


def _high(spec: CatalogSpec) -> list[Column]:
    high = F.col(spec.score) >= spec.high_min
    return [count_where(high).alias("n_high"), share_pct(high, 2).alias("high_share_pct")]


def _coverage(spec: CatalogSpec) -> list[Column]:
    known = F.col(spec.category).isNotNull()
    return [
        F.count_if(known).alias("n_with_category"),
        share_pct(known, 2).alias("coverage_pct"),
    ]


def _known(df: DataFrame, *columns: str) -> DataFrame:
    # spelled out, unlike dropna, so that the scan can skip the NULLs
    return df.where(all_of([F.col(c).isNotNull() for c in columns]))


def score_by_period(df: DataFrame, spec: CatalogSpec, min_rows: int = 0) -> DataFrame:
    """Q1: score by period; `min_rows` drops thin periods from a chart's data."""
    by = _known(df, spec.period).groupBy(spec.period).agg(_n(), *_center(spec))
    return by.where(F.col("n_rows") >= min_rows).orderBy(spec.period)


def score_by_category(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q2: score by category, among rows with one."""
    by = _known(df, spec.category).groupBy(spec.category).agg(_n(), *_center(spec))
    return by.orderBy(F.desc("median_score"), spec.category)


def high_share_by_category(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q3: rows in the top tier by category."""
    by = _known(df, spec.category).groupBy(spec.category).agg(_n(), *_high(spec))
    return by.orderBy(F.desc("high_share_pct"), spec.category)


def coverage_by_period(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q4: share of rows with a category, for periods with enough rows."""
    by = _known(df, spec.period).groupBy(spec.period).agg(_n(), *_coverage(spec))
    return by.where(F.col("n_rows") >= spec.min_group_rows).orderBy(spec.period)


def score_by_segment(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q5: centre and top-tier share of the score by segment."""
    by = df.groupBy(spec.segment).agg(_n(), *_center(spec), *_high(spec))
    return by.orderBy(F.desc("median_score"), spec.segment)


def _category_counts(df: DataFrame, spec: CatalogSpec, within: str) -> DataFrame:
    return _known(df, within, spec.category).groupBy(within, spec.category).agg(_n())


def category_rank_by_period(
    df: DataFrame, spec: CatalogSpec, top: int | None = None
) -> DataFrame:
    """Q6: categories ranked within each period; equal counts share a rank."""
    by_count = Window.partitionBy(spec.period).orderBy(F.desc("n_rows"))
    ranked = _category_counts(df, spec, spec.period).withColumn(
        "category_rank", F.rank().over(by_count)
    )
    if top is not None:
        ranked = ranked.where(F.col("category_rank") <= top)
    return ranked.orderBy(spec.period, "category_rank", spec.category)


def category_share_by_period(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q7: each category's share of its period's categorised rows.

    The window has no order: with one, the sum would be a running total.
    """
    total = F.sum("n_rows").over(Window.partitionBy(spec.period))
    return (
        _category_counts(df, spec, spec.period)
        .withColumn("period_total", total)
        .withColumn("share_pct", rounded(F.lit(100.0) * F.col("n_rows") / F.col("period_total"), 2))
        .orderBy(spec.period, F.desc("share_pct"), spec.category)
    )


def _by_tier(spec: CatalogSpec) -> Column:
    return label_order(F.col(spec.tier), spec.tier_labels)


def coverage_by_tier(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q8a: share of rows with a category, by tier from low to high."""
    by = _known(df, spec.tier).groupBy(spec.tier).agg(_n(), *_coverage(spec))
    return by.orderBy(_by_tier(spec))


def top_categories_by_tier(df: DataFrame, spec: CatalogSpec, top: int = TOP_RANK) -> DataFrame:
    """Q8b: categories up to rank `top` in each tier; ties can add rows."""
    by_count = Window.partitionBy(spec.tier).orderBy(F.desc("n_rows"))
    ranked = _category_counts(df, spec, spec.tier).withColumn(
        "rank_in_tier", F.rank().over(by_count)
    )
    kept = ranked.where(F.col("rank_in_tier") <= top)
    return kept.orderBy(_by_tier(spec), "rank_in_tier", spec.category)


def compare_datasets(datasets: dict[str, DataFrame], spec: CatalogSpec) -> DataFrame:
    """Q9: the same KPIs on each dataset, labelled and stacked."""
    high, known = F.col(spec.score) >= spec.high_min, F.col(spec.category).isNotNull()
    stacked = None
    for name, df in datasets.items():
        row = df.agg(
            _n(),
            F.median(spec.score).alias("median_score"),
            rounded(F.avg(spec.score), 4).alias("mean_score"),
            share_pct(high, 4).alias("high_share_pct"),
            share_pct(known, 4).alias("coverage_pct"),
        ).select(F.lit(name).alias("dataset"), "*")
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked


def period_profile_by_segment(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Q10: median year and share up to the cutoff year, by segment.

    Uses the year, not the period: a period would fold later years in. Rows
    without a year are in neither numerator nor denominator.
    """
    year = F.col(spec.year_value)
    by = _known(df, spec.year_value).groupBy(spec.segment).agg(
        _n(),
        F.median(year).alias("median_year"),
        share_pct(year <= spec.cutoff_year, 2).alias("pct_up_to_cutoff"),
    )
    return by.orderBy("median_year", spec.segment)
