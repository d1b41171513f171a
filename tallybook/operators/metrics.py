"""The KPI layer: eight documented metrics and their comparison.

All are per row of the table given: a share is a share of its rows, a median
weighs a creator by the rows it has. Where cleaning has added a flag it is
used; otherwise the raw columns give the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import flag, ratio, share
from tallybook.operators.lookup import key_counts
from tallybook.operators.quantiles import exact_medians
from tallybook.spec import CatalogSpec

METRICS = [
    "row_count",
    "median_score",
    "mean_score",
    "high_share",
    "category_coverage",
    "median_size",
    "median_creator_score",
    "repeat_share",
]


def simple_metrics(df: DataFrame, spec: CatalogSpec) -> dict[str, Column]:
    """The metrics that are a plain aggregate.

    row_count: COUNT(*). median_score, mean_score: over rows with a score.
    high_share: rows at or above the top tier's bound / all rows.
    category_coverage: rows with a category / all rows.
    """
    score = F.col(spec.score)
    high = F.col(spec.is_high) if spec.is_high in df.columns else flag(score >= spec.high_min)
    known = F.col(spec.category).isNotNull()
    if spec.has_category in df.columns:
        known = F.col(spec.has_category)
    return {
        "row_count": F.count(F.lit(1)).cast("double"),
        "median_score": F.median(score),
        "mean_score": F.avg(score),
        "high_share": share(high),
        "category_coverage": share(known),
    }


def wide_medians(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """median_size (in scaled units) and median_creator_score, as long rows."""
    size = F.col(spec.size) / F.lit(spec.size_divisor)
    if spec.size_scaled in df.columns:
        size = F.col(spec.size_scaled)
    columns = [
        size.cast("double").alias("median_size"),
        F.col(spec.creator_score).cast("double").alias("median_creator_score"),
    ]
    named = df.select(*columns)
    return exact_medians(named, named.columns, "metric", "value")


def repeat_share(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows under a repeated key / all rows: a group of three adds three."""
    if spec.key_repeat in df.columns:
        value = df.agg(share(F.col(spec.key_repeat)).alias("value"))
    else:
        n = F.col("n")
        sizes = key_counts(df, spec.key)
        value = sizes.agg(ratio(F.sum(F.when(n > 1, n).otherwise(0)), F.sum(n)).alias("value"))
    return value.select(F.lit("repeat_share").alias("metric"), "value")


def kpi_summary(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """All eight metrics as `metric, value` rows."""
    simple = simple_metrics(df, spec)
    long = df.agg(*(column.alias(name) for name, column in simple.items())).unpivot(
        [], list(simple), "metric", "value"
    )
    return long.unionByName(wide_medians(df, spec)).unionByName(repeat_share(df, spec))


def metric(df: DataFrame, spec: CatalogSpec, name: str) -> DataFrame:
    """One metric as a single `value`."""
    simple = simple_metrics(df, spec)
    if name in simple:
        return df.agg(simple[name].alias("value"))
    if name == "repeat_share":
        return repeat_share(df, spec).select("value")
    return wide_medians(df, spec).where(F.col("metric") == name).select("value")


def compare_kpis(base: DataFrame, other: DataFrame, base_name: str, other_name: str) -> DataFrame:
    """Two KPI tables by metric, with absolute and relative difference."""
    joined = base.withColumnRenamed("value", base_name).join(
        other.withColumnRenamed("value", other_name), "metric"
    )
    delta = F.col(other_name) - F.col(base_name)
    return joined.withColumn("abs_delta", delta).withColumn(
        "rel_delta_pct", ratio(delta, F.col(base_name)) * 100.0
    )

