"""Data-quality audit: each finding is one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import (
    bin_index,
    count_where,
    flag,
    rounded,
    sample_skewness,
    share,
    share_pct,
)
from tallybook.operators.dedup import exact_repeat_stats
from tallybook.operators.quantiles import exact_medians
from tallybook.spec import CatalogSpec

# The reported quantiles of the score.
SCORE_QUANTILES = {
    "p0": 0.0, "p1": 0.01, "p5": 0.05, "p10": 0.10, "p25": 0.25,
    "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99, "p100": 1.0,
}


def _rows() -> Column:
    return F.count(F.lit(1))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(_rows().alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage of every column, most missing first."""
    columns = columns or df.columns
    counts = df.agg(_rows().alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return (
        counts.unpivot(["_n"], columns, "column_name", "n_missing")
        .withColumn("pct_missing", rounded(F.col("n_missing") / F.col("_n") * 100.0, 3))
        .drop("_n")
        .orderBy(F.desc("n_missing"), "column_name")
    )


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the missing percentage of the chosen columns."""
    return df.agg(*(share_pct(F.col(c).isNull(), 3).alias(f"pct_missing_{c}") for c in columns))


def cardinalities(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, NULL not counted."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(*(count(F.col(c)).alias(c) for c in columns))
    return counts.unpivot([], columns, "column_name", "n_unique").orderBy("column_name")


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean and exact median per column, one row each."""
    measures = {"min": F.min, "max": F.max, "mean": F.avg}
    wide = df.agg(
        *(
            F.struct(*(f(F.col(c).cast("double")).alias(m) for m, f in measures.items())).alias(c)
            for c in columns
        )
    )
    ranges = wide.unpivot([], columns, "column_name", "facts").select("column_name", "facts.*")
    return ranges.join(exact_medians(df, columns), "column_name", "left").orderBy("column_name")


def value_count(df: DataFrame, column: str, value, name: str = "n") -> DataFrame:
    """How often a column holds one value: a zero, a sentinel."""
    return df.agg(count_where(F.col(column) == value).alias(name))


def domain_counts(df: DataFrame, column: str, valid: tuple) -> DataFrame:
    """Every value with its count and whether the documented domain has it."""
    return (
        df.groupBy(column)
        .agg(_rows().alias("n"))
        .withColumn("in_domain", flag(F.col(column).isin(*valid)))
        .orderBy(F.asc_nulls_last(column))
    )


def pair_missingness(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Columns that belong together: value there although its name is missing."""
    facts = {}
    for name, value in pairs.items():
        no_name, no_value = F.col(name).isNull(), F.col(value).isNull()
        facts[name] = F.struct(
            F.lit(value).alias("value_column"),
            share_pct(no_name, 3).alias("pct_name_missing"),
            share_pct(no_value, 3).alias("pct_value_missing"),
            F.count_if(no_name & ~no_value).alias("n_value_without_name"),
        ).alias(name)
    return (
        df.agg(*facts.values())
        .unpivot([], list(facts), "name_column", "facts")
        .select("name_column", "facts.*")
        .orderBy("name_column")
    )


def category_completeness(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    present = F.col(spec.category).isNotNull()
    return df.agg(
        F.count_if(present).alias("n_present"),
        F.count_if(~present).alias("n_missing"),
        share_pct(present, 3).alias("pct_present"),
    )


def flag_counts(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """All quality flags in one pass."""
    quality = F.col(spec.measure_quality)
    return df.agg(
        count_where(quality == spec.zero_label).alias("n_zero_measure"),
        count_where(quality == "missing").alias("n_missing_measure"),
        count_where(F.col(spec.is_sentinel_year)).alias("n_sentinel_year"),
        count_where(F.col(spec.key_repeat)).alias("n_rows_in_key_repeats"),
        count_where(F.col(spec.is_high)).alias("n_high"),
    )


def exact_repeats_left(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows of groups that are still equal in all raw columns, whatever their flag says."""
    stats = exact_repeat_stats(df, spec.raw_columns(df.columns))
    return stats.select(F.col("rows_in_groups").alias("remaining_exact_repeats"))


def score_distribution(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Zeros, quantiles, mean, median and skew of the score.

    The score has few distinct values, so a percentile buffer stays small.
    """
    score = F.col(spec.score)
    facts = df.agg(
        _rows().alias("n"),
        count_where(score == 0).alias("n_zero"),
        share_pct(score == 0, 3).alias("pct_zero"),
        F.avg(score).alias("mean"),
        sample_skewness(score.cast("double")).alias("skew"),
        F.percentile(score, list(SCORE_QUANTILES.values())).alias("_q"),
    )
    at = [F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(SCORE_QUANTILES)]
    return facts.select(
        "n", "n_zero", "pct_zero", "mean", F.get("_q", F.lit(5)).alias("median"), "skew", *at
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, NULL included, most frequent first."""
    counts = df.groupBy(column).agg(_rows().alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column))


def period_frequency(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    return df.groupBy(spec.period).agg(_rows().alias("n")).orderBy(F.asc_nulls_last(spec.period))


def availability_bias(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows with against rows without a category, one line per measure."""
    score, creator_score = F.col(spec.score), F.col(spec.creator_score)
    sides = {
        "with_category": F.col(spec.category).isNotNull(),
        "without_category": F.col(spec.category).isNull(),
    }

    def facts(condition: Column) -> Column:
        return F.struct(
            F.count_if(condition).cast("double").alias("n"),
            rounded(share(condition), 4).alias("share_of_rows"),
            F.median(F.when(condition, score)).alias("median_score"),
            F.avg(F.when(condition, score)).alias("mean_score"),
            F.avg(F.when(condition, creator_score)).alias("mean_creator_score"),
        )

    measures = ["n", "share_of_rows", "median_score", "mean_score", "mean_creator_score"]
    wide = df.agg(*(facts(condition).alias(side) for side, condition in sides.items()))
    lines = [
        F.struct(F.lit(m).alias("measure"), *(F.col(f"{side}.{m}").alias(side) for side in sides))
        for m in measures
    ]
    return wide.select(F.inline(F.array(*lines)))


def period_mix(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Share of each period among rows with, and among rows without, a category."""
    side = F.col(spec.category).isNotNull().alias("has_category")
    counts = df.groupBy(side, spec.period).agg(_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy("has_category"))
    return counts.withColumn("share_pct", rounded(F.lit(100.0) * F.col("n") / total, 3)).orderBy(
        "has_category", F.asc_nulls_last(spec.period)
    )


def band_recovery(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Score range per raw band; bands are a true banding if no range overlaps."""
    score = F.col(spec.score)
    bands = (
        df.where(F.col(spec.band).isNotNull())
        .groupBy(spec.band)
        .agg(
            F.min(score).alias("min_score"),
            F.max(score).alias("max_score"),
            F.count(score).alias("n"),
        )
    )
    # one row per band
    below = F.lag("max_score").over(Window.partitionBy(F.lit(0)).orderBy("min_score", "max_score"))
    apart = F.coalesce(below < F.col("min_score"), F.lit(True))
    return bands.withColumn("is_disjoint", apart).orderBy("min_score")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts over [low, high]; the top edge is in the last bin."""
    width = (high - low) / bins
    value = F.col(column)
    counted = (
        df.where(value.between(low, high))
        .groupBy(bin_index(value, low, width, bins).cast("bigint").alias("bin"))
        .agg(_rows().alias("n"))
    )
    # empty bins count 0
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (
        every.join(counted, "bin", "left")
        .select("bin", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("bin_low", F.lit(float(low)) + F.col("bin") * F.lit(width))
        .orderBy("bin")
    )
