"""Held-out accuracy and residual diagnostics as grouped aggregates.

All take predictions: rows with `target`, `prediction` and their labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import (
    bin_index,
    clip,
    count_where,
    frequency_bucket,
    label_order,
    rounded,
    share,
    tier_of,
)
from tallybook.operators.frame import TARGET
from tallybook.operators.quantiles import exact_medians
from tallybook.operators.splits import is_recognised
from tallybook.spec import CatalogSpec



def _y() -> Column:
    return F.col(TARGET)


def _p() -> Column:
    return F.col("prediction")


def _r2(residual: Column, total: Column) -> Column:
    """1 - residual/total; a constant target scores 1 if hit exactly, else 0."""
    constant = F.when(residual == 0, 1.0).otherwise(0.0)
    return F.when(total == 0, constant).otherwise(1.0 - residual / F.nullif(total, F.lit(0.0)))


def accuracy(predictions: DataFrame, by: list[str] | tuple[str, ...] = ("model",)) -> DataFrame:
    """n, R2, MAE and RMSE on raw predictions of rows with a known target."""
    error = _y() - _p()
    sums = predictions.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.sum(error * error).alias("_residual"),
        (F.var_pop(_y()) * F.count(_y())).alias("_total"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
    return sums.select(*by, "n", _r2(F.col("_residual"), F.col("_total")).alias("r2"), "mae", "rmse")


def bounds(
    predictions: DataFrame, spec: CatalogSpec, by: list[str] | tuple[str, ...] = ("model",)
) -> DataFrame:
    """How often, and how far, raw predictions leave the score's range."""
    below, above = _p() < spec.score_min, _p() > spec.score_max
    low, high = spec.score_min, spec.score_max
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(_p()).alias("min_prediction"),
        F.max(_p()).alias("max_prediction"),
        count_where(below).alias(f"n_below_{low}"),
        rounded(share(below) * 100.0, 3).alias(f"pct_below_{low}"),
        count_where(above).alias(f"n_above_{high}"),
        rounded(share(above) * 100.0, 3).alias(f"pct_above_{high}"),
    )


def clipped(predictions: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Predictions within the score's range; for display, never for accuracy."""
    within = clip(_p(), float(spec.score_min), float(spec.score_max))
    return predictions.withColumn("prediction", within)


def compression(predictions: DataFrame) -> DataFrame:
    """Range and population spread of prediction and target, by model."""
    return predictions.groupBy("model").agg(
        F.min(_p()).alias("min_prediction"),
        F.max(_p()).alias("max_prediction"),
        F.stddev_pop(_p()).alias("sd_prediction"),
        F.min(_y()).alias("min_target"),
        F.max(_y()).alias("max_target"),
        F.stddev_pop(_y()).alias("sd_target"),
    )


def tier_errors(predictions: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Error and means by model and tier of the actual score."""
    tier = tier_of(_y(), spec.tier_bounds, spec.tier_labels).alias("tier")
    by = predictions.groupBy("model", tier).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(_y() - _p())).alias("mae"),
        F.avg(_p()).alias("mean_prediction"),
        F.avg(_y()).alias("mean_target"),
    )
    return by.orderBy("model", label_order(F.col("tier"), spec.tier_labels))


def residuals_by(predictions: DataFrame, label: Column | str, name: str) -> DataFrame:
    """MAE, bias (prediction - target) and rows by model and label."""
    label = F.col(label) if isinstance(label, str) else label
    by = predictions.groupBy("model", label.alias(name)).agg(
        F.avg(F.abs(_y() - _p())).alias("mae"), F.avg(_p() - _y()).alias("bias"), F.count(F.lit(1)).alias("n")
    )
    return by.orderBy("model", name)


def residuals_by_known_category(predictions: DataFrame, spec: CatalogSpec) -> DataFrame:
    known = F.col(spec.category) != spec.unknown_category
    return residuals_by(predictions, known, "category_known")


def accuracy_without_creator(predictions: DataFrame, creator: str) -> DataFrame:
    """Accuracy with and without one creator's rows, and their share."""
    is_creator = F.coalesce(F.col("creator") == creator, F.lit(False))
    full = accuracy(predictions).select("model", "n", F.col("r2").alias("r2_full"))
    rest = accuracy(predictions.where(~is_creator)).select(
        "model", F.col("n").alias("n_without"), F.col("r2").alias("r2_without")
    )
    shares = predictions.groupBy("model").agg((share(is_creator) * 100.0).alias("creator_pct"))
    # one row per model on each side
    return full.join(rest, "model", "left").join(shares, "model").orderBy("model")


def creator_buckets(predictions: DataFrame, frame: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Accuracy by how many rows a creator has in the whole frame.

    Errors are summed per creator before creators meet their counts, so the
    join sees one row per creator and model however large a creator is.
    """
    recognised = is_recognised(F.col("creator"), spec)
    counts = frame.where(recognised).groupBy("creator").agg(F.count(F.lit(1)).alias("_rows"))
    error = _y() - _p()
    by_creator = (
        predictions.where(recognised)
        .groupBy("model", "creator")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(_y()).alias("y"),
            F.sum(_y() * _y()).alias("yy"),
            F.sum(error * error).alias("ee"),
            F.sum(F.abs(error)).alias("ae"),
        )
    )
    sums = (
        by_creator.join(counts, "creator")
        .groupBy("model", frequency_bucket(F.col("_rows")).alias("bucket"))
        .agg(*(F.sum(c).alias(c) for c in ("n", "y", "yy", "ee", "ae")))
    )
    n = F.col("n").cast("double")
    spread = F.col("yy") - F.col("y") * F.col("y") / n
    # what cancellation leaves of a constant target is no spread
    total = F.when(spread > F.col("yy") * 1e-12, spread).otherwise(0.0)
    return sums.select(
        "model", "bucket", "n", _r2(F.col("ee"), total).alias("r2"), (F.col("ae") / n).alias("mae")
    ).orderBy("model", "bucket")


def bucket_exclusions(predictions: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows the bucket table leaves out, by model."""
    left_out = ~is_recognised(F.col("creator"), spec)
    return predictions.groupBy("model").agg(
        F.count_if(left_out).alias("n_excluded"),
        rounded(share(left_out) * 100.0, 1).alias("pct_excluded"),
    )


def label_inspection(frame: DataFrame, spec: CatalogSpec, label: str) -> DataFrame:
    """Distribution of creator score and target under one creator label."""
    rows = frame.where(F.col("creator") == label)
    named = rows.select(F.col(spec.creator_score).alias("creator_score"), TARGET)
    long = named.unpivot([], named.columns, "measure", "value")
    facts = long.groupBy("measure").agg(
        F.count("value").alias("n"),
        F.count_distinct("value").alias("n_distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    medians = exact_medians(named, named.columns, "measure")
    return facts.join(medians, "measure", "left").orderBy("measure")


def top_values(frame: DataFrame, column: str, top: int = 3) -> DataFrame:
    """The most frequent values of a column."""
    counts = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(top)


def density(predictions: DataFrame, spec: CatalogSpec, bins: int = 40) -> DataFrame:
    """Counts over a grid of actual score and clipped prediction, by model."""
    low, high = float(spec.score_min), float(spec.score_max)
    width = (high - low) / bins
    return (
        clipped(predictions, spec)
        .groupBy(
            "model",
            bin_index(_y(), low, width, bins).cast("bigint").alias("bin_target"),
            bin_index(_p(), low, width, bins).cast("bigint").alias("bin_prediction"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("model", "bin_target", "bin_prediction")
    )


def results_table(results: DataFrame, models: list[str]) -> DataFrame:
    """Metrics as rows, models as columns."""
    long = results.withColumn("n", F.col("n").cast("double")).unpivot(
        ["model"], ["n", "r2", "mae", "rmse"], "metric", "value"
    )
    return long.groupBy("metric").pivot("model", models).agg(F.first("value")).orderBy("metric")
