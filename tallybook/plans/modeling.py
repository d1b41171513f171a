"""Holdout evaluation of linear models: one split, many seeds, other datasets."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.distributions import f_upper, t_critical, t_two_sided
from tallybook.operators.evaluate import accuracy, bounds
from tallybook.operators.frame import TARGET, modeling_frame
from tallybook.operators.linear import BASELINE, DesignError, Fit, bring_contrasts, fit_masked, predict
from tallybook.operators.lookup import join_key_values
from tallybook.operators.splits import (
    GROUP,
    MASK,
    ROW,
    SEED,
    SWEEP_SEEDS,
    TEST_SIZE,
    by_seed,
    grouped_cuts,
    seed_batches,
    split_cuts,
    unit_mask,
)
from tallybook.session import materialise
from tallybook.spec import CatalogSpec, ModelSpec


@dataclass(frozen=True)
class Holdout:
    """Fits on the training side and raw predictions for the test side.

    `rows` are all rows once per seed with `is_test`; nothing makes them unless asked. Those of
    wide designs bring the contrasts of their levels for `predict`.
    """

    rows: DataFrame
    cuts: dict[int, str]
    fits: list[Fit]
    predictions: DataFrame
    composition: DataFrame

    def metrics(self) -> DataFrame:
        return accuracy(self.predictions, ["seed", "model"]).orderBy("seed", "model")


def hold_out(
    frame: DataFrame,
    models: list[ModelSpec],
    seeds: list[int] | None = None,
    unit: str = GROUP,
    test_size: float = TEST_SIZE,
    baseline: bool = True,
) -> Holdout:
    """Split, fit and predict for every seed and model.

    Units are hashed once; rows carry one bit per seed. The seeds share one pass over the
    rows per step: medians, sums and predictions. Only predictions have a row per seed
    that holds the row out. `frame` should be materialised or read from a table.
    """
    fitted = [BASELINE, *models] if baseline else models
    if unit == GROUP:
        units = materialise(frame.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("y")))
    else:
        # the frame's own rows: not worth writing again
        units = frame.select(ROW, F.lit(1).cast("bigint").alias("n"), F.col(TARGET).alias("y"))
    cuts = split_cuts(units, unit, seeds or [SEED], test_size)
    parts = [_hold_out(frame, units, fitted, {s: cuts[s] for s in some}, unit) for some in seed_batches(cuts)]
    return Holdout(
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.rows for p in parts)),
        cuts,
        [f for p in parts for f in p.fits],
        reduce(DataFrame.unionByName, (p.predictions for p in parts)),
        reduce(DataFrame.unionByName, (p.composition for p in parts)),
    )


def _hold_out(
    frame: DataFrame, units: DataFrame, models: list[ModelSpec], cuts: dict[int, str], unit: str
) -> Holdout:
    seeds = sorted(cuts)
    sides = units.withColumn(MASK, unit_mask(F.col(unit), cuts))
    if unit == GROUP:
        sides = materialise(sides)
        masked = join_key_values(frame, sides.select(GROUP, MASK, "n"), [GROUP], "n").drop("n")
    else:
        masked = frame.withColumn(MASK, unit_mask(F.col(unit), cuts))
    masked = materialise(masked)
    fits = fit_masked(masked, seeds, models)
    masked = bring_contrasts(masked, fits)
    predictions = predict(by_seed(masked, seeds, True), fits)
    return Holdout(by_seed(masked, seeds), cuts, fits, predictions, _composition(sides, seeds))


def _composition(units: DataFrame, seeds: list[int]) -> DataFrame:
    """Rows, units and mean target on each side, per seed, from sums per mask."""
    by_mask = units.groupBy(MASK).agg(
        F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), F.sum("y").alias("y")
    )
    is_test = F.col("is_test")

    def total(column: str, side) -> Column:
        return F.sum(F.when(side, F.col(column)).otherwise(0))

    return (
        by_seed(by_mask, seeds)
        .groupBy("seed")
        .agg(
            total("n", ~is_test).alias("n_train"),
            total("n", is_test).alias("n_test"),
            total("units", ~is_test).alias("n_train_groups"),
            total("units", is_test).alias("n_test_groups"),
            (F.sum(F.when(is_test, F.col("y"))) / F.sum(F.when(is_test, F.col("n")))).alias(
                "test_mean_target"
            ),
        )
    )


def sweep(
    frame: DataFrame,
    models: list[ModelSpec],
    seeds: list[int] = SWEEP_SEEDS,
    test_size: float = TEST_SIZE,
) -> DataFrame:
    """One row per seed: split composition and the metrics of every model."""
    held = hold_out(frame, models, seeds, GROUP, test_size)
    names = [BASELINE.name, *(m.name for m in models)]
    metrics = ["r2", "mae", "rmse"]
    wide = (
        held.metrics()
        .groupBy("seed")
        .pivot("model", names)
        .agg(*(F.first(m).alias(m) for m in metrics))
    )
    return held.composition.join(wide, "seed").orderBy("seed")


def summarise_sweep(swept: DataFrame, models: list[ModelSpec]) -> DataFrame:
    """Centre and range of each model's metrics and of the split composition."""
    facts = {}
    for m in models:
        facts |= {
            (m.name, "median_r2"): F.median(f"{m.name}_r2"),
            (m.name, "min_r2"): F.min(f"{m.name}_r2"),
            (m.name, "max_r2"): F.max(f"{m.name}_r2"),
            (m.name, "median_mae"): F.median(f"{m.name}_mae"),
            (m.name, "median_rmse"): F.median(f"{m.name}_rmse"),
        }
    for column in ("n_test", "n_test_groups", "test_mean_target"):
        facts["split_composition", f"{column}_min"] = F.min(column)
        facts["split_composition", f"{column}_max"] = F.max(column)
    wide = swept.agg(
        *(value.cast("double").alias(f"v{i}") for i, value in enumerate(facts.values()))
    )
    lines = [
        F.struct(
            F.lit(subject).alias("subject"), F.lit(fact).alias("fact"), F.col(f"v{i}").alias("value")
        )
        for i, (subject, fact) in enumerate(facts)
    ]
    return wide.select(F.inline(F.array(*lines)))


def bounds_sweep(
    frame: DataFrame, models: list[ModelSpec], spec: CatalogSpec, seeds: list[int] = SWEEP_SEEDS
) -> DataFrame:
    """The out-of-range diagnostic for every seed and model."""
    held = hold_out(frame, models, seeds, baseline=False)
    return bounds(held.predictions, spec, ["seed", "model"]).orderBy("seed", "model")


def compare_splits(
    frame: DataFrame, models: list[ModelSpec], seeds: list[int] = SWEEP_SEEDS, seed: int = SEED
) -> DataFrame:
    """R2 by model: median over grouped seeds, one grouped seed, one row split."""
    grouped = hold_out(frame, models, sorted({*seeds, seed}), baseline=False).metrics()
    by_row = hold_out(frame, models, [seed], unit=ROW, baseline=False).metrics()
    of_sweep = F.median(F.when(F.col("seed").isin(*seeds), F.col("r2")))
    of_seed = F.max(F.when(F.col("seed") == seed, F.col("r2")))
    left = grouped.groupBy("model").agg(
        of_sweep.alias("grouped_median_r2"), of_seed.alias("grouped_seed_r2")
    )
    right = by_row.select("model", F.col("r2").alias("random_seed_r2"))
    return left.join(right, "model").orderBy("model")


def compare_dataset_models(
    datasets: dict[str, DataFrame],
    spec: CatalogSpec,
    models: list[ModelSpec],
    seed: int = SEED,
) -> DataFrame:
    """The same grouped evaluation on each dataset, stacked."""
    stacked = None
    for name, df in datasets.items():
        frame = materialise(modeling_frame(df, spec, models))
        metrics = hold_out(frame, models, [seed], baseline=False).metrics()
        labelled = metrics.select(F.lit(name).alias("dataset"), "*")
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return stacked


@dataclass(frozen=True)
class OlsSummary:
    coefficients: DataFrame
    statistics: DataFrame


def reduced_ols(
    frame: DataFrame,
    model: ModelSpec,
    seed: int = SEED,
    test_size: float = TEST_SIZE,
    level: float = 0.95,
) -> OlsSummary:
    """Classical inference for a small model on one seed's training rows.

    Standard errors assume independent errors, which rows of one creator are
    not: read the coefficients as descriptive.
    """
    spark = frame.sparkSession
    masked = frame.withColumn(MASK, unit_mask(F.col(GROUP), grouped_cuts(frame, [seed], test_size)))
    fit = fit_masked(masked, [seed], [model])[0]
    return ols_summary(spark, fit, level)


def ols_summary(spark, fit: Fit, level: float = 0.95) -> OlsSummary:
    names = ["const", *fit.feature_names]
    beta = np.array([fit.intercept, *fit.coefficients])
    n, width = fit.n, len(names)
    if fit.gram is None:
        raise DesignError("the design is too wide for standard errors")
    spread = np.linalg.eigvalsh(fit.gram)
    if spread[0] <= 1e-10 * spread[-1]:
        raise DesignError("the design has aliased columns; drop one of them")
    df_model, df_error = width - 1, n - width
    if df_error <= 0:
        raise DesignError("no more rows than design columns")
    error = float(fit.squares - 2 * beta @ fit.moment + beta @ fit.gram @ beta)
    total = float(fit.squares - fit.moment[0] ** 2 / n)
    r2 = 1.0 - error / total
    covariance = error / df_error * np.linalg.inv(fit.gram)
    se = np.sqrt(np.diag(covariance))
    reach = t_critical(spark, level, df_error)
    lines = [
        (name, b, s, b / s, t_two_sided(spark, b / s, df_error), b - reach * s, b + reach * s)
        for name, b, s in zip(names, beta.tolist(), se.tolist())
    ]
    coefficients = spark.createDataFrame(
        lines,
        "term string, coef double, std_error double, t_value double, p_value double, "
        "ci_low double, ci_high double",
    )
    f_value = (total - error) / df_model / (error / df_error)
    log_likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(error / n) + 1)
    facts = {
        "n": n,
        "df_model": df_model,
        "df_error": df_error,
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df_error,
        "f_value": f_value,
        "f_p_value": f_upper(spark, f_value, df_model, df_error),
        "log_likelihood": log_likelihood,
        "aic": -2 * log_likelihood + 2 * width,
        "bic": -2 * log_likelihood + math.log(n) * width,
        "condition_number": math.sqrt(spread[-1] / spread[0]),
    }
    statistics = spark.createDataFrame(
        [(k, float(v)) for k, v in facts.items()], "statistic string, value double"
    )
    return OlsSummary(coefficients, statistics)
