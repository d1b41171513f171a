"""Tail areas of Student's t and Fisher's F, from the mathematics library that Spark ships."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _beta(spark: SparkSession, x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    library = spark.sparkContext._jvm.org.apache.commons.math3.special.Beta
    return float(library.regularizedBeta(float(x), float(a), float(b)))


def t_two_sided(spark: SparkSession, t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return _beta(spark, df / (df + t * t), df / 2.0, 0.5)


def f_upper(spark: SparkSession, f: float, df1: float, df2: float) -> float:
    """P(F >= f)."""
    return _beta(spark, df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def t_critical(spark: SparkSession, level: float, df: float) -> float:
    """The t whose two-sided tail area is `1 - level`."""
    made = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution
    return float(made(float(df)).inverseCumulativeProbability((1.0 + level) / 2.0))
