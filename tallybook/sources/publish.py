"""Writing the built datasets and publishing them as named tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.expressions import flag
from tallybook.session import COMPRESSION
from tallybook.spec import CatalogSpec


def write_datasets(datasets: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Overwrite one Parquet folder per dataset; return the written data.

    Reading back what was written spares later steps the parse and the dedup.
    """
    written = {}
    for name, df in datasets.items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
        written[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return written


def publish_views(datasets: dict[str, DataFrame]) -> None:
    """Name the datasets for SQL in this session, replacing earlier ones."""
    for name, df in datasets.items():
        df.createOrReplaceTempView(name)


def new_version(folder: str) -> str:
    """A folder below `folder` that no earlier build wrote to."""
    return f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"


def publish_tables(datasets: dict[str, str], spark: SparkSession) -> None:
    """Name written Parquet folders as catalog tables.

    A table that exists with the same columns is switched by one change of its location:
    readers see the former rows or the new ones, never none. The former folder stays as it
    is. All folders are read before the first table is switched, so one that is not there
    or not Parquet leaves every table alone.
    """
    schemas = {name: spark.read.parquet(path).schema for name, path in datasets.items()}
    for name, path in datasets.items():
        location = path.replace("'", "\\'")
        if spark.catalog.tableExists(name):
            if spark.table(name).schema == schemas[name]:
                spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
                spark.catalog.refreshTable(name)
                continue
            # other columns make another table
            spark.sql(f"DROP TABLE {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}'")


def published_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def run_query(spark: SparkSession, text: str) -> DataFrame:
    """Run a statement against the published tables."""
    return spark.sql(text)


def reconcile(source: DataFrame, published: DataFrame, spec: CatalogSpec, name: str) -> DataFrame:
    """Published data against its source: same row count, scores within bounds."""
    both = source.select(F.lit(True).alias("is_source"), spec.score).unionByName(
        published.select(F.lit(False).alias("is_source"), spec.score)
    )
    published_score = F.when(~F.col("is_source"), F.col(spec.score))
    facts = both.agg(
        F.count_if("is_source").alias("source_rows"),
        F.count_if(~F.col("is_source")).alias("published_rows"),
        F.min(published_score).alias("min_score"),
        F.max(published_score).alias("max_score"),
    )
    in_bounds = (F.col("min_score") >= spec.score_min) & (F.col("max_score") <= spec.score_max)
    return facts.select(
        F.lit(name).alias("dataset"),
        "source_rows",
        "published_rows",
        (F.col("source_rows") == F.col("published_rows")).alias("rows_match"),
        flag(in_bounds).alias("scores_in_bounds"),
    )
