"""From raw files to the two analytical datasets and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.expressions import count_where
from tallybook.operators.dedup import exact_repeat_stats, repeats_left
from tallybook.operators.derive import primary_with_stats, sensitivity_dataset
from tallybook.sources.csv import CsvLayout, load_raw
from tallybook.sources.manifest import file_digests, validate_manifest
from tallybook.sources.publish import new_version, publish_tables, publish_views, write_datasets
from tallybook.spec import CatalogSpec


class BuildError(Exception):
    """The built datasets break their own rules; nothing was published."""


@dataclass(frozen=True)
class Built:
    primary: DataFrame
    sensitivity: DataFrame
    # rows in duplicate groups, rows removed, rows before and after
    dedup_stats: DataFrame
    folder: str


def build_datasets(raw: DataFrame, spec: CatalogSpec, folder: str) -> Built:
    """Clean `raw` and write both datasets under `folder`.

    The sensitivity dataset starts from the written primary one, so the raw
    table is cleaned once.
    """
    primary, stats = primary_with_stats(raw, spec)
    primary = write_datasets({"primary": primary}, folder)["primary"]
    sensitivity = write_datasets({"sensitivity": sensitivity_dataset(primary, spec)}, folder)
    return Built(primary, sensitivity["sensitivity"], stats, folder)


def build_from_files(
    spark: SparkSession,
    path: str,
    layout: CsvLayout,
    spec: CatalogSpec,
    folder: str,
    tables: dict[str, str],
    manifest: DataFrame | None = None,
    as_tables: bool = False,
    check_digests: bool = True,
) -> Built:
    """Check digests, load, clean, write, check the result and publish.

    `tables` maps `primary` and `sensitivity` to the published names. Files without a
    `manifest` (`file, digest`) are refused unless `check_digests` is off. Every build
    writes a version of its own below `folder` and publishes it last: one that fails
    leaves the tables of the build before it readable.
    """
    if check_digests:
        if manifest is None:
            raise ValueError("a manifest of file digests is needed, or check_digests=False")
        validate_manifest(file_digests(spark, path), manifest)
    built = build_datasets(load_raw(spark, path, layout), spec, new_version(folder))
    broken = post_checks(built, spec).where("violations > 0").collect()
    if broken:
        told = ", ".join(f"{r.dataset} {r.check}: {r.violations}" for r in broken)
        raise BuildError(f"the built datasets break their rules ({told})")
    if as_tables:
        publish_tables({tables[k]: f"{built.folder}/{k}.parquet" for k in ("primary", "sensitivity")}, spark)
    else:
        publish_views({tables["primary"]: built.primary, tables["sensitivity"]: built.sensitivity})
    return built


def build_counts(built: Built) -> DataFrame:
    """Rows of both datasets."""
    counts = [
        df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"))
        for name, df in (("primary", built.primary), ("sensitivity", built.sensitivity))
    ]
    return counts[0].unionByName(counts[1])


def row_checks(df: DataFrame, spec: CatalogSpec) -> dict[str, Column]:
    """Rows that break a row-level rule of the derived columns, per rule."""
    score = F.col(spec.score)
    in_range = score.between(spec.score_min, spec.score_max)
    scaled = F.col(spec.size) / F.lit(spec.size_divisor)
    known = F.col(spec.category).isNotNull()
    high = F.coalesce(F.col(spec.tier) == spec.tier_labels[-1], F.lit(False))
    return {
        "score_out_of_range": count_where(~in_range),
        "tier_and_flag_differ": count_where(F.col(spec.is_high) != high),
        "category_flag_differs": count_where(F.col(spec.has_category) != known),
        "scaled_size_differs": count_where(~F.col(spec.size_scaled).eqNullSafe(scaled)),
        "exact_repeat_flagged": count_where(F.col(spec.exact_repeat)),
    }


def post_checks(built: Built, spec: CatalogSpec) -> DataFrame:
    """Violations per check and dataset; all are expected to be zero."""

    def violations(name: str, df: DataFrame) -> DataFrame:
        rules = row_checks(df, spec)
        by_rule = df.agg(*(rule.alias(check) for check, rule in rules.items())).unpivot(
            [], list(rules), "check", "violations"
        )
        return by_rule.select(F.lit(name).alias("dataset"), "check", "violations")

    def leftover(name: str, check: str, left: DataFrame, count: str) -> DataFrame:
        return left.select(
            F.lit(name).alias("dataset"), F.lit(check).alias("check"), F.col(count).alias("violations")
        )

    raw = spec.raw_columns(built.primary.columns)
    exact = exact_repeat_stats(built.primary, raw)
    by_key = repeats_left(built.sensitivity, spec.key)
    return (
        violations("primary", built.primary)
        .unionByName(violations("sensitivity", built.sensitivity))
        .unionByName(leftover("primary", "exact_repeats_left", exact, "rows_removed"))
        .unionByName(leftover("sensitivity", "key_repeats_left", by_key, "repeats_left"))
    )
