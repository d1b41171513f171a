"""Finding and removing duplicates.

Whole-row duplicates are found through a 64-bit row hash: only rows whose hash
occurs twice are ever shuffled or compared in full, so a table with few
duplicates is deduplicated without moving its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import content_key
from tallybook.operators.lookup import join_key_values, key_counts, mark_keys, split_by_keys
from tallybook.session import join_null_safe, materialise
from tallybook.spec import CatalogSpec

_HASH = "_row_hash"
_CHECK = "_row_check"
_COPIES = "_copies"


def _split_by_suspicion(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a hash of their own, and the rows that share theirs, if any."""
    hashes = df.select(F.xxhash64(*columns).alias(_HASH))
    suspects = materialise(key_counts(hashes, [_HASH], _COPIES).where(F.col(_COPIES) > 1))
    if not suspects.limit(1).count():
        return df, None
    hashed = df.withColumn(_HASH, F.xxhash64(*columns))
    alone, shared = split_by_keys(hashed, suspects, [_HASH], _COPIES)
    return alone.drop(_HASH), shared.drop(_HASH)


def split_by_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a key of their own, and the rows that share theirs, if any.

    Keys are counted on `keys` alone. Equal rows share their key, so that whatever is done
    about repeats concerns the second part only.
    """
    repeated = materialise(key_counts(df, keys, _COPIES).where(F.col(_COPIES) > 1))
    if not repeated.limit(1).count():
        return df, None
    return split_by_keys(df, repeated, keys, _COPIES)


@dataclass(frozen=True)
class Distinct:
    """Rows without exact repeats, and the groups that lost rows, if any."""

    rows: DataFrame
    groups: DataFrame | None


def distinct_rows(df: DataFrame, columns: list[str]) -> Distinct:
    """Keep one of each group of rows equal in `columns`.

    `columns` are the raw ones: derived columns follow from them, so the kept
    copy does not depend on which one it is. Copies shrink to a counted group
    on the map side, however many there are.
    """
    df = df.select(*columns)
    alone, shared = _split_by_suspicion(df, columns)
    if shared is None:
        return Distinct(alone, None)
    groups = materialise(key_counts(shared, columns, _COPIES))
    return Distinct(alone.unionByName(groups.select(*columns)), groups.where(F.col(_COPIES) > 1))


def drop_exact_repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    return distinct_rows(df, columns).rows


def flag_exact_repeats(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Mark every member, the first included, of a group of equal rows.

    Groups are counted on whole rows but meet their rows on two hashes, so that
    no wide row is broadcast or joined on. Should two groups ever agree in both
    hashes, the rows are joined on all columns instead.
    """
    alone, shared = _split_by_suspicion(df, columns)
    alone = alone.withColumn(name, F.lit(False))
    if shared is None:
        return alone
    hashes = {_HASH: F.xxhash64(*columns), _CHECK: F.xxhash64(F.lit(name), *columns)}
    groups = key_counts(shared, columns, _COPIES).withColumns(hashes)
    keys = materialise(groups.select(*hashes, _COPIES))
    if key_counts(keys, [*hashes]).where(F.col("n") > 1).limit(1).count():
        counted = join_null_safe(shared, groups.drop(*hashes), columns, "left")
    else:
        counted = join_key_values(shared.withColumns(hashes), keys, [*hashes], _COPIES)
    flagged = counted.withColumn(name, F.col(_COPIES) > 1)
    return alone.unionByName(flagged.select(*alone.columns))


def flag_key_repeats(
    df: DataFrame, keys: list[str], name: str, weights: DataFrame | None = None
) -> DataFrame:
    """Mark every row whose key occurs more than once.

    `weights` may hold the keys with a `_copies` weight to be summed, where
    counting the keys of `df` itself would compute `df` once more.
    """
    if weights is None:
        weights = df.select(*keys, F.lit(1).alias(_COPIES))
    counts = weights.groupBy(*keys).agg(F.sum(_COPIES).alias(_COPIES))
    repeated = materialise(counts.where(F.col(_COPIES) > 1))
    return mark_keys(df, repeated, keys, _COPIES, name)


def flag_keys_of_distinct(df: DataFrame, distinct: Distinct, keys: list[str], name: str) -> DataFrame:
    """Mark the repeated keys among the distinct rows of `df`.

    The keys are counted on `df` itself, less the removed copies: two columns
    are read for it instead of deduplicating once more.
    """
    weights = df.select(*keys, F.lit(1).cast("bigint").alias(_COPIES))
    if distinct.groups is not None:
        removed = distinct.groups.select(*keys, (1 - F.col(_COPIES)).alias(_COPIES))
        weights = weights.unionByName(removed)
    return flag_key_repeats(distinct.rows, keys, name, weights)


def repeat_stats(df: DataFrame, groups: DataFrame | None) -> DataFrame:
    """One row: rows in duplicate groups, rows a dedup removes, rows before and after."""
    zero = F.lit(0).cast("bigint")
    total = df.agg(
        zero.alias("rows_in_groups"), zero.alias("rows_removed"), F.count(F.lit(1)).alias("rows_before")
    )
    if groups is not None:
        removed = groups.agg(
            F.coalesce(F.sum(_COPIES), zero).alias("rows_in_groups"),
            F.coalesce(F.sum(F.col(_COPIES) - 1), zero).alias("rows_removed"),
            zero.alias("rows_before"),
        )
        total = total.unionByName(removed)
    return total.agg(
        *(F.sum(c).alias(c) for c in ("rows_in_groups", "rows_removed", "rows_before"))
    ).withColumn("rows_after", F.col("rows_before") - F.col("rows_removed"))


def exact_repeat_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    _, shared = _split_by_suspicion(df, columns)
    groups = None if shared is None else key_counts(shared, columns, _COPIES)
    return repeat_stats(df, None if groups is None else groups.where(F.col(_COPIES) > 1))


def key_repeat_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: repeated keys, rows under them, size of the largest group."""
    n = F.col("n")
    return key_counts(df, keys).agg(
        F.count_if(n > 1).alias("repeat_groups"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_repeat_groups"),
        F.max(n).alias("largest_group_size"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Spark keeps one row per key on the map side
    already (`WindowGroupLimit`), so a hot key costs one row per input task."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def one_row_per_key(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """The sensitivity dataset: per key the earliest row, NULL years last.

    The order never looks at the score. Rows that tie on it are told apart by a
    digest of the identifying columns, then by the row hash, neither of which
    follows the score's size. Rows with a key of their own are not moved; `df`
    is read more than once.
    """
    raw = spec.raw_columns(df.columns)
    order = [F.asc_nulls_last(spec.year), F.asc_nulls_last(spec.segment)]
    if spec.identity:
        order.append(content_key(list(spec.identity)))
    order.append(F.xxhash64(*raw))
    alone, shared = split_by_key(df, spec.key)
    kept = alone if shared is None else alone.unionByName(first_per_key(shared, spec.key, order))
    # recomputed: one row per key leaves no repeats
    return kept.withColumn(spec.key_repeat, F.lit(False))


def repeats_left(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows a dedup on `keys` would still remove."""
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats_left")
    )
