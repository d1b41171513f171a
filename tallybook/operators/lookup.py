"""Attaching per-key values to rows when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.session import BROADCAST_BYTES, is_small, join_null_safe, materialise

# Rows of one key that one task should join; a heavier key is dealt to several.
TASK_ROWS = 1_000_000
_PARTS = "_parts"
_PART = "_part"
# Bits of one row of a key filter, as Spark's bitmap functions deal them.
CHUNK_BITS = 32_768
# Bits of a key filter for each key, and bytes of the largest filter.
KEY_BITS = 16
FILTER_BYTES = BROADCAST_BYTES
_CHUNK = "_chunk"
_BITS = "_bits"
_KNOWN = "_known"


def join_key_values(
    rows: DataFrame, values: DataFrame, keys: list[str], weight: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Left join `values` (one row per key, materialised) to `rows`; NULL keys match.

    Values measured to be small are broadcast. Otherwise every key whose `weight`, its
    number of rows, is above `task_rows` is dealt to as many parts as that takes: its
    rows by their place, its value once for each part. There are at most
    rows / `task_rows` such keys, and their list is what travels to the rows.
    """
    if is_small(values):
        return join_null_safe(rows, values, keys, "left", broadcast=True)
    parts = F.ceil(F.col(weight) / F.lit(float(task_rows))).cast("int")
    heavy = values.where(F.col(weight) > task_rows).select(*keys, parts.alias(_PARTS))
    marked = join_null_safe(rows, heavy, keys, "left", broadcast=is_small(heavy))
    place = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(_PARTS), F.lit(1)).cast("bigint"))
    dealt = marked.withColumn(_PART, place).drop(_PARTS)
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(parts, F.lit(1)).cast("bigint") - 1)
    copied = values.withColumn(_PART, F.explode(every))
    return join_null_safe(dealt, copied, [*keys, _PART], "left").drop(_PART)


def mark_keys(
    rows: DataFrame, values: DataFrame, keys: list[str], weight: str, name: str
) -> DataFrame:
    """Rows with a flag `name`: their key is in `values` (one row per key, materialised).

    NULL keys match. Where the values are too many for a broadcast, a bitmap of their key
    hashes is: rows whose bit is not set stay where they are, and only the others, those with
    a key in `values` and a few whose hash falls on a bit of another key, are joined. The
    bitmap does not outgrow `FILTER_BYTES`; a fuller one lets more rows through to the join.
    `rows` are then read twice and should be cheap to read.
    """
    known = F.col(weight).isNotNull()
    if is_small(values):
        return join_key_values(rows, values, keys, weight).withColumn(name, known).drop(weight)
    size = max(1, min(-(-values.count() * KEY_BITS // CHUNK_BITS), FILTER_BYTES * 8 // CHUNK_BITS))
    chunks, place = F.broadcast(_key_filter(values, keys, size)), _place(keys, size)
    met = rows.join(chunks, (place / F.lit(CHUNK_BITS)).cast("bigint") == F.col(_CHUNK), "left")
    offset = place % F.lit(CHUNK_BITS)
    byte = F.col(_BITS).substr((offset / F.lit(8)).cast("int") + 1, F.lit(1))
    bit = F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("bigint"), (offset % F.lit(8)).cast("int"))
    is_set = F.coalesce(bit == 1, F.lit(False))
    joined = join_key_values(met.where(is_set).select(*rows.columns), values, keys, weight)
    others = met.where(~is_set).select(*rows.columns, F.lit(False).alias(name))
    # written, or whoever splits the rows by the flag would join once for each side
    return others.unionByName(materialise(joined.withColumn(name, known).drop(weight)))


def split_by_keys(
    rows: DataFrame, values: DataFrame, keys: list[str], weight: str
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not in `values`, and rows whose key is; see `mark_keys`."""
    marked = mark_keys(rows, values, keys, weight, _KNOWN)
    return marked.where(~F.col(_KNOWN)).drop(_KNOWN), marked.where(_KNOWN).drop(_KNOWN)


def _place(keys: list[str], size: int) -> Column:
    """The bit of a key in a filter of `size` chunks."""
    return F.pmod(F.xxhash64(*keys), F.lit(size * CHUNK_BITS).cast("bigint"))


def _key_filter(values: DataFrame, keys: list[str], size: int) -> DataFrame:
    """`_chunk, _bits`: a bit is set if a key of `values` hashes to it."""
    places = values.select(_place(keys, size).alias("_place"))
    chunks = places.withColumn(_CHUNK, (F.col("_place") / F.lit(CHUNK_BITS)).cast("bigint"))
    # dealt first: a task that held bits of every chunk would send as much as the whole filter
    dealt = chunks.repartition(_CHUNK)
    return materialise(
        dealt.groupBy(_CHUNK).agg(F.bitmap_construct_agg(F.col("_place") % F.lit(CHUNK_BITS)).alias(_BITS))
    )


def key_counts(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per key, summed on the map side first; NULL keys are one key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
