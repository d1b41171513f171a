"""Mixing sources to target weights by capped water-filling.

Weights share a budget of words among the sources. A source stops at a maximum
number of epochs; its excess is shared again by weight until no source exceeds
its cap. Documents are then repeated: every document whole `floor(target / size)`
times, and a seeded choice of them once more, so that the source's words meet
its target. The choice orders documents by a hash; the one bucket of hashes at
the cut gets an equal fraction of one repetition.

Null or empty text has size 0: its row is repeated with its source but adds no words, and
a source without words is left out. A null source is a source of its own,
ranked last. Rows are judged one by one: repeated rows are taken alike. An empty
table gives an empty result. Only `doc_id`, `text` and `source` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
# Hexadecimal digits of a document's bucket: the cut of a source falls into one bucket.
BUCKET_DIGITS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_sources(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """Sources with `source_size` and `weight`: weights repeat along the order of code points."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, numbered over sorted partitions without gathering them in one
    parts = materialise(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("part")
        .agg(F.count("*").alias("held"), F.min("at").alias("first"))
        .withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    )
    place = (F.col("ahead") + F.col("at") - F.col("first")) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    return parts.join(offsets, "part").select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """`sources` with `target`; the level is refilled until no source is above its cap.

    Each round sends two sums to the driver, whatever the number of sources.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped, level = F.lit(False), F.lit(0.0)
    held = -1
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, cap)).alias("fixed"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("free"),
            F.count(F.when(clamped, 1)).alias("held"),
        ).first()
        if row.held == held or not row.free:
            break
        held = row.held
        level = F.lit((share * total - (row.fixed or 0.0)) / row.free)
        clamped = clamped | (F.col("weight") * level > cap)
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * level))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with `_size`, its words, and `_bucket`, a seeded hash of document and size."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), F.col("_size")))
    bucket = F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int")
    return docs.withColumn("_size", word_count(F.col("text"))).withColumn("_bucket", bucket)


def mixing_plan(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """Per source (`_source`): its size, target, whole repetitions, and where the rest ends.

    Buckets below `_cut` are repeated once more, that one in the proportion
    `_rest` / `_held`, those above it not.
    """
    sources = materialise(ranked_sources(sizes, weights))
    sources = water_fill(sources, share, epochs).withColumnsRenamed(
        {"source": "_source", "source_size": "_source_size", "target": "_target"}
    )
    filled = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size")))
    sources = sources.withColumn("_copies", F.coalesce(filled, F.lit(0)).cast("bigint"))
    left = F.floor(F.col("_target")) - F.col("_copies") * F.col("_source_size")
    sources = materialise(sources.withColumn("_left", left))
    # one row per source and bucket; a source has at most 16^BUCKET_DIGITS buckets
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("_held"))
    running = Window.partitionBy("source").orderBy("bucket")
    ahead = F.sum("_held").over(running.rowsBetween(Window.unboundedPreceding, -1))
    cuts = (
        buckets.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
        .join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .where("_ahead <= _left AND _ahead + _held > _left")
        .selectExpr("source AS _at", "bucket AS _cut", "_left - _ahead AS _rest", "_held")
    )
    return sources.join(cuts, F.col("_source").eqNullSafe(F.col("_at")), "left").drop(
        "_at", "_left", "weight"
    )


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`keyed` rows with their source's plan and `_part`, words of a fractional repetition.

    A source without a cut has nothing to take besides whole repetitions.
    """
    part = (
        F.when(F.col("_cut").isNull() | (F.col("_bucket") > F.col("_cut")), 0)
        .when(F.col("_bucket") < F.col("_cut"), F.col("_size"))
        .otherwise(F.expr("_size * _rest div _held"))
    )
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_part", part.cast("bigint")
    )


def mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: int = 17
) -> DataFrame:
    """Per document: `size`, `source_size`, `target`, `copies` (whole repetitions), `part`
    (words of one more, fractional repetition) and `taken`, the words of them all."""
    rows = materialise(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"))
    plan = materialise(
        mixing_plan(
            rows.selectExpr("source", "_size AS size", "_bucket AS bucket"), weights, share, epochs
        )
    )
    return decided(rows, plan).selectExpr(
        "doc_id",
        "source",
        "_size AS size",
        "_source_size AS source_size",
        "_target AS target",
        "_copies AS copies",
        "_part AS part",
        "_copies * _size + _part AS taken",
    )


def mixed_documents(
    docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: int = 17
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the same columns.

    A fractional repetition is one more row that holds the text's first `part` words.
    """
    sizes = keyed(docs.select("doc_id", "source", "text"), seed)
    sizes = materialise(sizes.selectExpr("source", "_size AS size", "_bucket AS bucket"))
    plan = materialise(mixing_plan(sizes, weights, share, epochs))
    # the columns of docs are nested, so that none clashes with those of the plan
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    rows = decided(keyed(docs.select(own, "doc_id", "source", "text"), seed), plan)
    full = (F.col("_part") >= F.col("_size")) & (F.col("_size") > 0)
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    again = F.concat(
        F.array_repeat(F.lit(False), (F.col("_copies") + F.when(full, 1).otherwise(0)).cast("int")),
        F.array_repeat(F.lit(True), F.when(cut, 1).otherwise(0)),
    )
    rows = rows.withColumn("_cut_here", F.explode(again))
    # words keep the white space before them
    gap = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    first = F.concat_ws("", F.slice(F.split("text", gap), 1, F.col("_part").cast("int")))
    text = F.when(F.col("_cut_here"), first).otherwise(F.col("text")).alias("text")
    return rows.select(*(text if c == "text" else F.col(f"own.`{c}`") for c in docs.columns))
