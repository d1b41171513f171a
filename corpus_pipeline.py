"""The corpus pipeline: five stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of `documents`; `n_chars` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import disclosure, jaccard, mixing, packing, toxicity
from tallybook.llm.queries import MIX_WEIGHTS, held_out, table
from tallybook.session import is_small, keep_last, made_here, materialise

# Models and tokenizers are beyond SQL; the stages' operators have their own checks.
ORACLE_SQL = None


def measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return docs.withColumn("n_chars", length)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"), ~held_out())
    # numbered names cannot clash with those of the score; the text goes through once
    names = {c: c if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    kept = toxicity.score(numbered, model).where("toxic_flag = 0")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 the first one stays.

    A row is its id and its text: rows equal in both are one. Ids link nothing, so rows
    without one, or with a repeated one, go only if another text is like theirs. The
    first of a component is its smallest id, null last.
    """
    row = ["doc", "text_id"]
    before = len(made_here())
    linked = materialise(jaccard.link_rows(docs, size=5, percent=80).select(*row, "part"))
    keep_last(spark, before)
    first = linked.where("part IS NOT NULL").groupBy("part").agg(
        F.min(F.struct(*row)).alias("first"), F.max(F.struct(*row)).alias("last")
    )
    first = materialise(first.where("first <> last").select("part", "first"))
    alike = linked.join(F.broadcast(first) if is_small(first) else first, "part")
    gone = materialise(alike.where(F.struct(*row) != F.col("first")).select(*row).distinct())
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard.LAST)).alias("doc")
    rows = docs.select(own, doc, F.xxhash64("text").alias("text_id"))
    kept = rows.join(F.broadcast(gone) if is_small(gone) else gone, row, "left_anti")
    many = linked.groupBy(*row).agg(F.count("*").alias("rows")).where("rows > 1")
    many = materialise(many.select(*row))
    side = F.broadcast(many) if is_small(many) else many
    order = Window.partitionBy(*row).orderBy(F.xxhash64(F.to_json("own")))
    several = kept.join(side, row, "left_semi").withColumn("place", F.row_number().over(order))
    once = kept.join(side, row, "left_anti").select("own.*")
    return once.unionByName(several.where("place = 1").select("own.*"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the texts."""
    return measured(disclosure.sanitised(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return measured(mixing.mixed_documents(docs, MIX_WEIGHTS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, end_id=1, size=2048)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("personal_data", personal_data_out),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Once a stage is written, all tables before it go."""
    first = len(made_here())
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        keep_last(spark, first)
    return docs
