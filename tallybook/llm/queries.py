"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    collocations,
    disclosure,
    jaccard,
    licences,
    mixing,
    neighbours,
    packing,
    quantisation,
    repeats,
    shards,
    topk,
    toxicity,
    whitening,
)
from tallybook.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Sources by code point, null last, weigh these, repeating.
MIX_WEIGHTS = [5.0, 2.0, 1.0]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    store = shards.write_store(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
        folder=scratch_path(spark, "token-shards"),
    )
    found = shards.get(store, docs)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


@query
def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


@query
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.kept_digests(table(spark, folder, "documents"), size=20)


@query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_documents(table(spark, folder, "documents"), size=4, percent=85)


def held_out(doc_id: str = "doc_id"):
    """A third of all documents, whose labels no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train_model(docs, table(spark, folder, "labels"), ~held_out())
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_flag").alias("predicted"),
    )


@query
def op6_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    spans = disclosure.all_spans(table(spark, folder, "documents"))
    counts = [disclosure.count_kind(F.col("base"), k).alias(f"n_{k}") for k in disclosure.KINDS]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(disclosure.listed(F.col("base")), 256).alias("base_sha256"),
        disclosure.listed(F.concat("base", "terms")).alias("spans"),
    )


@query
def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.document_licences(table(spark, folder, "documents"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), count=4, scale=256.0)


@query
def op11_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return quantisation.near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), limit=2000, least=10)
