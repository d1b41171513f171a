"""Vectors dealt to blocks, and block-against-block search shared by both vector searches.

Queries are dealt to query blocks and candidates to candidate blocks. A task holds one
pair of blocks, whose sizes are bounded, and keeps its best results per query; these
few rows meet by query. Rows are dealt by a hash of their key, so equal vectors spread.

Of repeated rows with one `vec_id` the smallest vector counts. A null `vec_id`, a null
vector or one with a null or non-finite component takes no part. Vectors are compared
with vectors of the same length only. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192


def usable(rows: DataFrame, zero: bool = True) -> DataFrame:
    """One row `vec_id, vec, dim` per key; all-zero vectors only if `zero`."""
    vec = F.col("embedding").cast("array<double>").alias("vec")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col("vec_id").cast("long"), vec)
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(~odd)
    if not zero:
        kept = kept.where(F.exists("vec", lambda x: x != 0))
    kept = kept.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return kept.withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column whose lists have equal lengths, as rows of a matrix."""
    values = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(values).astype(dtype).reshape(len(column), -1)


def block_search(
    queries: DataFrame,
    candidates: DataFrame,
    search: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    score: str,
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best candidates of every query.

    `search` gets a block of queries and one of candidates and returns query ids,
    candidate ids and scores: at least the k best of this pair of blocks per query.
    """
    n_queries = -(-queries.count() // QUERY_BLOCK)
    n_candidates = -(-candidates.count() // CANDIDATE_BLOCK)
    if not n_queries or not n_candidates:
        spark = queries.sparkSession
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.withColumn(own, block).withColumn(other, every)

    left = dealt(queries, "q_block", n_queries, "c_block", n_candidates)
    right = dealt(candidates, "c_block", n_candidates, "q_block", n_queries)

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        columns = ([], [], [])
        if asked.num_rows and held.num_rows:
            columns = search(asked, held)
        kind = pa.int64() if score == "long" else pa.float64()
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind))],
            names=["query_id", "vec_id", "score"],
        )

    keys = ["q_block", "c_block", "dim"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(pair, f"query_id long, vec_id long, score {score}")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
