"""Exact top-k search by pivot-table elimination.

Vectors become integers floor(scale * x); the score is their inner product. Distances
of every row to a fixed number of pivots are computed once and stored. For a query q
and a candidate c, |d(q, p) - d(c, p)| is at most d(q, c) for each pivot p; the largest
of these bounds gives the highest score that c can have:
(|q|^2 + |c|^2 - bound^2) / 2. Candidates are evaluated in the order of that bound
until the next one cannot enter the k best; ties go to the smaller `vec_id`.

Scores are exact: 64-bit integers where products fit 53 bits, Python integers beyond
(clipped to the range of a long on output). Rules for odd rows: see `vectors`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.vectors import block_search, matrix, usable
from tallybook.session import materialise

PIVOTS = 32
# Candidates evaluated between two looks at the bound.
STEP = 64
# Share of a bound's size by which rounding may make it too small.
SLACK = 1e-9


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows with an integer-valued query."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    largest = np.abs(rows).max() * np.abs(query).max() * max(1, rows.shape[1])
    if largest < 2**53:
        return (rows @ query).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    asked = [int(x) for x in query]
    limit = 2**63 - 1
    sums = (sum(a * b for a, b in zip(row, asked)) for row in whole)
    return np.array([max(-limit - 1, min(limit, s)) for s in sums], np.int64)


def pivot_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`rows` with `far`: distances to the pivots, and `norm`, the squared length."""

    def measure(batches):
        for batch in batches:
            vectors = matrix(pa.chunked_array([batch.column("vec")])) if batch.num_rows else None
            if vectors is None:
                continue
            far = np.linalg.norm(vectors[:, None, :] - pivots[None, :, :], axis=2)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), max(1, far.shape[1]))
            norm = pa.array((vectors * vectors).sum(axis=1))
            names = [*batch.schema.names, "far", "norm"]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists.cast(pa.list_(pa.float64())), norm], names=names
            )

    return rows.mapInArrow(
        measure, "vec_id long, vec array<double>, dim int, far array<double>, norm double"
    )


def search_block(k: int):
    def search(asked: pa.Table, held: pa.Table):
        ids = held.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        vectors, far = matrix(held.column("vec"))[order], matrix(held.column("far"))[order]
        norms = held.column("norm").to_numpy()[order]
        out: tuple[list, list, list] = ([], [], [])
        rows = zip(
            asked.column("vec_id").to_pylist(),
            matrix(asked.column("vec")),
            matrix(asked.column("far")),
            asked.column("norm").to_pylist(),
        )
        for own, query, query_far, norm in rows:
            bound = np.abs(far - query_far).max(axis=1)
            top = (norm + norms - bound * bound) / 2 + SLACK * (norm + norms) + 1
            top[ids == own] = -np.inf
            # by bound, ties by id: rows are in the order of ids and the sort is stable
            by_bound = np.argsort(-top, kind="stable")
            best_score, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
            for first in range(0, len(by_bound), STEP):
                part = by_bound[first : first + STEP]
                part = part[top[part] > -np.inf]
                if not len(part) or (len(best_id) == k and top[part[0]] < best_score[-1]):
                    break
                best_score = np.concatenate([best_score, exact_scores(vectors[part], query)])
                best_id = np.concatenate([best_id, ids[part]])
                keep = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[keep], best_id[keep]
            out[0].extend([own] * len(best_id))
            out[1].extend(best_id.tolist())
            out[2].extend(best_score.tolist())
        return out

    return search


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best rows for every row with `is_query`."""
    scaled = F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
    whole = materialise(usable(rows).withColumn("vec", scaled))
    tables = []
    for (dim,) in whole.select("dim").distinct().collect():
        same = whole.where(F.col("dim") == dim)
        # pivots: a bounded sample of the rows in the order of a hash
        chosen = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
        pivots = np.array([r.vec for r in chosen], float).reshape(len(chosen), dim)
        tables.append(pivot_distances(same, pivots))
    if not tables:
        table = whole.withColumn("far", F.col("vec")).withColumn("norm", F.lit(0.0))
    else:
        table = tables[0]
        for other in tables[1:]:
            table = table.unionByName(other)
    table = materialise(table)
    return block_search(table.where(is_query), table, search_block(k), k, "long")
