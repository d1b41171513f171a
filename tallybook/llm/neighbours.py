"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest distance: candidates are divided by the
longest length M of all and get one more component sqrt(1 - |c|^2 / M^2), queries are
divided by their own length and get 0. Each of `tables` hash tables concatenates
`width` functions floor((a.x + b) / w) with Gaussian a. Besides its own bucket a query
visits perturbed buckets, in the order of their estimated success: the expected
squared distance to the boundaries that a perturbation crosses. Candidates of all
tables are merged and ranked by the exact inner product of the original vectors.

A candidate goes once per table to the task of its bucket, a query once to each task
that holds buckets it visits; nothing is copied per block of queries. Buckets with more
than `CHUNK` rows, or visits, are dealt to several tasks, whose best results meet by query.

Every row is indexed; no bucket is capped. The functions come from a fixed seed, so
nothing is fitted. A query that meets fewer than k candidates is searched exhaustively.

Scores are summed one component after the other, so a pair's score depends on its two
vectors only, and equal scores are ordered by vec_id. Of equal vectors in one bucket the
k + 1 smallest ids are looked at: the others cannot be among the k nearest. Columns
besides `vec_id` and `embedding` are not read, whatever their names; the length of a
vector is bounded by a task's memory only. Further rules for odd rows: see `vectors`;
all-zero vectors take no part either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.vectors import block_search, matrix, usable
from tallybook.session import is_small, materialise

TABLES = 12
WIDTH = 8
PROBES = 40
BUCKET = 2.4
SEED = 20
# Rows, or visits, of one bucket that one task takes, and candidates in one task.
CHUNK = 8192
TASK_ROWS = 32768
# Queries multiplied with a bucket at once, and pairs scored at once.
ASKED = 256
PAIRS = 1 << 15


def probe_order(width: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary ranks (0: the nearest of 2 * width), best expected success first.

    The j-th nearest boundary of uniformly placed points has a known expected squared
    distance; a set is worth the sum, and may not cross both boundaries of a function.
    """
    j = np.arange(1, width + 1)
    near = j * (j + 1) / (4 * (width + 1) * (width + 2))
    i = 2 * width + 1 - np.arange(width + 1, 2 * width + 1)
    far = 1 - i / (width + 1) + i * (i + 1) / (4 * (width + 1) * (width + 2))
    cost = np.concatenate([near, far])
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, ranks = heapq.heappop(heap)
        if all(2 * width - 1 - r not in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return found


class Hashing:
    """The hash functions for vectors of one length, the same in every task."""

    def __init__(self, dim: int, tables: int, width: int, bucket: float, seed: int):
        made = np.random.default_rng([seed, dim])
        self.lines = made.standard_normal((tables, dim + 1, width)) / bucket
        self.shifts = made.random((tables, width))
        # a bucket's key is a sum, so that a step over a boundary adds to it
        self.keys = made.integers(1, 2**62, size=(tables, width), dtype=np.int64) | 1
        self.first = made.integers(1, 2**62, size=tables, dtype=np.int64)

    def places(self, table: int, points: np.ndarray) -> np.ndarray:
        return points @ self.lines[table] + self.shifts[table]

    def own_buckets(self, points: np.ndarray) -> np.ndarray:
        """The bucket of each point in each table."""
        found = [
            (np.floor(self.places(t, points)).astype(np.int64) * self.keys[t]).sum(axis=1) + self.first[t]
            for t in range(len(self.lines))
        ]
        return np.stack(found, axis=1)

    def visited_buckets(self, points: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
        """The buckets that a query at each point visits in all tables."""
        home = self.own_buckets(points)
        found = []
        for t in range(len(self.lines)):
            at = self.places(t, points)
            low = at - np.floor(at)
            # ranks of the boundaries: i below `width` is the lower one of function i
            width = at.shape[1]
            ranks = np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1, kind="stable")
            moves = np.where(ranks < width, -1, 1) * self.keys[t][ranks % width]
            found.extend(home[:, t] + moves[:, list(r)].sum(axis=1) for r in order)
        return np.stack(found, axis=1)


def bucketed(
    rows: DataFrame, longest: float, order: list[tuple[int, ...]] | None, **made
) -> DataFrame:
    """`rows` with `keys`: own buckets, or with an `order` the buckets visited as a query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                vectors = matrix(pa.chunked_array([part.column("vec")]))
                hashing = Hashing(dim, **made)
                if order is None:
                    scaled = vectors / longest
                    rest = np.sqrt(np.maximum(1.0 - (scaled * scaled).sum(axis=1), 0.0))
                    keys = hashing.own_buckets(np.column_stack([scaled, rest]))
                else:
                    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                    points = np.column_stack([vectors / size, np.zeros(len(vectors))])
                    keys = hashing.visited_buckets(points, order)
                ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "keys"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(read, f"{kinds}, keys array<long>")


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def foremost(query: np.ndarray, score: np.ndarray, margin: np.ndarray, k: int) -> np.ndarray:
    """Places of the scores that are at most `margin` below the k-th best of their query."""
    order = np.lexsort((-score, query))
    query, sorted_score = query[order], score[order]
    first = np.searchsorted(query, query)
    last = np.searchsorted(query, query, "right") - 1
    least = sorted_score[np.minimum(first + k - 1, last)]
    return order[sorted_score >= least - margin[query]]


def best_of(
    own: np.ndarray,
    queries: np.ndarray,
    slots: tuple[np.ndarray, np.ndarray],
    ids: np.ndarray,
    vectors: np.ndarray,
    slot: np.ndarray,
    k: int,
    longest: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores: of each query the k best rows in its slots.

    `slots` are pairs of a query's place and a slot it visits; `slot` has each candidate's.
    """
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    same = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, same, slot))
    run = np.concatenate([[True], (np.diff(slot[order]) != 0) | (np.diff(same[order]) != 0)])
    begun = np.flatnonzero(run)
    place = np.arange(len(order)) - begun[np.cumsum(run) - 1]
    order = order[place <= k]
    ids, vectors, slot = ids[order], vectors[order], slot[order]
    asker, wanted = slots
    first, last = np.searchsorted(slot, wanted, "left"), np.searchsorted(slot, wanted, "right")
    asker, first, last = (a[first < last] for a in (asker, first, last))
    by_slot = np.argsort(first, kind="stable")
    asker, first, last = asker[by_slot], first[by_slot], last[by_slot]
    # a rough product is right to far less than this
    margin = 8 * np.finfo(float).eps * vectors.shape[1] * longest * np.sqrt((queries * queries).sum(axis=1))
    rows: list[np.ndarray] = [np.zeros(0, np.int64)]
    columns: list[np.ndarray] = [np.zeros(0, np.int64)]
    rough: list[np.ndarray] = [np.zeros(0)]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(first) != 0])) if len(first) else []
    for a, b in zip(starts, [*starts[1:], len(first)]):
        low, high = first[a], last[a]
        for at in range(a, b, ASKED):
            some = asker[at : min(b, at + ASKED)]
            product = queries[some] @ vectors[low:high].T
            product[own[some][:, None] == ids[low:high]] = -np.inf
            least = np.full(len(some), np.finfo(float).min)
            if high - low > k:
                least = np.maximum(np.partition(product, high - low - k, axis=1)[:, high - low - k] - margin[some], least)
            x, y = np.nonzero(product >= least[:, None])
            rows.append(some[x])
            columns.append(low + y)
            rough.append(product[x, y])
    row, column, score = np.concatenate(rows), np.concatenate(columns), np.concatenate(rough)
    # a candidate may be met in several tables
    number = np.unique(ids, return_inverse=True)[1]
    once = np.unique(row * (len(ids) + 1) + number[column], return_index=True)[1]
    row, column, score = row[once], column[once], score[once]
    some = foremost(row, score, margin, k)
    row, column = row[some], column[some]
    exact = np.concatenate(
        [np.zeros(0)]
        + [dot(queries[row[i : i + PAIRS]], vectors[column[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    )
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return own[row[kept]], ids[column[kept]], exact[kept]


def search_all(k: int, longest: float):
    """Search of one block of candidates by every query of a block."""

    def search(asked: pa.Table, held: pa.Table):
        own, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("vec"))
        ids, vectors = held.column("vec_id").to_numpy(), matrix(held.column("vec"))
        everyone = (np.arange(len(own)), np.zeros(len(own), np.int64))
        return best_of(own, queries, everyone, ids, vectors, np.zeros(len(ids), np.int64), k, longest)

    return search


def search_buckets(table: DataFrame, queries: DataFrame, k: int, longest: float, order, **made) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k best candidates in the visited buckets."""
    held = materialise(bucketed(table, longest, None, **made))
    asked = materialise(bucketed(queries, longest, order, **made))
    held_keys = held.select("vec_id", "vec", "dim", F.explode("keys").alias("key"))
    asked_keys = asked.select("vec_id", "vec", "dim", F.explode("keys").alias("key"))
    counts = held_keys.select("key", F.lit(1).alias("held"), F.lit(0).alias("asked")).unionByName(
        asked_keys.select("key", F.lit(0).alias("held"), F.lit(1).alias("asked"))
    )
    counts = counts.groupBy("key").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked"))
    heavy = counts.where((F.col("held") > CHUNK) | (F.col("asked") > CHUNK))

    def chunks(name: str) -> Column:
        return F.greatest(F.ceil(F.col(name) / CHUNK), F.lit(1)).cast("int").alias(f"{name}_parts")

    heavy = materialise(heavy.select("key", "held", chunks("held"), chunks("asked")))
    copies = heavy.agg(F.sum(F.col("held") * (F.col("asked_parts") - 1))).first()[0] or 0
    n_places = max(1, -(-(held.count() * made["tables"] + copies) // TASK_ROWS))
    side = heavy.drop("held")
    side = F.broadcast(side) if is_small(side) else side

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        parts = {name: F.coalesce(f"{name}_parts", F.lit(1)) for name in (own, other)}
        dealt = rows.join(side, "key", "left").withColumn(own, F.pmod(F.xxhash64("vec_id"), parts[own]).cast("int"))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), parts[other] - 1)))
        dealt = dealt.withColumn("slot", F.xxhash64("key", "held", "asked"))
        return dealt.withColumn("place", F.pmod(F.xxhash64("slot"), F.lit(n_places)).cast("int"))

    left = placed(asked_keys, "asked", "held").groupBy("place", "dim", "vec_id")
    left = left.agg(F.first("vec").alias("vec"), F.collect_set("slot").alias("slots"))
    right = placed(held_keys, "held", "asked").select("place", "dim", "vec_id", "vec", "slot")

    def search(asking: pa.Table, holding: pa.Table) -> pa.Table:
        columns = ([], [], [])
        if asking.num_rows and holding.num_rows:
            lists = asking.column("slots").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            visits = (np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy())
            columns = best_of(
                asking.column("vec_id").to_numpy(),
                matrix(asking.column("vec")),
                visits,
                holding.column("vec_id").to_numpy(),
                matrix(holding.column("vec")),
                holding.column("slot").to_numpy(),
                k,
                longest,
            )
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

    found = (
        left.groupBy("place", "dim")
        .cogroup(right.groupBy("place", "dim"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    # a pair met in several tasks has one score, so its rows share a rank
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score").distinct()


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = TABLES,
    width: int = WIDTH,
    probes: int = PROBES,
    bucket: float = BUCKET,
    seed: int = SEED,
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k nearest found for every row with `is_query`."""
    table = usable(rows, zero=False)
    # floats travel as floats
    if dict(rows.dtypes)["embedding"] == "array<float>":
        table = table.withColumn("vec", F.col("vec").cast("array<float>"))
    table = materialise(table)
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = float(table.agg(F.sqrt(F.max(squares))).first()[0] or 1.0)
    queries = table.where(is_query)
    order = probe_order(width, probes)
    made = {"tables": tables, "width": width, "bucket": bucket, "seed": seed}

    first = materialise(search_buckets(table, queries, k, longest, order, **made))
    # queries that met too few candidates, unless the table has no more
    others = table.groupBy("dim").agg((F.count("*") - 1).alias("_others"))
    held = first.groupBy("query_id").agg(F.count("*").alias("_held"))
    short = (
        queries.join(held, F.col("vec_id") == F.col("query_id"), "left")
        .join(others, "dim")
        .where(F.coalesce("_held", F.lit(0)) < F.least(F.lit(k), F.col("_others")))
        .select("vec_id", "vec", "dim")
    )
    short = materialise(short)
    again = block_search(short, table, search_all(k, longest), k, "double")
    kept = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.unionByName(again).select("query_id", "rank", "vec_id", "score")
