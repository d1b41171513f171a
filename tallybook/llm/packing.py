"""Packing documents into fixed-length sequences by cutting-stock column generation.

Every document is encoded and ended with one id. It is cut into pieces of `size`
tokens; what is left is cut once more into a multiple of `UNIT` and a tail below
`UNIT`, so that the lengths fall into few classes without rounding. A linear program
over patterns (how many pieces of each class share a sequence) minimises the number
of sequences; a knapsack dynamic program prices new patterns until none helps.
Pattern counts are rounded down; what is left over is packed by knapsacks over the
remaining counts. Pieces are ranked within their class; a rank names a pattern's
instance and a place in it by arithmetic alone, so no rows are shuffled or gathered.

The driver holds the class histogram only: at most `size / UNIT + UNIT` numbers,
whatever the number of documents. A null text is an empty document: one piece with
the end id. Repeated rows are packed one by one. An empty table gives an empty
result. Only `doc_id` and `text` are read; a null `doc_id` stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.encode import Ids, encoder
from tallybook.llm.text import pieces, release
from tallybook.session import is_small, materialise

UNIT = 32
# A pattern must price above a whole sequence by this much to be worth adding.
GAIN = 1e-6

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("task", pa.int64()),
        ("place", pa.int64()),
    ]
)


def cuts(tokens: int, size: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    whole, rest = divmod(tokens, size)
    tail = rest % UNIT
    return [size] * whole + [n for n in (rest - tail, tail) if n]


def cut_documents(
    docs: DataFrame, encode: Callable[[pa.Array], Ids], end_id: int, size: int
) -> DataFrame:
    """Pieces of all documents with their ids and their place within task and class."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for part in pieces(batch):
                rows = []
                keys = part.column("doc_id").to_pylist()
                found = encode(part.column("text"))
                for key, a, b in zip(keys, found.bounds[:-1], found.bounds[1:]):
                    ids = found.ids[a:b].tobytes() + end
                    start, tokens = 0, len(ids) // 4
                    for n in cuts(tokens, size):
                        place = seen.get(n, 0)
                        seen[n] = place + 1
                        raw = ids[4 * start : 4 * (start + n)]
                        rows.append((key, start, n, raw, tokens, task, place))
                        start += n
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)]
                yield pa.RecordBatch.from_arrays(columns, schema=PIECES)
        release()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, place long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int, limits: np.ndarray | None = None):
    """Counts of each length that fit `size` at the highest total price, and that price.

    With `limits` no length is used more often than its limit.
    """
    best = np.zeros(size + 1)
    if limits is None:
        choice = np.full(size + 1, -1)
        order = np.argsort(lengths)
        sorted_lengths, sorted_prices = lengths[order], prices[order]
        for room in range(1, size + 1):
            n = np.searchsorted(sorted_lengths, room, "right")
            best[room] = best[room - 1]
            if n:
                values = sorted_prices[:n] + best[room - sorted_lengths[:n]]
                i = int(np.argmax(values))
                if values[i] > best[room] + 1e-15:
                    best[room], choice[room] = values[i], order[i]
        counts, room = np.zeros(len(lengths), np.int64), size
        while room:
            if choice[room] < 0:
                room -= 1
            else:
                counts[choice[room]] += 1
                room -= lengths[choice[room]]
        return counts, best[size]
    # bounded: a count is taken as binary bundles
    bundles = []
    for i, n in enumerate(limits):
        n, k = min(int(n), size // int(lengths[i])), 1
        while n:
            take = min(k, n)
            bundles.append((i, take))
            n, k = n - take, 2 * k
    taken = np.zeros((len(bundles), size + 1), bool)
    for b, (i, k) in enumerate(bundles):
        width = int(lengths[i]) * k
        if width <= size:
            better = best[: size + 1 - width] + prices[i] * k
            taken[b, width:] = better > best[width:] + 1e-12
            best[width:] = np.where(taken[b, width:], better, best[width:])
    counts, room = np.zeros(len(lengths), np.int64), size
    for b in range(len(bundles) - 1, -1, -1):
        if taken[b, room]:
            i, k = bundles[b]
            counts[i] += k
            room -= int(lengths[i]) * k
    return counts, best[size]


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, size: int):
    """Patterns (columns) and their real-valued counts of the linear program's optimum.

    Revised simplex: the basis starts with one homogeneous pattern per length.
    """
    basis = np.diag((size // lengths).astype(float))
    # slightly unequal demands keep the pivots from going in circles
    demand = demand + 1e-7 * np.arange(1, len(demand) + 1)
    while True:
        inverse = np.linalg.inv(basis)
        pattern, worth = knapsack(lengths, np.maximum(inverse.sum(axis=0), 0.0), size)
        amounts = inverse @ demand
        if worth <= 1.0 + GAIN:
            return basis, amounts
        direction = inverse @ pattern
        ratio = np.full(len(lengths), np.inf)
        positive = direction > 1e-12
        ratio[positive] = np.maximum(amounts[positive], 0.0) / direction[positive]
        basis[:, int(np.argmin(ratio))] = pattern


def packing_plan(lengths: list[int], demand: list[int], size: int) -> list[tuple[list[int], int]]:
    """Patterns with whole counts that use every piece exactly once."""
    if not lengths:
        return []
    sizes, left = np.array(lengths, np.int64), np.array(demand, np.int64)
    basis, amounts = solve_patterns(sizes, left.astype(float), size)
    plan: list[tuple[list[int], int]] = []
    patterns = np.rint(basis).astype(np.int64)
    for j in np.argsort(-amounts):
        pattern = patterns[:, j]
        used = pattern > 0
        n = min(int(np.floor(amounts[j] + 1e-9)), int((left[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern.tolist(), n))
            left -= n * pattern
    while left.any():
        # prefer long pieces among equally full sequences: short ones fill gaps later
        pattern, _ = knapsack(sizes, sizes + sizes**2 / (4.0 * size * size), size, left)
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        plan.append((pattern.tolist(), n))
        left -= n * pattern
    return plan


def slots(lengths: list[int], plan: list[tuple[list[int], int]]) -> list[tuple]:
    """Where the ranks of each length lie.

    A row (length, from_rank, each, first_sequence, first_offset): ranks from `from_rank`
    on fill a pattern's instances with `each` pieces of that length side by side.
    """
    rows, first = [], 0
    ranks = dict.fromkeys(lengths, 0)
    for pattern, n in plan:
        offset = 0
        for length, each in zip(lengths, pattern):
            if each:
                rows.append((length, ranks[length], ranks[length] + n * each, each, first, offset))
                ranks[length] += n * each
                offset += each * length
        first += n
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """Pieces with `ids` (little-endian unsigned 32-bit) and their place: `sequence_id`, `offset`."""
    spark = docs.sparkSession

    def encode(texts: pa.Array) -> Ids:
        return encoder(tokenizer)(texts)

    found = materialise(cut_documents(docs, encode, end_id, size))
    # ranks: places within a task follow those of the tasks before it
    counts = materialise(found.groupBy("length", "task").agg(F.count("*").alias("held")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialise(
        counts.select(
            F.col("length").alias("_len"),
            F.col("task").alias("_task"),
            F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"),
        )
    )
    histogram = sorted(
        (r.length, r.held) for r in counts.groupBy("length").agg(F.sum("held").alias("held")).collect()
    )
    lengths = [n for n, _ in histogram]
    plan = packing_plan(lengths, [n for _, n in histogram], size)
    places = spark.createDataFrame(
        slots(lengths, plan),
        "_length long, from_rank long, to_rank long, each long, first_sequence long, first_offset long",
    )
    # a row per task and class, broadcast if measured small; a bounded table of patterns
    ranked = found.join(
        F.broadcast(ahead) if is_small(ahead) else ahead,
        (F.col("length") == F.col("_len")) & (F.col("task") == F.col("_task")),
    ).withColumn("rank", F.col("ahead") + F.col("place"))
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("_length"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank")),
    )
    return placed.selectExpr(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        "first_sequence + (rank - from_rank) div each AS sequence_id",
        "first_offset + ((rank - from_rank) % each) * length AS offset",
    )
