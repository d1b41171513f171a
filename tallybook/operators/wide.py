"""Least squares for wide designs, without anything as long as the design on the driver.

The Gram matrix of a design with thousands of levels is never made. The category with the
most levels is eliminated: given all other coefficients, a level's own effect is the mean of
what its rows leave over, so the task that has the rows of a level takes that mean itself.
What is left is solved by conjugate gradients; a step is one pass over the rows, and only
vectors as long as the other categories have levels come back. All seeds and models step
together. Effects of the eliminated levels are written as a table by one last pass.

Rows are dealt by their level of the eliminated category, once, and packed into blocks of
cells (rows already summed by categories and test mask) that hold whole levels. A level with
too many rows for one task is not eliminated but has a coefficient like those of the other
categories; there are at most `HOT_LEVELS` of them. Columns are scaled by their own sums of
squares. On aliased columns the solution has the least norm in that scale of all that leave
the eliminated levels free, with the same fitted values as any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallybook.session import discard, is_small, materialise

# Size of the residual, as a share of the first one, at which a system is solved.
TOLERANCE = 1e-10
# As a share of the sums it is the difference of, a residual below this is rounding.
ROUNDING = 1e-13
# Cells of a block: what a task works on at once.
BLOCK_CELLS = 32_768
# Rows that are packed together by one task.
TASK_ROWS = 250_000
# Levels of the eliminated category that keep a coefficient of their own, at most.
HOT_LEVELS = 1_000
# Items that the search for them follows; the more, the closer its counts.
FOLLOWED = 20_000
# Levels whose sums travel as one value.
CHUNK = 4_096

BLOCK = "levels array<string>, starts binary, key binary, n binary, y binary, places binary, z binary"


class System(NamedTuple):
    """One seed's design of one model: numeric features, and categories with their reference."""

    seed: int
    numeric: list[int]
    references: dict[int, str]
    turn: np.ndarray
    base: np.ndarray
    sums: Any

    def squares(self) -> np.ndarray:
        """Sums of squares of constant and features; a constant feature is 0 and counts as 1."""
        turn, base = self.turn[self.numeric], self.base[self.numeric]
        s = self.sums
        whole = np.array([s.n, *(t @ s.zz @ t + 2 * b * (t @ s.z) + s.n * b * b for t, b in zip(turn, base))])
        return np.where(whole > 1e-9 * s.n, whole, np.maximum(whole, 1.0))

    def slopes(self, head: np.ndarray) -> np.ndarray:
        """The slopes of constant and standardised features as those of the features z."""
        return self.turn[self.numeric].T @ head[1:]

    def columns(self, constant: float, z: np.ndarray) -> np.ndarray:
        """What sums of one and of the features z come to for constant and standardised features."""
        features = self.turn[self.numeric] @ z + self.base[self.numeric] * constant if self.numeric else []
        return np.concatenate([[constant], features])


class Solution(NamedTuple):
    """Of every system intercept and slopes; per category the contrasts of its levels.

    A table has `level, n, coefs`: one row per level, its rows in all, and a contrast for each
    system in order, NULL for references and levels that the system has no training rows of.
    """

    heads: list[np.ndarray]
    contrasts: dict[int, DataFrame]


class _Places(NamedTuple):
    """Where levels with a coefficient of their own stand in the vectors.

    Categories with their levels; the eliminated one comes last, if it has hot levels.
    """

    levels: list[tuple[int, list[str]]]

    @property
    def length(self) -> int:
        return sum(len(known) for _, known in self.levels)

    def spans(self) -> Iterator[tuple[int, list[str], slice]]:
        begin = 0
        for c, known in self.levels:
            yield c, known, slice(begin, begin + len(known))
            begin += len(known)


class _Blocks(NamedTuple):
    """The rows in blocks of cells, and how they are to be read."""

    table: DataFrame
    places: _Places
    n_z: int
    widest: int | None
    bits: list[int] | None


def solve(
    rows: DataFrame, systems: list[System], n_z: int, sizes: list[int], names: list[str], bits: list[int] | None
) -> Solution:
    """Coefficients of every system over `rows`: `_key`, `y`, features z0.. and categories c0..

    A row's key is a test mask, whose bits stand for the seeds in `bits`, or the seed itself.
    `sizes` says about how many levels each category has, `names` what it is called.
    """
    blocks = _packed(rows, n_z, sizes, bits)
    widest, n_places = blocks.widest, blocks.places.length
    # only systems with the eliminated category have its levels to take means by
    free = np.array([widest in s.references for s in systems])
    left, sums = _pass(blocks, systems, free, None)
    rest, counts, n_rows = np.split(sums, [len(systems), 2 * len(systems)], axis=1)
    allowed = _allowed(systems, blocks, counts, names)
    # the vectors of a system: constant and features, then levels; 0 where it has no column
    scales = [1 / np.sqrt(np.concatenate([s.squares(), np.maximum(n, 1.0)])) for s, n in zip(systems, counts.T)]
    for scale, is_free, has in zip(scales, free, allowed.T):
        # the eliminated levels take the constant in
        scale[0] *= not is_free
        scale[len(scale) - n_places :] *= has
    raw = [s.columns(s.sums.y, s.sums.zy) / np.sqrt(s.squares()) for s in systems]
    sides = [s.columns(v[0], v[1:] + s.sums.zy) for s, v in zip(systems, left.T)]
    residual = [scale * np.concatenate([a, b]) for scale, a, b in zip(scales, sides, rest.T)]
    del sums, rest, counts
    x = [np.zeros(len(r)) for r in residual]
    step = [r.copy() for r in residual]
    size = [float(r @ r) for r in residual]
    goal = [max(TOLERANCE**2 * v, ROUNDING**2 * float(r @ r)) for v, r in zip(size, raw)]
    limit = 10 * max(int(np.count_nonzero(scale)) for scale in scales) + 100
    for _ in range(limit):
        waiting = [i for i in range(len(systems)) if size[i] > goal[i]]
        if not waiting:
            break
        chosen = [systems[i] for i in waiting]
        heads, levels = _split([scales[i] * step[i] for i in waiting], n_places)
        total, sums = _pass(blocks, chosen, free[waiting], (heads, levels))
        for i, s, head, whole, of_levels in zip(waiting, chosen, heads, total.T, sums.T):
            fitted = whole[1:] + s.sums.zz @ s.slopes(head)
            product = scales[i] * np.concatenate([s.columns(whole[0], fitted), of_levels])
            curve = float(step[i] @ product)
            if curve <= 0:
                # only rounding is left
                size[i] = 0.0
                continue
            alpha = size[i] / curve
            x[i] += alpha * step[i]
            residual[i] -= alpha * product
            new = float(residual[i] @ residual[i])
            step[i] *= new / size[i]
            step[i] += residual[i]
            size[i] = new
    else:
        raise ArithmeticError("the wide design did not converge")
    del residual, step
    heads, levels = _split([scale * v for scale, v in zip(scales, x)], n_places)
    contrasts = {}
    for c, known, span in blocks.places.spans():
        if c != widest:
            values = np.where(allowed[span], levels[span], np.nan)
            contrasts[c] = _table(blocks.table, known, n_rows[span, 0], values)
    if widest is not None:
        contrasts[widest] = _effects(blocks, systems, free, heads, levels, allowed, n_rows, names)
    # read no more: contrasts are tables of their own
    contrasts = {c: materialise(table) for c, table in contrasts.items()}
    discard(blocks.table)
    return Solution(heads, contrasts)


def _split(vectors: list[np.ndarray], n_places: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Constant and slopes of each vector, and a row per level with a value for each vector."""
    ends = [len(v) - n_places for v in vectors]
    return [v[:end].copy() for v, end in zip(vectors, ends)], np.column_stack([v[end:] for v, end in zip(vectors, ends)])


def _allowed(systems: list[System], blocks: _Blocks, counts: np.ndarray, names: list[str]) -> np.ndarray:
    """Which levels have a column in which system: those of its training rows but the references."""
    allowed = counts > 0
    for c, known, span in blocks.places.spans():
        for j, s in enumerate(systems):
            if c not in s.references:
                allowed[span, j] = False
            elif c != blocks.widest:
                reference = s.references[c]
                at = span.start + known.index(reference) if reference in known else None
                if at is None or not allowed[at, j]:
                    raise LookupError(_absent(reference, names[c]))
                allowed[at, j] = False
    return allowed


def _absent(reference: str, name: str) -> str:
    return f"reference level {reference!r} of {name} not among training rows"


def _packed(rows: DataFrame, n_z: int, sizes: list[int], bits: list[int] | None) -> _Blocks:
    """Deal the rows by their level of the widest category and sum them per cell."""
    spark = rows.sparkSession
    widest = int(np.argmax(sizes)) if sizes else None
    level = F.lit(None).cast("string") if widest is None else F.col(f"c{widest}")
    facts = rows.select(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(level, {HOT_LEVELS}, {FOLLOWED})").alias("top")
    )
    found = facts.first()
    known = []
    for c in range(len(sizes)):
        if c != widest:
            levels = rows.select(f"c{c}").distinct().dropna().toArrow().column(0).to_pylist()
            known.append((c, sorted(levels)))
    least = max(found.n / HOT_LEVELS, BLOCK_CELLS)
    hot = sorted(t["item"] for t in found.top or [] if t["item"] is not None and t["count"] > least)
    if hot:
        known.append((widest, hot))
    places = _Places(known)
    for i, (c, levels, span) in enumerate(places.spans()):
        at = pa.array(range(span.start, span.stop), pa.int32())
        table = spark.createDataFrame(pa.table({f"c{c}": pa.array(levels, pa.string()), f"i{i}": at}))
        rows = rows.join(F.broadcast(table) if is_small(table) else table, f"c{c}", "left")
    is_hot = F.col(f"i{len(known) - 1}").isNotNull() if hot else F.lit(widest is None)
    z, index = [f"z{i}" for i in range(n_z)], [f"i{i}" for i in range(len(known))]
    cells = rows.select(
        F.col("_key").cast("int").alias("key"),
        "y",
        *z,
        *(F.coalesce(i, F.lit(places.length)).alias(i) for i in index),
        level.alias("level"),
        is_hot.alias("hot"),
    )
    # the rows of a hot level may go anywhere
    anywhere = F.xxhash64("key", "y", *z, *index)
    deal = F.when(F.col("hot"), anywhere).otherwise(F.xxhash64("level"))
    few = min(spark.sparkContext.defaultParallelism, math.ceil(found.n / 10_000))
    n_tasks = max(1, few, math.ceil(found.n / TASK_ROWS))
    dealt = cells.withColumn("_deal", deal).repartition(n_tasks, "_deal").drop("_deal")
    return _Blocks(materialise(dealt.mapInArrow(_packer(n_z, index), BLOCK)), places, n_z, widest, bits)


def _packer(n_z: int, index: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums the rows of a task per cell and cuts them into blocks, eliminated levels whole."""
    most, schema = BLOCK_CELLS, pa.schema(
        [("levels", pa.list_(pa.string())), *((c, pa.binary()) for c in ("starts", "key", "n", "y", "places", "z"))]
    )
    numbers = ["y", *(f"z{i}" for i in range(n_z))]

    def blocks(level, keys, values, n):
        """Blocks of rows in order of `level` (-1: none is eliminated) and then of the other keys."""
        order = np.lexsort([*keys[::-1], level])
        level, keys = level[order], [k[order] for k in keys]
        new = np.ones(len(level), bool)
        new[1:] = np.any([a[1:] != a[:-1] for a in [level, *keys]], axis=0)
        cells = np.flatnonzero(new)
        level, keys = level[cells], [k[cells] for k in keys]
        values = [np.add.reduceat(v[order], cells) for v in [*values, n]]
        starts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
        if level[0] < 0:
            starts = np.arange(0, len(level), most)
        begin = 0
        while begin < len(level):
            # the first start of a level at or past the size of a block
            past = np.searchsorted(starts, begin + most)
            end = int(starts[past]) if past < len(starts) else len(level)
            inside = starts[(starts >= begin) & (starts < end)]
            cut = slice(begin, end)
            yield level[inside], inside - begin, [k[cut] for k in keys], [v[cut] for v in values]
            begin = end

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [batch for batch in batches if batch.num_rows]
        if not some:
            return
        whole = pa.Table.from_batches(some)
        levels = whole.column("level").combine_chunks().dictionary_encode(null_encoding="encode")
        named, codes = levels.dictionary.to_pylist(), levels.indices.to_numpy(zero_copy_only=False)
        hot = whole.column("hot").to_numpy()
        keys = [whole.column(c).to_numpy().astype(np.int32) for c in ["key", *index]]
        values = [whole.column(c).to_numpy() for c in numbers]
        for some, eliminated in ((np.flatnonzero(~hot), True), (np.flatnonzero(hot), False)):
            if not len(some):
                continue
            code = codes[some].astype(np.int64) if eliminated else np.full(len(some), -1)
            for of, starts, own, sums in blocks(
                code, [k[some] for k in keys], [v[some] for v in values], np.ones(len(some))
            ):
                row = {
                    "levels": [named[i] for i in of] if eliminated else [],
                    "starts": (starts if eliminated else starts[:0]).astype(np.int64).tobytes(),
                    "key": own[0].tobytes(),
                    "n": sums[-1].tobytes(),
                    "y": sums[0].tobytes(),
                    "places": np.array(own[1:], dtype=np.int32).tobytes(),
                    "z": np.array(sums[1:-1]).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return pack


def _reader(blocks: _Blocks, systems: list[System]) -> Callable[[Row, tuple], tuple]:
    """How tasks read a block: its cells, and the sums of the target or of what `state` fits to them."""
    k, n_z, n_index = len(systems), blocks.n_z, len(blocks.places.levels)
    seeds = np.array([s.seed for s in systems])
    sides = None
    if blocks.bits is not None:
        at = np.array([blocks.bits.index(s.seed) for s in systems])
        sides = ((np.arange(1 << len(blocks.bits))[:, None] >> at) & 1 == 0).astype(float)

    def read(row: Row, state: tuple) -> tuple:
        key, n = np.frombuffer(row.key, np.int32), np.frombuffer(row.n)[:, None]
        inside = (key[:, None] == seeds).astype(float) if sides is None else sides[key]
        index = np.frombuffer(row.places, np.int32).reshape(n_index, len(n))
        z = np.frombuffer(row.z).reshape(n_z, len(n))
        y = np.frombuffer(row.y)[:, None] * inside
        shift, own = np.zeros((len(n), k)), y
        if state:
            constant, slopes, values = state
            shift += constant
            for at in index:
                shift += values[at]
            own = (n * shift + z.T @ slopes) * inside
        return np.frombuffer(row.starts, np.int64), n, inside, index, z, y, shift, own

    return read


def _state(systems: list[System], heads: list[np.ndarray], levels: np.ndarray) -> tuple:
    """A vector of each system in terms of the features z; the last row is that of no level."""
    constant = np.array([h[0] + s.base[s.numeric] @ h[1:] for s, h in zip(systems, heads)])
    slopes = np.column_stack([s.slopes(h) for s, h in zip(systems, heads)])
    return constant, slopes, np.concatenate([levels, np.zeros((1, len(systems)))])


def _pass(
    blocks: _Blocks, systems: list[System], free: np.ndarray, vectors: tuple[list[np.ndarray], np.ndarray] | None
) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of what is left of a vector's fit once each eliminated level took its mean.

    By constant and features (without products of features), and by level. Without vectors
    it is the target that is summed; levels then also have their training rows of each system
    and all their rows.
    """
    k, n_z, n_places, chunk = len(systems), blocks.n_z, blocks.places.length, CHUNK
    width = k if vectors else 2 * k + 1
    read, context = _reader(blocks, systems), blocks.table.sparkSession.sparkContext
    sent = context.broadcast(_state(systems, *vectors) if vectors else ())

    def add(rows: Iterable[Row]) -> Iterator[tuple[int, np.ndarray]]:
        total, by_level, any_rows = np.zeros((1 + n_z, k)), np.zeros((n_places + 1, width)), False
        for row in rows:
            any_rows = True
            starts, n, inside, index, z, _, shift, own = read(row, sent.value)
            shift = shift * inside
            if len(starts):
                of_level = np.add.reduceat(n * inside, starts)
                mean = np.add.reduceat(own, starts) / np.maximum(of_level, 1.0) * free
                taken = np.repeat(mean, np.diff(np.r_[starts, len(n)]), axis=0) * inside
                own = own - n * taken
                shift -= taken
            total[0] += own.sum(axis=0)
            total[1:] += z @ shift
            if not sent.value:
                own = np.concatenate([own, n * inside, n], axis=1)
            for at in index:
                known = None
                if len(by_level) > 8 * len(at):
                    known, at = np.unique(at, return_inverse=True)
                for j in range(width):
                    if known is None:
                        by_level[:, j] += np.bincount(at, own[:, j], len(by_level))
                    else:
                        by_level[known, j] += np.bincount(at, own[:, j])
        if any_rows:
            yield -1, total
            for begin in range(0, n_places, chunk):
                yield begin, by_level[begin : min(begin + chunk, n_places)]

    read_columns = [c for c in blocks.table.columns if c != "levels"]
    summed = blocks.table.select(*read_columns).rdd.mapPartitions(add).reduceByKey(lambda a, b: a + b)
    total, by_level = np.zeros((1 + n_z, k)), np.zeros((n_places, width))
    for begin, values in summed.collect():
        if begin < 0:
            total = values
        else:
            by_level[begin : begin + len(values)] = values
    sent.destroy()
    return total, by_level


def _effects(
    blocks: _Blocks, systems: list[System], free: np.ndarray, heads: list[np.ndarray], levels: np.ndarray,
    allowed: np.ndarray, n_rows: np.ndarray, names: list[str],
) -> DataFrame:
    """Contrasts of the eliminated category; its reference's effect goes to the constants in `heads`."""
    spark, k = blocks.table.sparkSession, len(systems)
    references = [s.references.get(blocks.widest) for s in systems]
    read = _reader(blocks, systems)
    sent = spark.sparkContext.broadcast(_state(systems, heads, levels))

    def effects(rows: Iterable[Row]) -> Iterator[tuple[str | None, int, np.ndarray]]:
        for row in rows:
            starts, n, inside, _, _, y, _, own = read(row, sent.value)
            if len(starts):
                of_level = np.add.reduceat(n * inside, starts)
                mean = np.add.reduceat(y - own, starts) / np.maximum(of_level, 1.0)
                mean[(of_level == 0) | ~free] = np.nan
                yield from zip(row.levels, np.add.reduceat(n[:, 0], starts).astype(int).tolist(), mean)

    known, span = next(((l, at) for c, l, at in blocks.places.spans() if c == blocks.widest), ([], slice(0, 0)))
    hot = np.where(allowed[span], levels[span], np.nan)
    wanted = sorted({r for r in references if r is not None})
    has = F.arrays_overlap("levels", F.array(*(F.lit(r) for r in wanted))) if wanted else F.lit(False)
    of_references = dict(zip(known, hot))
    near = blocks.table.where(has).rdd.mapPartitions(effects).filter(lambda found: found[0] in wanted)
    of_references.update((level, mean) for level, _, mean in near.collect())
    offset = np.zeros(k)
    for j, reference in enumerate(references):
        if reference is not None:
            offset[j] = of_references.get(reference, np.full(k, np.nan))[j]
            if np.isnan(offset[j]):
                raise LookupError(_absent(reference, names[blocks.widest]))
            heads[j][0] += offset[j]

    def contrasts(level: str | None, n: int, effect: np.ndarray) -> tuple[str | None, int, list[float | None]]:
        values = (effect - offset).tolist()
        return level, n, [None if v != v or r == level else v for v, r in zip(values, references)]

    table = blocks.table.rdd.mapPartitions(effects).map(lambda found: contrasts(*found))
    own = [contrasts(level, int(n), effect) for level, n, effect in zip(known, n_rows[span, 0], hot)]
    schema = "level string, n bigint, coefs array<double>"
    whole = spark.createDataFrame(table, schema, verifySchema=False)
    return whole.unionByName(spark.createDataFrame(own, schema)) if own else whole


def _table(like: DataFrame, levels: list[str], n: np.ndarray, values: np.ndarray) -> DataFrame:
    """Levels with their rows and a value per system, NaN as NULL."""
    flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
    offsets = pa.array(np.arange(0, values.size + 1, max(values.shape[1], 1)), pa.int32())
    columns = [pa.array(levels, pa.string()), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, flat)]
    return like.sparkSession.createDataFrame(pa.table(columns, names=["level", "n", "coefs"]))
