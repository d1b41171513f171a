"""Whitening of vectors on their leading principal components, found by spectrum slicing.

Entries become longs x = floor(scale * c). The fit list holds each distinct x once: n
vectors with exact sums S per dimension. Its covariance (divisor n) is summed from the
centred entries; inertia counts, Rayleigh quotients and certifying counts (`spectrum`)
give its leading eigenpairs. Each row is centred, projected and divided by the square
root of the eigenvalue.

Every step works in blocks where the rows lie: only distinct vectors, in the fewest bytes
that hold them, are shuffled, and per task the sums and cells of one matrix. The driver
holds, per vector length, n, S, and the components.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped; all
others, repeated rows and null keys included, get one row per component. Vectors of
different lengths are fitted apart. x beyond the range of a long stops at its end; a
deviation beyond it is null. An eigenvalue not above 1e-12 of the trace is rounding: its
component is left out, so equal vectors, or a single one, give no rows. Components of a
multiple eigenvalue are some orthonormal basis. An empty table gives an empty result.
Only `vec_id` and `embedding` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.spectrum import leading
from tallybook.session import materialise

# Entries worked on at once.
BLOCK_ENTRIES = 1 << 20
LONG = 2**63


class Fit(NamedTuple):
    """What the rows of one vector length need: count, exact sums, eigenpairs."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # one component a row


def finite_blocks(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of doubles of the usable rows, one length at a time."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(pc.list_flatten(vectors), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, BLOCK_ENTRIES // length)
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            block = flat[(ends[some] - length)[:, None] + np.arange(length)]
            fine = np.isfinite(block).all(axis=1)
            if fine.any():
                yield some[fine], block[fine]


def whole(block: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as longs, ending at the ends of their range."""
    with np.errstate(over="ignore"):
        floors = np.floor(scale * block)
    high = floors >= LONG
    out = np.where(high, 0.0, np.maximum(floors, -float(LONG))).astype(np.int64)
    out[high] = LONG - 1
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as its width in bytes and its entries in that width; equal rows are equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for width in (1, 2, 4, 8):
        kind = np.iinfo(f"<i{width}")
        some = np.flatnonzero(left & (low >= kind.min) & (high <= kind.max))
        left[some] = False
        raw = x[some].astype(f"<i{width}").tobytes()
        size = width * x.shape[1]
        mark = bytes([width])
        for place, row in enumerate(some.tolist()):
            out[row] = mark + raw[place * size : (place + 1) * size]
    return out


def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of longs from packed rows, one length and width at a time."""
    rows = column.to_pylist()
    shapes: dict[tuple[int, int], list[bytes]] = {}
    for row in rows:
        shapes.setdefault((row[0], len(row)), []).append(row)
    for (width, size), some in sorted(shapes.items()):
        step = max(1, BLOCK_ENTRIES * width // size)
        for first in range(0, len(some), step):
            raw = np.frombuffer(b"".join(some[first : first + step]), np.uint8).reshape(-1, size)
            yield np.ascontiguousarray(raw[:, 1:]).view(f"<i{width}").astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles, the whole part taken off exactly."""
    floors = [s // n for s in sums]
    rest = np.array([(s % n) / n for s in sums])
    base = np.array(floors, np.int64)
    if np.abs(x.astype(float)).max() + np.abs(base.astype(float)).max() < 2.0**62:
        return (x - base) - rest
    return (x.astype(object) - np.array(floors, object)).astype(float) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exact; null beyond the range of a long."""
    reach = float(n) * np.abs(x.astype(float)).max() + max(abs(s) for s in sums)
    if reach < 2.0**62 and 1.01 * x.shape[1] * reach * reach < LONG:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(t) if t < LONG else None for t in (d * d).sum(axis=1)]


def fit_list(rows: DataFrame, scale: float) -> DataFrame:
    """Each distinct x once, packed, in a table of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in finite_blocks(batch.column(0)):
                rows = pa.array(packed(whole(block, scale)), pa.binary())
                yield pa.RecordBatch.from_arrays([rows], names=["x"])

    return materialise(rows.select("embedding").mapInArrow(pack, "x binary").distinct())


def sums_of(listed: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per vector length n and the exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for x in unpacked(batch.column(0)):
                total = held.setdefault(x.shape[1], [0, 0, 0])
                total[0] += len(x)
                # two halves, so that no sum of a task leaves 64 bits
                total[1] = total[1] + (x >> 32).sum(axis=0)
                total[2] = total[2] + (x & 0xFFFFFFFF).sum(axis=0)
        for dim, (n, high, low) in held.items():
            columns = [np.full(dim, dim), np.arange(dim), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["dim", "place", "n", "high", "low"]
            )

    parts = listed.mapInArrow(add, "dim long, place long, n long, high long, low long")
    total = parts.groupBy("dim", "place").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")),
    )
    out: dict[int, tuple[int, list[int]]] = {}
    for row in total.orderBy("dim", "place").collect():
        sums = out.setdefault(row.dim, (row.n, []))[1]
        sums.append((int(row.high) << 32) + int(row.low))
    return out


def products(listed: DataFrame, project) -> DataFrame:
    """`dim, i, j, total` (i <= j): sums of products of what `project` makes of each block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in unpacked(batch.column(0)):
                made = project(x)
                if made is not None:
                    held[x.shape[1]] = held.get(x.shape[1], 0.0) + made.T @ made
        for dim, cells in held.items():
            i, j = np.triu_indices(len(cells))
            columns = [pa.array(np.full(len(i), dim)), pa.array(i), pa.array(j), pa.array(cells[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "j", "total"])

    parts = listed.mapInArrow(add, "dim long, i long, j long, total double")
    return parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))


def components_of(covariance: DataFrame, count: int) -> DataFrame:
    """`dim, component, value, trace, vector` from the cells of each length's covariance."""

    def solve(cells: pa.Table) -> pa.Table:
        i, j = cells.column("i").to_numpy(), cells.column("j").to_numpy()
        matrix = np.zeros((int(j.max()) + 1,) * 2)
        matrix[i, j] = matrix[j, i] = cells.column("total").to_numpy()
        pairs = leading(matrix, count)
        dim = cells.column("dim")[0].as_py()
        return pa.table(
            {
                "dim": pa.array([dim] * len(pairs), pa.int64()),
                "component": pa.array(range(1, len(pairs) + 1), pa.int32()),
                "value": pa.array([v for v, _ in pairs], pa.float64()),
                "trace": pa.array([float(np.trace(matrix))] * len(pairs), pa.float64()),
                "vector": pa.array([v.tolist() for _, v in pairs], pa.list_(pa.float64())),
            }
        )

    schema = "dim long, component int, value double, trace double, vector array<double>"
    return covariance.groupBy("dim").applyInArrow(solve, schema)


def fit(listed: DataFrame, count: int) -> dict[int, Fit]:
    """The fit of every vector length that has components."""
    sums = sums_of(listed)
    cells = products(listed, lambda x: centred(x, *sums[x.shape[1]]))
    counts = F.create_map(*(F.lit(v) for dim, (n, _) in sums.items() for v in (dim, n)))
    covariance = cells.withColumn("total", F.col("total") / counts[F.col("dim")]) if sums else cells
    found: dict[int, list] = {}
    for row in components_of(covariance, count).orderBy("dim", "component").collect():
        found.setdefault(row.dim, []).append(row)
    return {
        dim: Fit(
            *sums[dim],
            rows[0].trace,
            np.array([r.value for r in rows]),
            np.array([r.vector for r in rows]),
        )
        for dim, rows in found.items()
    }


def whitened(x: np.ndarray, made: Fit) -> np.ndarray:
    return (centred(x, made.n, made.sums) @ made.vectors.T) / np.sqrt(made.values)


def identity_errors(listed: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length the largest entry of |covariance of the whitened fit list - identity|."""

    def project(x: np.ndarray) -> np.ndarray | None:
        made = fits.get(x.shape[1])
        if made is None:
            return None
        # a column of ones sums the components: their mean is taken off the products
        return np.column_stack([whitened(x, made), np.ones(len(x))])

    cells: dict[int, np.ndarray] = {}
    for row in products(listed, project).collect():
        size = len(fits[row.dim].values) + 1
        cells.setdefault(row.dim, np.zeros((size, size)))[row.i, row.j] = row.total
    errors = {}
    for dim, total in cells.items():
        scaled = total / fits[dim].n
        mean = scaled[:-1, -1]
        upper = np.triu(scaled[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean)))
        errors[dim] = float(np.abs(upper).max())
    return errors


def whiten(rows: DataFrame, count: int = 4, scale: float = 256.0) -> DataFrame:
    """Per usable row and component `vec_id, component, n, deviation, whitened, explained,
    identity_error`; `vec_id` keeps its type."""
    own = rows.select("vec_id", "embedding")
    listed = fit_list(own, scale)
    fits = fit(listed, count)
    errors = identity_errors(listed, fits)
    kind = own.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, block in finite_blocks(batch.column(1)):
                made = fits.get(block.shape[1])
                if made is None:
                    continue
                x = whole(block, scale)
                size = len(made.values)
                each = np.repeat(places, size)
                deviation = pa.array(deviations(x, made.n, made.sums), pa.int64())
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), made.n)),
                    deviation.take(pa.array(np.repeat(np.arange(len(x)), size))),
                    pa.array(whitened(x, made).ravel()),
                    pa.array(np.tile(made.values / made.trace, len(x))),
                    pa.array(np.full(len(each), errors[block.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns,
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(score, schema)
