"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns every unit vector into a balanced code: the
centred sample is projected on its principal axes, then rotation and signs are fitted to
each other in turns (ITQ). Codes are cut into blocks; each choice of `chosen` blocks is a
table whose key are the bits of these blocks. Vectors that share a key in some table and
whose codes differ in few bits are compared by the cosine of the original vectors.

The tables are set by what they must find: every sampled vector is tilted at random to
exactly the linking cosine, and of the choices that would meet `TARGET` of these worst
pairs the one is taken whose keys are long enough for the rows of the largest label. If
none is, all vectors of a label share one key and the search is exhaustive.

Equal vectors of a label are one node with its number of copies. A pair of nodes counts in
the first table that it shares, so every task adds up links on its own; pairs are never
written, only counts per node and the edges of a spanning forest. Codes go to the tables
first; original vectors follow only for nodes that have a partner there. A key with more
than `CHUNK` nodes is dealt to pairs of chunks, so that no task holds more than two.

Only vectors with equal labels and lengths are compared. Rows with a null `vec_id` or
label, and vectors that are null, empty, zero or hold null or non-finite entries, link
with nothing and stay on their own (`kept` is true, also for a null id). Rows sharing a
`vec_id` are vectors of their own; -0.0 equals 0.0. An empty table gives an empty result.
Only `vec_id`, `embedding` and `label` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.components import components
from tallybook.llm.whitening import finite_blocks
from tallybook.operators.lookup import join_key_values
from tallybook.session import is_small, materialise

# Nodes per vector length that the rotation is learned from: the smallest hashes.
SAMPLE = 4096
BITS = 64
TURNS = 40
# Share of sampled pairs at exactly the linking cosine that the tables must meet.
TARGET = 0.999
# A key should be shared by about this many unrelated nodes at most, as a power of two.
SHARED_BITS = 6
MOST_BLOCKS = 16
# Nodes of one key that one side of a comparison holds.
CHUNK = 4096
# Groups up to this size are compared together, offset by offset.
SMALL = 64
# Rows compared at once within a large group, and rows gathered before groups are compared.
ROWS = 256
GATHER = 50_000
KEYS = ["dim", "label", "t", "key", "a", "b"]


class Code(NamedTuple):
    """How vectors of one length become codes, and the tables of these codes."""

    mean: np.ndarray
    axes: np.ndarray  # dim x bits
    masks: list[int]  # bits of each table's key
    reach: int  # bits in which codes of a pair may differ


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes whose signs quantise the centred sample with little error."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, : min(BITS, sample.shape[1])]
    shadow = centred @ axes
    made = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(made.standard_normal((axes.shape[1],) * 2))
    for _ in range(TURNS):
        signs = np.where(shadow @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(shadow.T @ signs)
        rotation = left @ right
    return mean, axes @ rotation


def bits_of(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (vectors - mean) @ axes >= 0


def codes_of(bits: np.ndarray) -> np.ndarray:
    values = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    return (bits * values).sum(axis=1, dtype=np.uint64)


def tilted(sample: np.ndarray, cosine: float, seed: int = 12) -> np.ndarray:
    """Each vector turned in a random direction until its cosine with itself is `cosine`."""
    if sample.shape[1] == 1:
        return sample
    made = np.random.default_rng(seed).standard_normal(sample.shape)
    made -= (made * sample).sum(axis=1, keepdims=True) * sample
    aside = made / np.maximum(np.sqrt((made * made).sum(axis=1, keepdims=True)), 1e-300)
    return cosine * sample + np.sqrt(1 - cosine * cosine) * aside


def table_masks(flips: np.ndarray, rows: int) -> list[int]:
    """Key bits of every table, for sampled `flips` of bits and the rows of a label.

    For each number of chosen blocks the fewest blocks that meet TARGET of the sample
    give the longest keys; the fewest chosen blocks with long enough keys are taken.
    """
    bits = flips.shape[1]
    need = np.log2(max(rows, 2)) - SHARED_BITS
    best, best_bits = [0], 0
    for chosen in range(1, MOST_BLOCKS):
        for n in range(chosen, min(MOST_BLOCKS, bits) + 1):
            blocks = np.array_split(np.arange(bits), n)
            clean = np.column_stack([~flips[:, b].any(axis=1) for b in blocks]).sum(axis=1)
            if (clean >= chosen).mean() < TARGET:
                continue
            length = sum(sorted(map(len, blocks))[:chosen])
            if length > best_bits:
                parts = [sum(1 << int(bit) for bit in b) for b in blocks]
                best, best_bits = [sum(some) for some in combinations(parts, chosen)], length
            break
        if best_bits >= need:
            break
    return best


def learn(sample: np.ndarray, cosine: float, rows: int) -> Code:
    mean, axes = learn_rotation(sample)
    flips = bits_of(sample, mean, axes) != bits_of(units(tilted(sample, cosine)), mean, axes)
    return Code(mean, axes, table_masks(flips, rows), int(flips.sum(axis=1).max()))


def described(rows: DataFrame) -> DataFrame:
    """`vec_id, label, vec`: the vector's bytes, null where it takes no part."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    single = kinds["embedding"] == "array<float>"
    width = "<f4" if single else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec: list[bytes | None] = [None] * batch.num_rows
            named = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid())
            named = named.to_numpy(zero_copy_only=False)
            for places, block in finite_blocks(batch.column(2)):
                some = np.flatnonzero(named[places] & block.any(axis=1))
                raw = (block[some] + 0.0).astype(width).tobytes()
                size = block.shape[1] * int(width[2])
                for i, place in enumerate(places[some].tolist()):
                    vec[place] = raw[i * size : (i + 1) * size]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vec, pa.binary())],
                names=["vec_id", "label", "vec"],
            )

    kept = rows.select("vec_id", "label", "embedding")
    made = kept.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")
    return made.withColumn("dim", (F.octet_length("vec") / int(width[2])).cast("int"))


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    width = "<f4" if len(rows[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(rows), width).reshape(-1, dim).astype(float)


def learned(nodes: DataFrame, cosine: float) -> dict[int, Code]:
    """The code of every vector length: models, whose size the rows do not change."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec"), "node"))
    sample = nodes.select("dim", "vec", place.alias("place")).where(F.col("place") <= SAMPLE)
    rows = nodes.groupBy("dim", "label").agg(F.count("*").alias("rows"))
    rows = rows.groupBy("dim").agg(F.max("rows").alias("rows"))

    def fit(some: pa.Table) -> pa.Table:
        dim = some.column("dim")[0].as_py()
        order = np.argsort(some.column("place").to_numpy())
        made = learn(units(vectors_of(some.column("vec"), dim))[order], cosine, some.column("rows")[0].as_py())
        parts = [made.mean.tobytes(), made.axes.tobytes(), np.array(made.masks, np.uint64).tobytes()]
        return pa.table(
            [pa.array([dim], pa.int32()), *(pa.array([p], pa.binary()) for p in parts), pa.array([made.reach])],
            names=["dim", "mean", "axes", "masks", "reach"],
        )

    schema = "dim int, mean binary, axes binary, masks binary, reach long"
    found = sample.join(rows, "dim").groupBy("dim").applyInArrow(fit, schema)
    return {
        row.dim: Code(
            np.frombuffer(row.mean),
            np.frombuffer(row.axes).reshape(row.dim, -1),
            np.frombuffer(row.masks, np.uint64).tolist(),
            row.reach,
        )
        for row in found.collect()
    }


def in_tables(nodes: DataFrame, made: dict[int, Code]) -> DataFrame:
    """`node, label, dim, code, t, key`: every node once in each table."""
    label = nodes.schema["label"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                code = made[dim]
                bits = bits_of(units(vectors_of(some.column("vec"), dim)), code.mean, code.axes)
                codes = codes_of(bits)
                masks = np.array(code.masks, np.uint64)
                each = pa.array(np.repeat(np.arange(len(codes)), len(masks)))
                keys = (codes[:, None] & masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("node").take(each),
                        some.column("label").take(each),
                        some.column("dim").take(each),
                        pa.array(codes.view(np.int64)).take(each),
                        pa.array(np.tile(np.arange(len(masks), dtype=np.int32), len(codes))),
                        pa.array(keys.view(np.int64)),
                    ],
                    names=["node", "label", "dim", "code", "t", "key"],
                )

    return nodes.select("node", "label", "dim", "vec").mapInArrow(
        deal, f"node long, label {label}, dim int, code long, t int, key long"
    )


def dealt(members: DataFrame) -> DataFrame:
    """`members` with `a`, `b`, the chunks a comparison is between, and `side`, their own."""
    keys = ["dim", "label", "t", "key"]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    chunks = F.ceil(F.col("n") / F.lit(float(CHUNK))).cast("int")
    sizes = materialise(sizes.select(*keys, chunks.alias("chunks")))
    side = F.broadcast(sizes) if is_small(sizes) else sizes
    marked = members.join(side, keys, "left").fillna(1, ["chunks"])
    marked = marked.withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return marked.select(
        "node", "code", "side", *keys, F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b")
    )


def near_pairs(codes, ends, free, side, t, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within groups whose codes differ in few bits, met in no earlier table.

    `ends` is where each row's group ends; rows of two chunks (`free` is false) pair only
    across them.
    """
    masks = np.array(code.masks, np.uint64)

    def fine(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = codes[i] ^ codes[j]
        keep = (np.bitwise_count(differ) <= code.reach) & (free[i] | (side[i] != side[j]))
        i, j, differ = i[keep], j[keep], differ[keep]
        if len(i):
            first = np.zeros(len(i), bool)
            for number in range(len(masks) - 1):
                first |= (t[i] > number) & ((differ & masks[number]) == 0)
            i, j = i[~first], j[~first]
        return i, j

    places = np.arange(len(codes))
    left = ends - places - 1
    starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else places
    sizes = ends[starts] - starts
    small = np.repeat(sizes <= SMALL, sizes)
    some = places[small]
    for offset in range(1, SMALL):
        some = some[left[some] >= offset]
        if not len(some):
            break
        yield fine(some, some + offset)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for first in range(start, start + size, ROWS):
            rows = np.arange(first, min(first + ROWS, start + size))
            columns = np.arange(first, start + size)
            near = np.bitwise_count(codes[rows][:, None] ^ codes[columns][None, :]) <= code.reach
            i, j = np.nonzero(np.triu(near, 1))
            yield fine(rows[i], columns[j])


def cosines(u: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; a dense block of pairs is multiplied at once."""
    if not len(i):
        return np.zeros(0)
    low, high, left, right = i.min(), i.max() + 1, j.min(), j.max() + 1
    if high - low <= ROWS and 20 * len(i) > (high - low) * (right - left):
        return (u[low:high] @ u[left:right].T)[i - low, j - left]
    step = 1 << 14
    parts = [np.einsum("ij,ij->i", u[i[n : n + step]], u[j[n : n + step]]) for n in range(0, len(i), step)]
    return np.concatenate(parts)


def joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of `parent` along pairs; roots are smallest places."""
    while len(i):
        for side in (i, j):
            while np.any(parent[side] != parent[parent[side]]):
                parent[side] = parent[parent[side]]
        i, j = parent[i], parent[j]
        differ = i != j
        low, high = np.minimum(i, j)[differ], np.maximum(i, j)[differ]
        np.minimum.at(parent, high, low)
        i, j = high, low


def by_group(
    work: Callable[[pa.Table, Code, np.ndarray, np.ndarray], pa.RecordBatch | None], made: dict[int, Code]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls `work` with rows of whole groups of one vector length, from rows sorted by KEYS."""

    def bounds(table: pa.Table, names: list[str]) -> np.ndarray:
        """Places where a new group begins."""
        differ = np.zeros(table.num_rows - 1, bool)
        for name in names:
            column = table.column(name).combine_chunks()
            differ |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(
                zero_copy_only=False
            )
        return np.concatenate([[0], np.flatnonzero(differ) + 1])

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = np.append(bounds(table, ["dim"]), table.num_rows)
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(start, stop - start)
            begins = bounds(part, KEYS)
            sizes = np.diff(np.append(begins, part.num_rows))
            ends = np.repeat(begins + sizes, sizes)
            if sizes.max() > 1:
                out = work(part, made[part.column("dim")[0].as_py()], begins, ends)
                if out is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= GATHER:
                table = pa.Table.from_batches(held)
                last = int(bounds(table, KEYS)[-1])
                if last:
                    yield from compared(table.slice(0, last))
                held, n = table.slice(last).combine_chunks().to_batches(), n - last
        if n:
            yield from compared(pa.Table.from_batches(held))

    return run


def columns_of(part: pa.Table) -> tuple[np.ndarray, ...]:
    a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
    codes = part.column("code").to_numpy().view(np.uint64)
    return codes, a == b, part.column("side").to_numpy(), part.column("t").to_numpy()


def partnered(part: pa.Table, code: Code, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
    """The rows whose code is near another one of their group."""
    codes, free, side, t = columns_of(part)
    met = np.zeros(len(codes), bool)
    for i, j in near_pairs(codes, ends, free, side, t, code):
        met[i] = met[j] = True
    if not met.any():
        return None
    return part.filter(pa.array(met)).combine_chunks().to_batches()[0]


def linking(cosine: float) -> Callable:
    def links(part: pa.Table, code: Code, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """Per row the copies it links with here, and a node its component reaches here."""
        codes, free, side, t = columns_of(part)
        u = units(vectors_of(part.column("vec"), part.column("dim")[0].as_py()))
        copies = part.column("copies").to_numpy()
        total = np.zeros(len(codes), np.int64)
        parent = np.arange(len(codes))
        for i, j in near_pairs(codes, ends, free, side, t, code):
            same = cosines(u, i, j) >= cosine
            i, j = i[same], j[same]
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
            joined(parent, i, j)
        while np.any(parent != parent[parent]):
            parent = parent[parent]
        some = np.flatnonzero(total > 0)
        if not len(some):
            return None
        nodes = part.column("node").to_numpy()
        roots = nodes[parent[some]]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[some]), pa.array(roots), pa.array(total[some])], names=["node", "root", "links"]
        )

    return links


def near_vectors(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row `vec_id, n_links, component_id, kept`: links to other rows of its label with
    at least this cosine, and the smallest `vec_id` that links reach."""
    all_rows = described(rows).withColumn("digest", F.sha2("vec", 256))
    nodes = (
        all_rows.where("vec IS NOT NULL")
        .groupBy("label", "dim", "vec")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    made = learned(nodes, cosine)

    members = dealt(in_tables(nodes, made)).select("node", "code", "side", *KEYS)
    order = [*KEYS, "side", "node"]
    met = members.repartition(*KEYS).sortWithinPartitions(*order)
    asked = materialise(met.mapInArrow(by_group(partnered, made), members.schema))

    side = F.broadcast(asked) if is_small(asked) else asked
    held = nodes.select("node", "vec", "copies").join(side, "node")
    held = held.repartition(*KEYS).sortWithinPartitions(*order)
    found = materialise(
        held.mapInArrow(by_group(linking(cosine), made), "node long, root long, links long")
    )

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = materialise(components(found.selectExpr("node AS a", "root AS b")))
    reach = parts.join(nodes.select("node", "first_id"), "node")
    least = reach.groupBy("component").agg(F.min("first_id").alias("least"), F.count("*").alias("size"))
    placed = join_key_values(parts, materialise(least), ["component"], "size").select("node", "least")
    values = (
        nodes.join(links, "node", "left")
        .join(placed, "node", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .select(
            "label",
            F.sha2("vec", 256).alias("digest"),
            "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", "first_id").alias("component_id"),
        )
    )
    out = join_key_values(
        all_rows.select("vec_id", "label", "digest"), materialise(values), ["label", "digest"], "copies"
    )
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
