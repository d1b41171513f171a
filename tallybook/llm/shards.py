"""Token ids in binary shards with a minimal perfect hash index over document keys.

A store is a folder of three kinds of files, written by the tasks that made them:

* `ids-*.bin`: ids of consecutive documents end to end, then the documents' offsets.
  Header (little-endian): magic `TKS1`, bytes per id (uint32), documents (uint64),
  ids (uint64). Then all ids, then documents + 1 offsets (uint64, counted in ids).
* `index-*.bin`: a minimal perfect hash of the keys of one hash range. Header: magic
  `TKX1`, levels (uint32), keys (uint64); per level its number of bits (uint64) and
  the bits; then per slot a record: fingerprint, first and last shard of the key
  (uint32), ordinal of its first document in the first shard, its documents (uint64).
* `manifest` (Parquet): a row per shard with its file and the totals before it.

Documents lie in ascending order of `doc_id` (null first), repeated keys side by side
and in order of their texts' hash. A key is looked up in constant time: hash range,
slot, fingerprint, offsets. Null keys are stored first, and found without the index.
A null or empty text holds the end id alone. An empty table makes a
store without shards. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm.encode import encoder
from tallybook.llm.text import mix, pieces
from tallybook.session import materialise

SHARD_HEAD = "<4sIQQ"
INDEX_HEAD = "<4sIQ"
RECORD = np.dtype(
    [("print", "<u4"), ("shard", "<u4"), ("last", "<u4"), ("ordinal", "<u8"), ("copies", "<u8")]
)
PLACE = ("doc_id", "shard", "last", "ordinal", "copies")
PLACES = ", ".join(f"{name} long" for name in PLACE)
# Bits of a level per key it still has to place.
LOAD = 2
# Keys of one index file, about.
INDEX_KEYS = 100_000


class Store(NamedTuple):
    """Where a store lies, how many index files it has, its tables, the place of null keys."""

    folder: str
    ranges: int
    manifest: DataFrame
    indexes: DataFrame
    nulls: DataFrame


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def written(uri: str, parts: list[bytes]) -> None:
    """A file that appears under its name only when it is complete."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.part") as out:
        for part in parts:
            out.write(part)
    system.move(f"{path}.part", path)


def key_hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed: distinct keys never share a hash."""
    return mix(mix(keys.astype(np.int64).view(np.uint64)) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (key_hash(keys, 1_000_003) % np.uint64(ranges)).astype(np.int64)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits: a key belongs to the first level where no other key has its bit."""
    levels = []
    while len(keys):
        width = max(LOAD * len(keys), 8)
        place = (key_hash(keys, len(levels)) % np.uint64(width)).astype(np.int64)
        alone = np.bincount(place, minlength=width) == 1
        levels.append(alone)
        keys = keys[~alone[place]]
    return levels


def slots_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key: the rank of its bit; -1 for a key with no bit on any level."""
    slot = np.full(len(keys), -1, np.int64)
    open_keys, before = np.arange(len(keys)), 0
    for number, bits in enumerate(levels):
        ranks = np.cumsum(bits)
        place = (key_hash(keys[open_keys], number) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place]
        slot[open_keys[hit]] = before + ranks[place[hit]] - 1
        open_keys = open_keys[~hit]
        before += int(ranks[-1]) if len(ranks) else 0
    return slot


def index_bytes(columns: dict[str, np.ndarray]) -> list[bytes]:
    """An index file for distinct keys (`doc_id`) and their places."""
    keys = columns["doc_id"]
    levels = build_levels(keys)
    records = np.zeros(len(keys), RECORD)
    slot = slots_of(levels, keys)
    records["print"][slot] = (key_hash(keys, 2_000_003) >> np.uint64(32)).astype(np.uint32)
    for name in PLACE[1:]:
        records[name][slot] = columns[name]
    parts = [struct.pack(INDEX_HEAD, b"TKX1", len(levels), len(keys))]
    for bits in levels:
        parts += [struct.pack("<Q", len(bits)), np.packbits(bits, bitorder="little").tobytes()]
    return [*parts, records.tobytes()]


def index_lookup(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of the keys and which of them the index holds, up to a 32-bit fingerprint."""
    magic, count, held = struct.unpack_from(INDEX_HEAD, data)
    if magic != b"TKX1":
        raise ValueError("not an index file")
    at, levels = struct.calcsize(INDEX_HEAD), []
    for _ in range(count):
        (width,) = struct.unpack_from("<Q", data, at)
        size = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, size, at + 8)
        levels.append(np.unpackbits(bits, count=width, bitorder="little").astype(bool))
        at += 8 + size
    records = np.frombuffer(data, RECORD, held, at)
    slot = slots_of(levels, keys)
    found = records[np.maximum(slot, 0)] if held else np.zeros(len(keys), RECORD)
    prints = (key_hash(keys, 2_000_003) >> np.uint64(32)).astype(np.uint32)
    return found, (slot >= 0) & (found["print"] == prints)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> Store:
    """Encode all documents and write shards, index and manifest to a shared folder."""
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        number = TaskContext.get().partitionId()
        uri = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex[:8]}.bin"
        payload, lengths, keys = [], [], []
        for batch in batches:
            for part in pieces(batch):
                keys += part.column("doc_id").to_pylist()
                found = encode(part.column("text"))
                for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                    lengths.append(int(b - a) + 1)
                    payload.append(found.ids[a:b].astype(f"<u{width}").tobytes() + end[:width])
        if keys:
            offsets = np.cumsum([0, *lengths]).astype("<u8")
            head = struct.pack(SHARD_HEAD, b"TKS1", width, len(keys), int(offsets[-1]))
            written(uri, [head, *payload, offsets.tobytes()])
            n = len(keys)
            for first in range(0, n, 50_000):
                last = min(first + 50_000, n)
                rows = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[first:last], pa.int64()),
                        pa.array(np.full(rows, number, np.int64)),
                        pa.array(np.arange(first, last, dtype=np.int64)),
                        pa.array(np.array(lengths[first:last], np.int64)),
                        pa.array([uri] * rows, pa.string()),
                    ],
                    names=["doc_id", "shard", "ordinal", "n_tokens", "file"],
                )

    # the text's hash and the row's place split a key that holds many rows
    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .withColumn("_hash", F.xxhash64("text"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    directory = materialise(
        sorted_rows.select("doc_id", "text").mapInArrow(
            shard, "doc_id long, shard long, ordinal long, n_tokens long, file string"
        )
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = (
        directory.groupBy("shard", "file")
        .agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
        .withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("documents_before", F.coalesce(F.sum("documents").over(before), F.lit(0)))
    )
    manifest.write.parquet(f"{folder}/manifest")
    manifest = docs.sparkSession.read.parquet(f"{folder}/manifest")

    places = (
        directory.groupBy("doc_id")
        .agg(
            F.min(F.struct("shard", "ordinal")).alias("first"),
            F.max("shard").alias("last"),
            F.count("*").alias("copies"),
        )
        .select("doc_id", "first.shard", "last", "first.ordinal", "copies")
    )
    places = materialise(places)
    keys = places.where("doc_id IS NOT NULL")
    ranges = max(1, -(-keys.count() // INDEX_KEYS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            columns = {name: table.column(name).to_numpy() for name in PLACE}
            at = range_of(columns["doc_id"], ranges)
            for number in np.unique(at):
                uri = f"{folder}/index-{number:06d}-{uuid.uuid4().hex[:8]}.bin"
                written(uri, index_bytes({n: c[at == number] for n, c in columns.items()}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([uri])], names=["range", "index"]
                )

    by_range = keyed(keys, ranges).repartition(ranges, "range").select(*PLACE)
    indexes = materialise(by_range.mapInArrow(index, "range long, index string"))
    return Store(folder, ranges, manifest, indexes, places.where("doc_id IS NULL"))


def keyed(keys: DataFrame, ranges: int) -> DataFrame:
    """`keys` with the hash range (index file) of their `doc_id`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = range_of(batch.column("doc_id").to_numpy(zero_copy_only=False), ranges)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "range"])

    return keys.mapInArrow(add, f"{', '.join(f'{n} {t}' for n, t in keys.dtypes)}, range long")


def look_up(store: Store, keys: DataFrame) -> DataFrame:
    """Shard, first ordinal and number of documents of each distinct `doc_id` that is stored."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, bytes] = {}
        for batch in batches:
            wanted = batch.column("doc_id").to_numpy(zero_copy_only=False)
            names = np.array(batch.column("index").to_pylist(), object)
            for name in set(names.tolist()):
                if name not in files:
                    system, path = opened(name)
                    with system.open_input_stream(path) as source:
                        files = {name: source.read()}
                here = wanted[names == name]
                records, known = index_lookup(files[name], here)
                columns = [pa.array(here[known])]
                columns += [pa.array(records[n][known].astype(np.int64)) for n in PLACE[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=PLACE)

    wanted = keys.select(F.col("doc_id").cast("long")).distinct()
    joined = keyed(wanted.where("doc_id IS NOT NULL"), store.ranges).join(store.indexes, "range")
    found = joined.select("doc_id", "index").sortWithinPartitions("index").mapInArrow(find, PLACES)
    asked = wanted.where("doc_id IS NULL").select(F.lit(1).alias("asked"))
    nulls = store.nulls.withColumn("asked", F.lit(1)).join(asked, "asked").select(*PLACE)
    return found.unionByName(nulls)


def read_documents(store: Store, places: DataFrame) -> DataFrame:
    """Documents at the given places: `doc_id, start, n_tokens, ids`.

    A key's documents lie side by side and may go on in the next shards.
    """
    base = store.manifest.selectExpr("shard", "documents_before AS base")
    shards = store.manifest.selectExpr(
        "shard AS at", "file", "tokens_before", "documents_before AS lo",
        "documents_before + documents AS hi",
    )
    runs = places.join(base, "shard").selectExpr(
        "doc_id", "base + ordinal AS a", "base + ordinal + copies AS b",
        "explode(sequence(shard, last)) AS at",
    )
    wanted = runs.join(shards, "at").selectExpr(
        "doc_id", "at AS shard", "file", "tokens_before", "greatest(a - lo, 0) AS ordinal",
        "least(b, hi) - greatest(a, lo) AS n",
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = struct.calcsize(SHARD_HEAD)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out: list[tuple] = []
            size = 0
            for row in rows:
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name = row["file"]
                    system, path = opened(name)
                    source = system.open_input_file(path)
                    magic, width, documents, tokens = struct.unpack(SHARD_HEAD, source.read_at(head, 0))
                    if magic != b"TKS1":
                        raise ValueError("not a shard file")
                    table = head + width * tokens
                    offsets = np.frombuffer(source.read_at(8 * (documents + 1), table), "<u8").astype(np.int64)
                for n in range(row["ordinal"], row["ordinal"] + row["n"]):
                    a, b = int(offsets[n]), int(offsets[n + 1])
                    raw = source.read_at(width * (b - a), head + width * a)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                    out.append((row["doc_id"], row["tokens_before"] + a, b - a, ids))
                    size += len(ids)
                    if size > 1 << 22:
                        yield documents_batch(out)
                        out, size = [], 0
            if out:
                yield documents_batch(out)

    spread = wanted.repartition("shard").sortWithinPartitions("shard", "ordinal")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def documents_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


def get(store: Store, keys: DataFrame) -> DataFrame:
    """Documents of the given keys, through the index."""
    return read_documents(store, look_up(store, keys))
