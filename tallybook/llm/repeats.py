"""Substring dedup by seed and extend on winnowed anchors.

Words are runs of bytes other than white space, unchanged. Each run of `size` words (a
window) has one anchor: of its runs of `SEED_WORDS` words the one with the smallest
hash, the leftmost of equals. Equal windows have equal anchors at equal places. So:

1. documents are scanned for their anchors; anchors that occur once are seeds of nothing;
2. anchors that occur again are seeds: each is extended both ways, up to the ends of the
   windows it is the anchor of, and these windows are compared by their hashes;
3. a window that also starts earlier (smaller `doc_id`, or same document and earlier
   start) is a repeat. Repeats that touch are joined: the maximal repeated spans.

Documents whose words all equal those of an earlier document are found first, whole.
Windows are compared within a task before any shuffle, so a passage that a third of all
documents share arrives as one row per task. Windows are equal if a 64-bit hash of the
window and 32 bits of its anchor's hash agree.

A null or empty text has no words. Rows with one `doc_id` start neither earlier nor
later than each other; repeated rows get the same result. A null `doc_id` comes last.
Only `doc_id` and `text` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.occurrences import repeated_values
from tallybook.llm.text import Words, pieces, release, text_bytes, windows, words
from tallybook.session import is_small, materialise

SEED_WORDS = 6
# Windows a task compares at once.
WINDOWS_HELD = 2_000_000
LAST = 2**63 - 1
# A table is broadcast only below this many measured bytes.
SMALL = 16 << 20


def identified(docs: DataFrame) -> DataFrame:
    """`key` orders the documents; `row_id` tells rows apart that share a `doc_id`."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(LAST)).alias("key"),
        F.xxhash64(doc_id, "text").alias("row_id"),
        "text",
    )


def anchors(found: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hashes, and for each window of each text its anchor; windows' bounds per text."""
    seeds, bounds = windows(found, SEED_WORDS)
    span = size - SEED_WORDS + 1
    low, place, width = seeds, np.arange(len(seeds)), 1
    while width < span:
        step = min(width, span - width)
        if len(low) <= step:
            low, place = low[:0], place[:0]
            break
        right = low[step:] < low[:-step]
        place = np.where(right, place[step:], place[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    counts = np.maximum(np.diff(bounds) - span + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    return seeds, place[starts] if len(starts) else starts, ends


def scan_piece(part: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """A piece's rows of `scan`."""
    texts = part.column("text")
    found = words(texts)
    data, limits = text_bytes(texts)
    digests = [
        hashlib.sha256(b" ".join(data[a:b].tobytes().split())).digest()
        for a, b in zip(limits[:-1], limits[1:])
    ]
    seeds, place, ends = anchors(found, size)
    # the anchors of a text's windows never move left
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    new[ends[:-1][ends[:-1] < len(place)]] = True
    offsets = np.concatenate([[0], np.cumsum(new)])[ends].astype(np.int32)
    values = pa.array(seeds[place[new]].view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            part.column("key"),
            part.column("has_id"),
            part.column("row_id"),
            pa.array(np.diff(found.bounds).astype(np.int64)),
            pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), values),
        ],
        names=["key", "has_id", "row_id", "n_words", "digest", "anchors"],
    )


def scan(docs: DataFrame, size: int) -> DataFrame:
    """Per row: `key, has_id, row_id, n_words, digest` of all words, and its `anchors`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield scan_piece(part, size)
        batch = part = None  # the worker lives on, idle, while others need its memory
        release()

    has_id = F.col("doc_id").isNotNull().alias("has_id")
    return docs.select("key", has_id, "row_id", "text").mapInArrow(
        read, "key long, has_id boolean, row_id long, n_words long, digest binary, anchors array<long>"
    )


def windows_at(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...] | None:
    """Hash, check, key, row and start of each window of a piece whose anchor is a seed of its row's piece."""
    found = words(part.column("text"))
    seeds, place, ends = anchors(found, size)
    wanted = pc.list_flatten(part.column("seeds")).to_numpy(zero_copy_only=False)
    use = np.isin(seeds[place], wanted.view(np.uint64)) if len(place) else np.zeros(0, bool)
    if not use.any():
        return None
    hashes, _ = windows(found, size)
    text = np.repeat(np.arange(part.num_rows), np.diff(ends))[use]
    start = (np.arange(len(place)) - np.repeat(ends[:-1], np.diff(ends)))[use]
    check = (seeds[place[use]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    key = part.column("key").to_numpy()[text]
    return hashes[use], check, key, part.column("row_id").to_numpy()[text], start.astype(np.int32)


def compare_windows(docs: DataFrame, size: int) -> DataFrame:
    """Windows at the seeds of `docs`, compared within the task.

    Rows without `hash` are repeats: windows `first` to `last` of a row. Rows with `hash`
    are windows with no earlier equal in their task.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, check, key, row_id, start = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((start, key, check, hashes))
        same = np.zeros(len(order), bool)
        same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (check[order][1:] == check[order][:-1])
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(order), bool)
        later[order] = (key[order] != key[first]) | (start[order] != start[first])
        at = np.flatnonzero(later)
        if len(at):
            breaks = np.ones(len(at), bool)
            breaks[1:] = (row_id[at][1:] != row_id[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)
            begin = np.flatnonzero(breaks)
            end = np.concatenate([begin[1:], [len(at)]]) - 1
            none = pa.nulls(len(begin), pa.int64())
            yield window_batch(none, none.cast(pa.int32()), key[at][begin], row_id[at][begin], start[at][begin], start[at][end])
        open_ = ~later
        for a in range(0, int(open_.sum()), 100_000):
            s = slice(a, a + 100_000)
            yield window_batch(
                pa.array(hashes[open_][s].view(np.int64)), pa.array(check[open_][s]),
                key[open_][s], row_id[open_][s], start[open_][s], start[open_][s],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for part in pieces(batch):
                some = windows_at(part, size)
                if some is None:
                    continue
                held.append(some)
                count += len(some[0])
                if count > WINDOWS_HELD:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)
        batch = part = some = held = None
        release()

    return docs.select("key", "row_id", "text", "seeds").mapInArrow(
        read, "hash long, check int, key long, row_id long, first int, last int"
    )


def window_batch(hashes, check, key, row_id, first, last) -> pa.RecordBatch:
    columns = [hashes, check, *(pa.array(c) for c in (key, row_id, first, last))]
    return pa.RecordBatch.from_arrays(columns, names=["hash", "check", "key", "row_id", "first", "last"])


def joined(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join with a written table that is broadcast only if it was measured small."""
    return rows.join(F.broadcast(side) if is_small(side, SMALL) else side, key, how)


def only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `docs` whose `row_id` is among those chosen, before any text moves."""
    ids = chosen.select("row_id")
    return joined(docs, ids, "row_id", "left_semi")


def repeated_spans(docs: DataFrame, scanned: DataFrame, size: int = 20) -> DataFrame:
    """`row_id, spans`: the words, first to last, that belong to repeated windows.

    `docs` are `identified` rows and `scanned` their `scan`. Rows without repeats are absent.
    """
    # whole copies
    groups = scanned.where(F.col("n_words") >= size).groupBy("digest")
    groups = groups.agg(F.min("key").alias("first_key"), F.count("*").alias("rows"))
    copied = materialise(groups.where("rows > 1").drop("rows"))
    copies = materialise(
        joined(scanned.select("key", "row_id", "n_words", "digest"), copied, "digest")
        .where("key > first_key")
        .select("row_id", "n_words")
        .distinct()
    )
    left = joined(scanned.select("row_id", "anchors"), copies.select("row_id"), "row_id", "left_anti")
    again = materialise(repeated_values(left, "anchors").withColumnRenamed("value", "seed"))
    seeds = joined(left.select("row_id", F.explode("anchors").alias("seed")), again, "seed", "left_semi")
    seeds = materialise(seeds.groupBy("row_id").agg(F.collect_set("seed").alias("seeds")))
    candidates = only(docs, seeds).join(seeds, "row_id")
    found = materialise(compare_windows(candidates, size))
    equal = Window.partitionBy("hash", "check")
    earliest = F.min(F.struct("key", "first")).over(equal)
    open_ = found.where("hash IS NOT NULL").withColumn("earliest", earliest)
    later = open_.where("key > earliest.key OR first > earliest.first")
    spans = (
        found.where("hash IS NULL")
        .select("row_id", "first", "last")
        .unionByName(later.select("row_id", "first", "last"))
        .selectExpr("row_id", f"struct(first, last + {size - 1} AS last) AS span")
    )
    whole = copies.selectExpr("row_id", "struct(0 AS first, int(n_words - 1) AS last) AS span")
    return spans.unionByName(whole).groupBy("row_id").agg(F.collect_set("span").alias("spans"))


def cut_piece(part: pa.RecordBatch) -> pa.RecordBatch:
    """A piece's rows of `cut_spans`."""
    data, limits = text_bytes(part.column("text"))
    held = part.column("spans").to_pylist()
    total, removed, kept = [], [], []
    for spans, a, b in zip(held, limits[:-1], limits[1:]):
        found = data[a:b].tobytes().split()
        gone = 0
        total.append(len(found))
        if spans:
            edges = np.zeros(len(found) + 1, np.int64)
            np.add.at(edges, [s["first"] for s in spans], 1)
            np.add.at(edges, [s["last"] + 1 for s in spans], -1)
            keep = np.cumsum(edges[:-1]) == 0
            found = list(compress(found, keep))
            gone = len(keep) - len(found)
        removed.append(gone)
        kept.append(b" ".join(found))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            part.column("row_id"),
            pa.array(total, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "row_id", "n_words", "n_removed", "kept"],
    )


def cut_spans(marked: DataFrame) -> DataFrame:
    """Per row `doc_id, row_id, n_words, n_removed, kept`: the words outside `spans`, joined
    by one space."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield cut_piece(part)
        batch = part = None
        release()

    return marked.select("doc_id", "row_id", "text", "spans").mapInArrow(
        read, "doc_id long, row_id long, n_words long, n_removed long, kept string"
    )


def without_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """Per row `doc_id, n_words, n_removed, kept`, the text left of it."""
    rows = identified(docs)
    spans = materialise(repeated_spans(rows, materialise(scan(rows, size)), size))
    return cut_spans(joined(rows, spans, "row_id", "left")).drop("row_id")


def kept_digests(docs: DataFrame, size: int = 20) -> DataFrame:
    """Per row `doc_id, n_words, n_removed, kept_sha256` (hex) of the text left of it.

    Texts without repeats were digested when they were scanned and are not moved again.
    """
    rows = identified(docs)
    scanned = materialise(scan(rows, size))
    spans = materialise(repeated_spans(rows, scanned, size))
    cut = cut_spans(only(rows, spans).join(spans, "row_id"))
    # repeated rows are cut alike
    cut = cut.groupBy("row_id").agg(
        F.max("n_removed").alias("n_removed"), F.max(F.sha2("kept", 256)).alias("cut_sha256")
    )
    doc_id = F.when(F.col("has_id"), F.col("key")).alias("doc_id")
    return joined(scanned.drop("anchors"), materialise(cut), "row_id", "left").select(
        doc_id,
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
