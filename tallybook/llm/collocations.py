"""Collocations per language by best-first branch-and-bound growth of phrases.

A phrase of two or three words that occurs `least` times or more is a candidate. Cut after
its first k words into parts occurring l and r times, it scores floor(10^6 a^2 / (l r));
its lowest-scoring cut counts. A candidate inside a longer one that occurs at least half as
often is dropped. Wanted are each language's best `limit`.

Words and pairs are counted in one pass. Growing a pair (u, v) by a third word is bounded
by prefix counts: no phrase occurs more often than its prefix, so none grown from (u, v)
scores above floor(10^6 f(u v) / f(u)). Whether a pair that starts with v survives also
depends on what grows from (u, v), so the pair waits in the frontier under the higher of
that bound and the best score of any pair starting with v. A round grows the first `ROUND`
waiting pairs of all open languages, best first, by one pass over the texts. A language is
settled once `limit` survivors score above all that still waits, so nothing that waits can
reach, or tie with, its last rank. Whatever the data, the result is exact; a loose bound
costs rounds only.

Tasks get the frontier of one round as hashes, at most ROUND (or one per language, if
there are more languages). Counts never rest on hashes alone: phrases travel as text, and
equal 64-bit hashes within a task are told apart by a second one.

A null or empty text has no words, a null language is `und`. Repeated rows count again.
Ties go by count, then by phrase in byte order. A long text is read in blocks that share
two words, cut at any separator; only a single word is never cut. An empty table gives an
empty result. Only `text` and `lang` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.text import FOLD, run_hashes, text_bytes
from tallybook.operators.lookup import join_key_values
from tallybook.session import is_small, materialise

# Pairs grown in one round, over all languages.
ROUND = 1 << 18
# Text bytes worked on at once, rows of phrases merged before they leave a task, and rows
# that leave it at once.
BLOCK = 1 << 18
MERGED = 1 << 19
SENT = 1 << 15
SCALE = 1_000_000

BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True
# Values of bytes for the second hash.
SECOND = np.random.default_rng(41).integers(1, 2**63, 256).astype(np.uint64)


class Block(NamedTuple):
    """Parts of texts end to end: part i is data[limits[i] : limits[i + 1]], and its words
    that begin before limits[i] + old[i] were counted with the part before."""

    data: np.ndarray
    limits: np.ndarray
    old: np.ndarray
    rows: np.ndarray


def context(raw: np.ndarray, cut: int) -> int:
    """Where the last two words before `cut` begin."""
    size = 256
    while True:
        low = max(0, cut - size)
        inside = np.concatenate([[False], ~GAP[raw[low:cut]]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        # the first word found may have begun before `low`
        if low == 0 or len(starts) > 2:
            return low + int(starts[-2]) if len(starts) > 1 else low
        size *= 8


def parts(raw: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """Start, first new byte and end of the parts of one text."""
    at, n = 0, len(raw)
    while at < n:
        end = at + block
        if end < n:
            near = np.flatnonzero(GAP[raw[at + block // 2 : end]])
            if len(near):
                end = at + block // 2 + int(near[-1])
            else:
                while end < n and not GAP[raw[end]]:
                    end += 1
        end = min(end, n)
        yield context(raw, at) if at else 0, at, end
        at = end


def blocks(texts: pa.Array, block: int) -> Iterator[Block]:
    """All texts in blocks of about `block` bytes."""
    data, limits = text_bytes(texts)
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def made() -> Block:
        lengths = [len(raw) for raw, _, _ in held]
        joined = FOLD[np.concatenate([raw for raw, _, _ in held])]
        return Block(
            joined,
            np.concatenate([[0], np.cumsum(lengths)]),
            np.array([old for _, old, _ in held]),
            np.array([row for _, _, row in held]),
        )

    for row, (start, stop) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist())):
        raw = data[start:stop]
        for low, at, end in parts(raw, block):
            held.append((raw[low:end], at - low, row))
            size += end - low
            if size >= block:
                yield made()
                held, size = [], 0
    if held:
        yield made()


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    part: np.ndarray
    new: np.ndarray
    follows: np.ndarray  # whether the next word stands in the same piece
    hashes: np.ndarray


def words_of(found: Block) -> Words:
    inside = ~GAP[found.data]
    limits = found.limits
    before = np.concatenate([[False], inside[:-1]])
    before[limits[:-1][limits[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[limits[1:][limits[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    part = np.searchsorted(limits, starts, "right") - 1
    piece = np.cumsum(BREAK[found.data], dtype=np.int64)[starts] if len(starts) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (part[1:] == part[:-1]) & (piece[1:] == piece[:-1])
    new = starts >= limits[part] + found.old[part]
    hashes = run_hashes(found.data.astype(np.uint64) + np.uint64(1), starts, ends)
    return Words(starts, ends, part, new, follows, hashes)


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs of hashes together, and where each begins in it."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    begins = np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(a) else np.empty(0, np.int64)
    return order, begins


class Held:
    """Phrases of one size from several blocks, merged before they leave the task."""

    def __init__(self, size: int):
        self.size = size
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, lang: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray, phrase: pa.Array):
        self.parts.append((lang, first, second, n, phrase))
        self.rows += len(n)

    def merged(self, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        lang, first, second, n = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        phrase = pa.concat_arrays([p[4] for p in self.parts])
        order, begins = grouped(first, second)
        pick = order[begins]
        n = np.add.reduceat(n[order], begins)
        self.parts, self.rows = [], 0
        for at in range(0, len(pick), SENT):
            some = pick[at : at + SENT]
            own = langs.take(pa.array(lang[some]))
            yield batch_of(own, self.size, phrase.take(pa.array(some)), n[at : at + SENT])


def batch_of(lang: pa.Array, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    kinds = pa.array(np.full(len(n), size, np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, kinds, phrase, pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"]
    )


def phrases(found: Block, words: Words, at: np.ndarray, size: int) -> pa.Array:
    """The `size` words from each place on, joined by single spaces."""
    which = (at[:, None] + np.arange(size)).ravel()
    lengths = words.ends[which] - words.starts[which] + 1
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(words.starts[which] - ends + lengths, lengths) + np.arange(total)
    out = found.data[np.minimum(place, max(len(found.data) - 1, 0))]
    out[ends - 1] = 32
    # the space after a phrase is not part of it
    bounds = np.concatenate([[0], ends[size - 1 :: size]])
    keep = np.ones(total, bool)
    keep[bounds[1:] - 1] = False
    offsets = (bounds - np.arange(len(bounds))).astype(np.int32)
    return pa.Array.from_buffers(
        pa.string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[keep].tobytes())]
    )


def language_hash(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def pair_hashes(hashes: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return run_hashes(hashes, at, at + 2) ^ lang


def grams(docs: DataFrame, sizes: tuple[int, ...], block: int, grown: np.ndarray | None = None) -> DataFrame:
    """`lang, size, phrase, n` of all phrases of these sizes; with `grown`, sorted hashes of
    pairs, only those that begin with one of them. Size 0: all words of a language."""

    def one(found: Block, held: list[Held], codes: np.ndarray, keys: np.ndarray, total: np.ndarray) -> None:
        words = words_of(found)
        lang = codes[found.rows][words.part]
        second = run_hashes(SECOND[found.data], words.starts, words.ends)
        total += np.bincount(lang[words.new], minlength=len(total))
        for some in held:
            size = some.size
            fine = np.zeros(len(words.starts), bool)
            last = len(fine) - size + 1
            if last > 0:
                fine[:last] = words.new[size - 1 :]
                for step in range(size - 1):
                    fine[:last] &= words.follows[step : step + last]
            at = np.flatnonzero(fine)
            if grown is not None and len(at):
                pair = pair_hashes(words.hashes, at, keys[lang[at]])
                place = np.minimum(np.searchsorted(grown, pair), len(grown) - 1)
                at = at[grown[place] == pair]
            if not len(at):
                continue
            key = keys[lang[at]]
            first = run_hashes(words.hashes, at, at + size) ^ key
            other = run_hashes(second, at, at + size) ^ key
            order, begins = grouped(first, other)
            n = np.diff(np.append(begins, len(order)))
            pick = order[begins]
            some.add(lang[at[pick]], first[pick], other[pick], n, phrases(found, words, at[pick], size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Held(size) for size in sizes if size > 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
            langs = coded.dictionary.cast(pa.string())
            keys = np.array([language_hash(x) for x in langs.to_pylist()], np.uint64)
            total = np.zeros(len(langs), np.int64)
            for found in blocks(batch.column(1), block):
                one(found, held, coded.indices.to_numpy(), keys, total)
                if sum(some.rows for some in held) >= MERGED:
                    for some in held:
                        yield from some.merged(langs)
            # languages are numbered anew in the next batch
            for some in held:
                yield from some.merged(langs)
            if 0 in sizes:
                yield batch_of(langs, 0, pa.nulls(len(langs), pa.string()), total)

    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = texts.mapInArrow(count, "lang string, size int, phrase string, n long")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def quotient(top: tuple[str, ...], below: tuple[str, ...]) -> Column:
    """Whole part of 10^6 times the product of `top` over that of `below`, in 38 digits."""
    product = " * ".join(f"cast({c} AS decimal(38,0))" for c in top)
    return F.expr(f"({SCALE} * {product}) div ({' * '.join(f'cast({c} AS decimal(38,0))' for c in below)})")


def pairs_of(counts: DataFrame) -> DataFrame:
    """Candidate pairs with the counts of their words, their score and `priority`."""
    words = materialise(
        counts.where("size = 1").selectExpr("lang", "phrase AS word", "n AS c", "n div 10 AS weight")
    )
    both = F.split("phrase", " ")
    pairs = counts.where("size = 2").select(
        "lang", "phrase", both[0].alias("first"), both[1].alias("second"), F.col("n").alias("a")
    )
    for side, name in (("first", "l"), ("second", "r")):
        own = words.selectExpr("lang", f"word AS {side}", f"c AS {name}", "weight")
        pairs = join_key_values(pairs, own, ["lang", side], "weight").drop("weight")
    pairs = materialise(pairs.withColumn("score", quotient(("a", "a"), ("l", "r"))))
    starts = pairs.groupBy("lang", F.col("first").alias("second")).agg(
        F.max("score").alias("ahead"), F.expr("max(l) div 10").alias("weight")
    )
    pairs = join_key_values(pairs, materialise(starts), ["lang", "second"], "weight").drop("weight")
    bound = quotient(("a",), ("l",))
    return pairs.withColumn("priority", F.greatest(bound, F.coalesce("ahead", F.lit(0)))).drop("ahead")


def queued(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pairs` with `place`, from 0 in each language by falling priority, and the languages.

    Places come from a range partitioning and the sizes of its parts, so a language that
    holds most pairs is still sorted by many tasks.
    """
    order = [F.col("lang"), F.col("priority").desc(), F.col("phrase")]
    held = materialise(
        pairs.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        held.groupBy("part")
        .agg(F.count("*").alias("held"), F.min("at").alias("least"))
        .withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    )
    number = F.col("ahead") + F.col("at") - F.col("least")
    placed = held.join(sizes.drop("held"), "part").withColumn("number", number)
    languages = materialise(placed.groupBy("lang").agg(F.min("number").alias("begin")))
    placed = placed.join(spread_out(languages), "lang").withColumn("place", F.col("number") - F.col("begin"))
    names = ["lang", "phrase", "a", "l", "r", "score", "priority", "place"]
    return materialise(placed.select(*names)), languages.select("lang")


def hashes_of(frontier: DataFrame) -> np.ndarray:
    """Hashes of the frontier's pairs, at most as many as a round grows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = next(blocks(batch.column(1), 1 << 40))
            words = words_of(found)
            keys = np.array([language_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            pair = pair_hashes(words.hashes, np.arange(0, len(words.starts), 2), keys)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64))], names=["hash"])

    rows = frontier.select("lang", "phrase").mapInArrow(hashed, "hash long").toArrow()
    return np.unique(rows.column("hash").to_numpy().view(np.uint64))


def grown(docs: DataFrame, frontier: DataFrame, pairs: DataFrame, least: int, block: int) -> DataFrame:
    """Candidates of three words that begin with a pair of `frontier`, scored."""
    found = grams(docs, (3,), block, hashes_of(frontier)).where(F.col("n") >= least)
    words = F.split("phrase", " ")
    found = found.select(
        "lang",
        "phrase",
        F.concat_ws(" ", words[0], words[1]).alias("prefix"),
        F.concat_ws(" ", words[1], words[2]).alias("suffix"),
        F.col("n").alias("a"),
    )
    heads = frontier.selectExpr("lang", "phrase AS prefix", "a AS head", "l AS one", "a div 10 AS weight")
    found = join_key_values(found, materialise(heads), ["lang", "prefix"], "weight").drop("weight")
    # pairs outside the frontier that share a hash with one inside go here
    found = found.where("head IS NOT NULL")
    tails = pairs.selectExpr("lang", "phrase AS suffix", "a AS tail", "r AS three", "a div 10 AS weight")
    found = join_key_values(found, tails, ["lang", "suffix"], "weight").drop("weight")
    early, late = quotient(("a", "a"), ("one", "tail")), quotient(("a", "a"), ("head", "three"))
    found = found.withColumn("early", early).withColumn("late", late)
    return materialise(
        found.selectExpr(
            "lang",
            "phrase",
            "a",
            "if(early <= late, one, head) AS l",
            "if(early <= late, tail, three) AS r",
            "least(early, late) AS score",
            "prefix",
            "suffix",
        )
    )


def spread_out(values: DataFrame) -> DataFrame:
    """A table with one row per language, to be sent to all rows if it was measured to fit."""
    held = materialise(values)
    return F.broadcast(held) if is_small(held) else held


def survivors(pairs: DataFrame, longer: DataFrame) -> DataFrame:
    """Known candidates without the pairs that lie in a known longer one half as frequent."""
    around = longer.selectExpr("lang", "prefix AS phrase", "a AS most")
    around = around.unionByName(longer.selectExpr("lang", "suffix AS phrase", "a AS most"))
    around = around.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    kept = pairs.join(around, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 50 * a")
    return kept.select(*names).unionByName(longer.select(*names))


def collocations(
    docs: DataFrame, limit: int = 2000, least: int = 10, per_round: int = ROUND, block: int = BLOCK
) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the best `limit` phrases of every language."""
    counts = grams(docs, (0, 1, 2), block)
    counts = materialise(counts.where((F.col("n") >= least) | (F.col("size") == 0)))
    pairs, languages = queued(pairs_of(counts))
    known = None
    open_languages, done = languages, 0
    while (waiting := open_languages.count()) > 0:
        step = max(1, per_round // waiting)
        queue = pairs.join(spread_out(open_languages), "lang", "left_semi").where(F.col("place") >= done)
        frontier = materialise(queue.where(F.col("place") < done + step))
        more = grown(docs, frontier, pairs, least, block)
        known = more if known is None else known.unionByName(more)
        done += step
        # the best that still waits; a language without such a row is settled
        ahead = pairs.where(F.col("place") == done).select("lang", F.col("priority").alias("next"))
        ahead = spread_out(ahead.join(spread_out(open_languages), "lang", "left_semi"))
        above = survivors(pairs, known).join(ahead, "lang").where("score > next")
        settled = above.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        open_languages = materialise(ahead.join(settled, "lang", "left_anti").select("lang"))
    spark = docs.sparkSession
    names = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if known is None:
        return spark.createDataFrame([], names)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = survivors(pairs, known).withColumn("rank", F.row_number().over(best))
    totals = counts.where("size = 0").select("lang", "n")
    return (
        ranked.where(F.col("rank") <= limit)
        .join(spread_out(totals), "lang")
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
