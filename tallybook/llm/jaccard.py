"""N-gram Jaccard join: documents whose sets of word shingles overlap strongly.

d(x, y) = 1 - |x n y| / |x u y| is a metric. The join has these steps:

1. Equal sets are one, named by a 64-bit hash of one of its texts; the smallest document
   that holds it stands for it. All further steps work on these sets, not on documents.
2. Regions. Plain document pivots cannot part texts: unrelated texts lie at distance 1
   from every pivot, so a window of twice the radius replicates all of them. The coarse
   regions are therefore those of single shingles: sets ordered by a fixed order of all
   shingles (rare first, by counts over all documents) that link share a shingle among
   their first n - ceil(t * n) + 1. A set is replicated to the regions of these.
3. Cells. Sets are assigned to their nearest pivot within the radius (a Voronoi cell);
   pivots come from min-hash groups and distances are exact. Within regions cells are
   joined, not sets, so a family of thousands of near copies is one row per region.
4. Cells meet recursively: by their pivots; if that leaves a link possible, the members
   which the triangle inequality leaves as candidates meet the other pivot; then the
   members that both pivots leave meet each other. Cells that are found linked are done.

No link between two components is lost; all distances that decide are exact.

A text with fewer words than a shingle has its whole word sequence as one. A text
without words, or null, has an empty set and links with nothing. For `link_documents`
rows with one `doc_id` are one document, which links if any of its rows does. A null
`doc_id` comes last and is one document too; its component is the smallest other
`doc_id`, or null. For `link_rows` ids link nothing, only texts do. Only
`doc_id` and `text` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.components import components
from tallybook.llm.occurrences import repeated_values
from tallybook.llm.text import pieces, run_hashes, windows, words
from tallybook.session import discard, is_small, keep_last, made_here, materialise

# Counters of the shingle order; a shingle counts into one of them by its hash.
COUNTER_BITS = 18
# Min-hash values per set, by multiplication with powers of an odd constant.
MINIMA = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 7)], np.uint64)
# A pivot must share this many of them with a set to be compared with it.
AGREE = 2
# Least classes of the shingle universe; counts per class bound the difference of two sets.
# A set has at most two shingles a class, so that long unrelated sets differ as clearly as short ones.
CLASSES = 128
# Counts that a task compares at once.
COUNTS = 1 << 21
# Members of a cell, or pivots near it, that are compared at once.
BLOCK = 4096
LAST = 2**63 - 1
# A table is broadcast only below this many measured bytes.
SMALL = 16 << 20


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    found = words(texts, fold=True)
    hashes, bounds = windows(found, size)
    counts = np.diff(found.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = dict(zip(short.tolist(), run_hashes(found.hashes, found.bounds[short], found.bounds[short + 1])))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        yield np.array([whole[i]], np.uint64) if i in whole else np.unique(hashes[a:b])


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def counter_levels(docs: DataFrame, size: int) -> np.ndarray:
    """How common the shingles of each counter are, as eighths of octaves above the mean."""
    counters = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for part in pieces(batch):
                hashes, _ = windows(words(part.column("text"), fold=True), size)
                total += np.bincount(counter_of(hashes), minlength=counters)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["counter", "n"])

    counted = docs.select("text").mapInArrow(count, "counter long, n long")
    sums = counted.groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(counters)
    counts[sums["counter"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    mean = max(counts.mean(), 1.0)
    return np.floor(8 * np.log2(np.maximum(counts / mean, 1.0))).astype(np.uint8)


def class_counts(found: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall in each class; a power of two classes, by low bits."""
    number = max(CLASSES, 1 << max(len(found) - 1, 1).bit_length() - 1)
    held = np.bincount((found & np.uint64(number - 1)).astype(np.int64), minlength=number)
    return held.astype(np.uint16)


def folded(counts: np.ndarray, number: int) -> np.ndarray:
    """The counts of fewer classes: their numbers are the low bits of the finer ones."""
    return counts.reshape(-1, number).sum(axis=0, dtype=np.int32)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def scan(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per row: `doc, key`, `n, digest` of its set, the `prefix` of region shingles, its `minima`
    and `classes`, the counts of its shingles by class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sizes, digests, prefixes, minima, classes = [], [], [], [], []
                for found in shingle_sets(part.column("text"), size):
                    n = len(found)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    common = levels[counter_of(found)]
                    first = np.argsort(common, kind="stable")[: n - needed(n, percent) + 1 if n else 0]
                    prefixes.append(found[first].view(np.int64))
                    minima.append([(found * m).min() for m in MINIMA] if n else [0] * len(MINIMA))
                    classes.append(class_counts(found).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array([r.view(np.int64) for r in np.array(minima, np.uint64)], pa.list_(pa.int64())),
                        pa.array(classes, pa.binary()),
                    ],
                    names=["doc", "key", "n", "digest", "prefix", "minima", "classes"],
                )

    return docs.select("doc", "key", "text").mapInArrow(
        read,
        "doc long, key long, n long, digest binary, prefix array<long>, minima array<long>, classes binary",
    )


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per row: `key` and its whole set of `shingles`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [f.tobytes() for f in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(found, pa.binary())], names=["key", "shingles"]
                )

    return docs.select("key", "text").mapInArrow(read, "key long, shingles binary")


def joined(rows: DataFrame, side: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a written table that is broadcast only if it was measured small."""
    return rows.join(F.broadcast(side) if is_small(side, SMALL) else side, key, how)


def sided(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """`pairs` of keys `a`, `b` with the named columns of both sets."""
    for side in "ab":
        names = [F.col("key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)]
        pairs = pairs.join(sets.select(*names), side)
    return pairs


def sets_of(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The whole sets `key`, each from its document `doc`, whose equal rows count once."""
    sets = full_sets(joined(rows, keys, ["doc", "key"], "left_semi"), size)
    many = materialise(
        joined(rows.select("doc", "key"), keys, ["doc", "key"], "left_semi")
        .groupBy("key")
        .agg(F.count("*").alias("rows"))
        .where("rows > 1")
        .select("key")
    )
    once = joined(sets, many, "key", "left_anti")
    several = joined(sets, many, "key", "left_semi").dropDuplicates(["key", "shingles"])
    return materialise(once.unionByName(several))


def either(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The sets `key` of the pairs and the documents `doc` that stand for them."""
    keys = pairs.selectExpr("explode(array(a, b)) AS key").distinct()
    return materialise(keys.join(outlines.select("key", "doc"), "key").select("doc", "key"))


def distances(
    pairs: DataFrame, rows: DataFrame, outlines: DataFrame, size: int, reach: str = "100"
) -> DataFrame:
    """Distinct `pairs` with `overlap`, `n_a`, `n_b`; pairs surely farther than `reach` are left out.

    `reach` is an SQL expression over the pairs: a distance in percent. The counts by
    class (`outlines`: `key, doc, n, classes`) differ by at most the symmetric difference of two
    sets, so they rule most unrelated pairs out before whole sets are made.
    """
    pairs = pairs.withColumn("reach", F.expr(reach).cast("double"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                differ = np.empty(batch.num_rows)
                for i, sides in enumerate(zip(batch.column("classes_a"), batch.column("classes_b"))):
                    a, b = (np.frombuffer(side.as_py(), np.uint16) for side in sides)
                    number = min(len(a), len(b))
                    differ[i] = np.abs(folded(a, number) - folded(b, number)).sum()
                # distance >= differ / largest possible union
                bound = 200.0 * differ / np.maximum(total + differ, 1)
                keep = bound <= batch.column("reach").to_numpy() + 1e-6
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                left, right = (
                    [np.frombuffer(x, np.uint64) for x in part.column(f"shingles_{s}").to_pylist()] for s in "ab"
                )
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("a"),
                        part.column("b"),
                        pa.array(common, pa.int64()),
                        pa.array([len(x) for x in left], pa.int64()),
                        pa.array([len(x) for x in right], pa.int64()),
                    ],
                    names=["a", "b", "overlap", "n_a", "n_b"],
                )

    wanted = materialise(pairs.selectExpr("explode(array(a, b)) AS key").distinct())
    close = sided(pairs, joined(outlines, wanted, "key", "left_semi"), "n", "classes")
    close = close.select("a", "b", "reach", "n_a", "n_b", "classes_a", "classes_b")
    close = materialise(close.mapInArrow(near, "a long, b long").distinct())
    sets = sets_of(rows, either(close, outlines), size)
    whole = sided(close, sets, "shingles").select("a", "b", "shingles_a", "shingles_b")
    found = whole.mapInArrow(overlap, "a long, b long, overlap long, n_a long, n_b long")
    return found.withColumn("distance", F.expr("100D * (n_a + n_b - 2 * overlap) / (n_a + n_b - overlap)"))


def linked(percent: int) -> str:
    return f"100 * overlap >= {percent} * (n_a + n_b - overlap)"


def cells(
    alike: DataFrame, rows: DataFrame, outlines: DataFrame, size: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """`key, cell, far` (distance to the cell's pivot) of sets in a cell of others, and links.

    In each min-hash group the set with the fewest shingles of its `own` (in no other
    prefix) is a pivot: of near copies the one next to their common source. Sets that
    agree with it in several groups are compared with it. A second round looks for pivots
    among the sets that the first left alone. Sets not named are their own cells.
    """
    links, assigned = [], []
    alone = alike.withColumn("order", F.struct("own", F.xxhash64("key").alias("hash")))
    for _ in range(2):
        before = len(made_here())
        grouped = alone.select("key", "n", "order", F.posexplode("minima").alias("which", "value"))
        pivots = grouped.groupBy("which", "value").agg(
            F.min(F.struct("order", "key", "n")).alias("pivot"), F.count("*").alias("held")
        )
        pivots = pivots.where("held > 1").selectExpr("which", "value", "pivot.key AS b", "pivot.n AS n_b")
        pivots = materialise(pivots)
        side = F.broadcast(pivots) if is_small(pivots, SMALL) else pivots
        pairs = grouped.join(side, ["which", "value"]).where(
            f"key <> b AND 100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
        )
        pairs = pairs.groupBy(F.col("key").alias("a"), "b").agg(F.count("*").alias("agree"))
        pairs = materialise(pairs.where(F.col("agree") >= AGREE).select("a", "b"))
        found = distances(pairs, rows, outlines, size, str(100 - percent))
        found = materialise(found.where(linked(percent)))
        keep_last(rows.sparkSession, before)
        links.append(found.select("a", "b"))
        # pivots keep their own cells
        own = materialise(found.select(F.col("b").alias("key")).distinct())
        nearest = found.groupBy(F.col("a").alias("key")).agg(F.min(F.struct("distance", "b")).alias("best"))
        nearest = joined(nearest, own, "key", "left_anti").selectExpr("key", "best.b AS cell", "best.distance AS far")
        assigned.append(materialise(nearest.unionByName(own.selectExpr("key", "key AS cell", "0D AS far"))))
        alone = materialise(joined(alone, assigned[-1].select("key"), "key", "left_anti"))
    return assigned[0].unionByName(assigned[1]), links[0].unionByName(links[1])


def region_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of cells `a` < `b` that meet in a region and may hold a link.

    Sizes must allow the threshold. Counted from its first common shingle on, a pair
    must have room for the overlap it needs.
    """
    held = postings.groupBy("shingle", "cell").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room")
    )
    held = materialise(held)
    left, right = (
        held.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high", "room"))) for s in "ab"
    )
    met = left.join(right, "shingle").where("cell_a < cell_b")
    met = met.where(f"100 * high_a >= {percent} * low_b AND 100 * high_b >= {percent} * low_a")
    fits = f"{100 + percent} * least(room_a, room_b) >= {percent} * (low_a + low_b)"
    return met.where(fits).selectExpr("cell_a AS a", "cell_b AS b").distinct()


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose sides no path of links joins yet."""
    known = materialise(components(links))
    for side in "ab":
        names = known.selectExpr(f"node AS {side}", f"component AS in_{side}")
        pairs = joined(pairs, names, side, "left")
    pairs = pairs.where("coalesce(in_a, a) <> coalesce(in_b, b)")
    return materialise(pairs.drop("in_a", "in_b"))


def members_near(both: DataFrame, assigned: DataFrame, outlines: DataFrame, radius: int) -> DataFrame:
    """Members `a` of cells `p` that may link with members of the cell of pivot `b`.

    `both` has pairs of cells `p`, `q`, their pivots' distance `apart` and the radius of q's
    cell, `far_b`. A member must lie as far from its pivot as the triangle inequality asks
    for, and its counts by class may not rule the link out. Cells are compared in blocks
    of members and pivots, whatever their size; only what may link leaves a block.
    """

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if held.num_rows and asked.num_rows:
            number = min(pc.min(pc.binary_length(t.column("classes"))).as_py() // 2 for t in (held, asked))
            # rounded down to a power of two: larger blocks compare coarser counts
            number = min(number, max(CLASSES, 1 << (COUNTS // held.num_rows).bit_length() - 1))
            x, q = (
                np.stack([folded(np.frombuffer(c.as_py(), np.uint16), number) for c in t.column("classes")])
                for t in (held, asked)
            )
            keys, sizes, far = (held.column(c).to_numpy() for c in ("key", "n", "far"))
            rows = zip(*(asked.column(c).to_pylist() for c in ("q", "n", "apart", "far_b")))
            for i, (pivot, n, apart, far_b) in enumerate(rows):
                differ = np.abs(x - q[i]).sum(axis=1)
                near = 200.0 * differ <= (radius + far_b + 1e-6) * np.maximum(sizes + n + differ, 1)
                for j in np.flatnonzero(near & (far >= apart - radius - far_b - 1e-6)):
                    out.append((keys[j], pivot, held.column("p")[0].as_py(), far[j], far_b))
        names = ["a", "b", "p", "far_p", "far_q"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=names)

    blocks = assigned.groupBy(F.col("cell").alias("p")).agg(F.ceil(F.count("*") / BLOCK).alias("x_blocks"))
    blocks = materialise(
        blocks.join(both.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks")), "p")
    )

    def block(key: str, of: str):
        return F.pmod(F.xxhash64(key), F.col(of)).alias(of[0])

    def every(of: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).alias(of[0])

    held = materialise(joined(assigned.where("key <> cell").withColumnRenamed("cell", "p"), blocks, "p"))
    held = joined(outlines, held, "key")
    held = held.select("p", "key", "n", "far", "classes", block("key", "x_blocks"), "q_blocks")
    held = held.select("p", "key", "n", "far", "classes", "x", every("q_blocks"))
    asked = materialise(joined(both, blocks, "p"))
    asked = joined(outlines.withColumnRenamed("key", "q"), asked, "q")
    asked = asked.withColumnRenamed("q", "pivot")
    asked = asked.select("p", "pivot", "n", "apart", "far_b", "classes", block("pivot", "q_blocks"), "x_blocks")
    asked = asked.select("p", "pivot", "n", "apart", "far_b", "classes", "q", every("x_blocks"))
    asked = asked.withColumnsRenamed({"q": "q_block", "x": "x_block"}).withColumnRenamed("pivot", "q")
    held = held.withColumnsRenamed({"q": "q_block", "x": "x_block"})
    # written, so that both sides have columns of their own
    asked = materialise(asked)
    keys = ["p", "q_block", "x_block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        compare, "a long, b long, p long, far_p double, far_q double"
    )
    return found.distinct()


def cell_links(
    pairs: DataFrame, assigned: DataFrame, rows: DataFrame, outlines: DataFrame, size: int, percent: int
) -> DataFrame:
    """At least one link `a, b` of every two cells that have links, from pairs of pivots."""
    radius = 100 - percent
    before = len(made_here())
    radii = materialise(assigned.groupBy(F.col("cell").alias("key")).agg(F.max("far").alias("far")))
    sides = pairs
    for side in "ab":
        names = radii.selectExpr(f"key AS {side}", f"far AS far_{side}")
        sides = joined(sides, names, side, "left")
    sides = materialise(sides.fillna(0.0, ["far_a", "far_b"]))
    met = distances(sides, rows, outlines, size, f"{radius} + far_a + far_b")
    met = materialise(met.join(sides, ["a", "b"]))
    keep_last(rows.sparkSession, before)
    links = met.where(linked(percent)).select("a", "b")
    # pivots too far apart to link, near enough for members to
    before = len(made_here())
    open_ = met.where(f"NOT ({linked(percent)}) AND far_a + far_b > 0 AND distance <= {radius} + far_a + far_b + 1e-6")
    open_ = materialise(open_.selectExpr("a AS p", "b AS q", "distance AS apart", "far_a", "far_b"))
    both = materialise(
        open_.unionByName(open_.selectExpr("q AS p", "p AS q", "apart", "far_b AS far_a", "far_a AS far_b"))
    )
    members = materialise(members_near(both, assigned, outlines, radius))
    reached = distances(members.select("a", "b", "far_q").distinct(), rows, outlines, size, f"{radius} + far_q")
    reached = materialise(reached.join(members, ["a", "b"]))
    keep_last(rows.sparkSession, before)
    hits = reached.where(linked(percent))
    links = links.unionByName(hits.select("a", "b"))
    done = materialise(hits.selectExpr("least(p, b) AS lo", "greatest(p, b) AS hi").distinct())
    rest = reached.where(f"NOT ({linked(percent)}) AND distance <= {radius} + far_q + 1e-6")
    rest = rest.selectExpr("least(p, b) AS lo", "greatest(p, b) AS hi", "a AS x", "p", "far_p", "distance AS far_q")
    rest = materialise(joined(rest, done, ["lo", "hi"], "left_anti"))
    # members of both cells, as far as each pivot's distances let them link
    left = rest.where("p = lo").selectExpr("lo", "hi", "x", "far_p AS x_lo", "far_q AS x_hi")
    right = rest.where("p = hi").selectExpr("lo", "hi", "x AS y", "far_q AS y_lo", "far_p AS y_hi")
    last = left.join(right, ["lo", "hi"]).where(
        f"abs(x_lo - y_lo) <= {radius} + 1e-6 AND abs(x_hi - y_hi) <= {radius} + 1e-6"
    )
    last = materialise(last.selectExpr("x AS a", "y AS b").distinct())
    ended = distances(last, rows, outlines, size, str(radius)).where(linked(percent))
    return links.unionByName(ended.select("a", "b"))


def link_rows(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: `doc` (its id, `LAST` if null), `text_id` (a hash of its text), `n_shingles` of
    its set and `part`, which names the component of the set; null if it is empty."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    rows = docs.select(doc, F.xxhash64("text").alias("key"), "text")
    levels = counter_levels(rows, size)
    scanned = materialise(scan(rows, size, percent, levels))
    # equal sets: a text of the smallest document stands for them
    firsts = scanned.where("n > 0").groupBy("digest").agg(
        F.min_by("key", "doc").alias("key"), F.min("doc").alias("doc")
    )
    firsts = materialise(firsts)
    first = scanned.join(firsts, ["doc", "key", "digest"])
    distinct = first.select("doc", "key", "n", "digest", "prefix", "minima", "classes")
    # a digest has one `doc` and `key` here: the join's partitioning serves
    distinct = materialise(distinct.dropDuplicates(["doc", "key", "digest"]))
    known = materialise(scanned.select("doc", "key", "n", "digest"))
    discard(scanned)
    shared = materialise(repeated_values(distinct, "prefix").withColumnRenamed("value", "shingle"))
    postings = distinct.select("key", "n", F.posexplode("prefix").alias("at", "shingle"))
    # the shared shingles grow with the corpus: a shuffle join, at every size
    postings = postings.selectExpr("shingle", "key", "n", "n - at AS room")
    postings = materialise(postings.join(shared, "shingle", "left_semi"))
    candidates = materialise(postings.groupBy("key", "n").agg(F.count("*").alias("with_others")))
    alike = distinct.join(candidates, ["key", "n"])
    alike = materialise(
        alike.select("doc", "key", "n", "minima", "classes", (F.size("prefix") - F.col("with_others")).alias("own"))
    )
    discard(distinct, shared, candidates)
    outlines = alike.select("doc", "key", "n", "classes")
    assigned, links = cells(alike.drop("classes", "doc"), rows, outlines, size, percent)
    named = assigned.select("key", "cell")
    in_cells = joined(postings, materialise(named), "key", "left").withColumn("cell", F.coalesce("cell", "key"))
    before = len(made_here())
    met = materialise(region_pairs(in_cells, percent))
    keep_last(spark, before)
    discard(postings)
    pairs = apart(met, links)
    links = links.unionByName(cell_links(pairs, assigned, rows, outlines, size, percent))
    found = materialise(components(links))
    parts = joined(firsts.select("digest", "key"), found.withColumnRenamed("node", "key"), "key", "left")
    parts = materialise(parts.select("digest", F.coalesce("component", "key").alias("part")))
    out = joined(known, parts, "digest", "left")
    return out.selectExpr("doc", "key AS text_id", "n AS n_shingles", "part")


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: `doc_id`, `n_shingles` of its set, and `component_id`."""
    rows = materialise(link_rows(docs, size, percent).select("doc", "n_shingles", "part"))
    # the documents of a part hang on its smallest; documents in several parts join them
    heads = rows.where("part IS NOT NULL").groupBy("part").agg(
        F.min("doc").alias("head"), F.max("doc").alias("tail")
    )
    heads = materialise(heads.where("head < tail").select("part", "head"))
    links = joined(rows, heads, "part").where("doc <> head").selectExpr("doc AS a", "head AS b")
    found = materialise(components(links))
    out = joined(rows.select("doc", "n_shingles"), found.withColumnRenamed("node", "doc"), "doc", "left")
    out = out.withColumn("component", F.coalesce("component", "doc"))
    return out.selectExpr(
        f"nullif(doc, {LAST}L) AS doc_id", "n_shingles", f"nullif(component, {LAST}L) AS component_id"
    )
