"""Deterministic holdouts: whole creators, or single rows.

A unit (creator or row) is in the test side of a seed if its hash under that
seed is among the smallest ones. The cut-off hash is found by counting hash
prefixes, so no task ever sorts all units; applying the split is then a plain
column expression without a join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import content_key, count_where, rounded
from tallybook.spec import CatalogSpec

TEST_SIZE = 0.2
# The pre-declared seeds of the repeated evaluation.
SWEEP_SEEDS = [1, 7, 21, 42, 73, 101, 202, 314, 512, 999]
SEED = 42
# Hex digits counted: 65,536 prefixes, each with that share of the units.
PREFIX = 4
# Standard deviations around its expected place in which a cut is looked for first.
REACH = 8
# Marks that sort before and after all hashes.
BEFORE, AFTER = "", "~"
TOP_GROUPS = 10
GROUP = "group_id"
ROW = "row_key"
ROW_GROUP = "__row_"
# One bit per seed: set if the seed holds the unit out.
MASK = "test_mask"
# Seeds that share a mask; it takes at most 2**MASK_SEEDS values.
MASK_SEEDS = 10


def is_recognised(creator: Column, spec: CatalogSpec) -> Column:
    """The creator is named and the name means one creator."""
    known = creator.isNotNull()
    if spec.placeholder_creators:
        known = known & ~creator.isin(*spec.placeholder_creators)
    return known


def row_key(df: DataFrame, spec: CatalogSpec) -> Column:
    """Stable key of a row: from its identifying columns, or from all raw ones."""
    return content_key(list(spec.identity) or spec.raw_columns(df.columns))


def group_id(creator: Column, key: Column, spec: CatalogSpec) -> Column:
    """A named creator groups its rows; every other row is its own group."""
    alone = F.concat(F.lit(ROW_GROUP), key)
    return F.when(is_recognised(creator, spec), creator).otherwise(alone)


def with_groups(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    return df.withColumn(ROW, row_key(df, spec)).withColumn(
        GROUP, group_id(F.col(spec.creator), F.col(ROW), spec)
    )


def seeded_hash(seed: Column | int, unit: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), unit))


def split_cuts(
    units: DataFrame, unit: str, seeds: list[int], test_size: float = TEST_SIZE
) -> dict[int, str]:
    """Per seed the hash up to which a unit is in the test side.

    `units` has one row per unit. Exactly `ceil(test_size * n)` of them fall at
    or below the cut. Only one hash per seed comes to the driver.

    Hashes are spread evenly, so the cut is looked for near its expected place: one pass
    counts the hashes before and keeps those around it. Only if a seed's cut lies elsewhere,
    as it may if units repeat, hashes are counted by prefix, in two passes.
    """
    n = units.count()
    wanted = math.ceil(test_size * n)
    reach = REACH * math.sqrt(test_size * (1 - test_size) / max(n, 1))
    ends = ((test_size + by) * 16**PREFIX for by in (-reach, reach))
    first, last = (f"{min(max(int(v), 0), 16**PREFIX - 1):0{PREFIX}x}" for v in ends)
    prefix = F.coalesce("_prefix", F.lit(BEFORE))
    # hashes around the place; the others under a mark that sorts before or after them
    mark = F.when(prefix < first, F.lit(BEFORE)).when(prefix > last, F.lit(AFTER)).otherwise(F.col("_hash"))
    around = _hashed(units, unit, seeds).select("seed", mark.alias("_hash"))
    counted = around.groupBy("seed", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("seed").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0))
    reached = counted.withColumn("_upto", upto).where(F.col("_upto") >= wanted)
    found = reached.groupBy("seed").agg(F.min("_hash").alias("_hash")).collect()
    cuts = {r.seed: r["_hash"] for r in found if r["_hash"] not in (BEFORE, AFTER)}
    others = [r.seed for r in found if r.seed not in cuts]
    return cuts | (_cuts_by_prefix(units, unit, others, test_size) if others else {})


def _hashed(units: DataFrame, unit: str, seeds: list[int]) -> DataFrame:
    """`seed, _hash, _prefix` of every unit under every seed."""
    hashed = units.select(
        F.explode(F.array(*(F.lit(s) for s in seeds))).alias("seed"), F.col(unit).alias("_unit")
    ).select("seed", seeded_hash(F.col("seed"), F.col("_unit")).alias("_hash"))
    return hashed.withColumn("_prefix", F.substring("_hash", 1, PREFIX))


def _cuts_by_prefix(units: DataFrame, unit: str, seeds: list[int], test_size: float) -> dict[int, str]:
    """The cuts, wherever they are: by the prefix in which they lie."""
    hashed = _hashed(units, unit, seeds)
    by_seed = Window.partitionBy("seed")
    running = by_seed.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most 16**PREFIX rows per seed
    prefixes = (
        hashed.groupBy("seed", "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_wanted", F.ceil(F.lit(float(test_size)) * F.sum("_n").over(by_seed)))
    )
    holds = (F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted"))
    chosen = prefixes.where(holds).select(
        "seed", "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rank")
    )
    # one prefix per seed; equal hashes are counted before the sort
    inside = hashed.join(F.broadcast(chosen), ["seed", "_prefix"])
    upto = F.sum("_n").over(by_seed.orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0))
    counted = inside.groupBy("seed", "_rank", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    reached = counted.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank"))
    cut = reached.groupBy("seed").agg(F.min("_hash").alias("_hash"))
    return {r.seed: r["_hash"] for r in cut.collect()}


def grouped_cuts(
    frame: DataFrame, seeds: list[int], test_size: float = TEST_SIZE
) -> dict[int, str]:
    """Cuts that hold out a share of the groups, not of the rows."""
    return split_cuts(frame.select(GROUP).distinct(), GROUP, seeds, test_size)


def row_cuts(frame: DataFrame, seeds: list[int], test_size: float = TEST_SIZE) -> dict[int, str]:
    """Cuts that hold out a share of the rows."""
    return split_cuts(frame.select(ROW), ROW, seeds, test_size)


def mark_test(frame: DataFrame, unit: str, seed: int, cut: str) -> DataFrame:
    return frame.withColumn("is_test", seeded_hash(seed, F.col(unit)) <= F.lit(cut))


def folds(
    frame: DataFrame, unit: str, cuts: dict[int, str], only_test: bool = False
) -> DataFrame:
    """Every row once per seed, with `seed` and `is_test`.

    With `only_test` a row appears for those seeds only that hold it out: the others are
    never made.
    """
    pairs = F.array(
        *(F.struct(F.lit(s).alias("seed"), F.lit(c).alias("cut")) for s, c in sorted(cuts.items()))
    )
    if only_test:
        pairs = F.filter(pairs, lambda p: seeded_hash(p["seed"], F.col(unit)) <= p["cut"])
    exploded = frame.select("*", F.explode(pairs).alias("_fold"))
    return exploded.select(
        *frame.columns,
        "_fold.seed",
        (seeded_hash(F.col("_fold.seed"), F.col(unit)) <= F.col("_fold.cut")).alias("is_test"),
    )


def unit_mask(unit: Column, cuts: dict[int, str]) -> Column:
    """The sides of a unit under at most MASK_SEEDS seeds, in ascending order, as bits."""
    bits = (
        F.when(seeded_hash(seed, unit) <= F.lit(cut), F.lit(1 << i)).otherwise(F.lit(0))
        for i, (seed, cut) in enumerate(sorted(cuts.items()))
    )
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def mask_sides(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """`test_mask, seed, is_test` for every value a mask can take: at most 10 * 1,024 rows."""
    if len(seeds) > MASK_SEEDS:
        raise ValueError(f"at most {MASK_SEEDS} seeds share a mask")
    sides = F.array(
        *(
            F.struct(
                F.lit(seed).alias("seed"),
                (F.shiftright(MASK, i).bitwiseAND(F.lit(1)) == 1).alias("is_test"),
            )
            for i, seed in enumerate(sorted(seeds))
        )
    )
    masks = spark.range(1 << len(seeds)).select(F.col("id").cast("int").alias(MASK))
    return masks.select(MASK, F.inline(sides))


def by_seed(rows: DataFrame, seeds: list[int], is_test: bool | None = None) -> DataFrame:
    """Rows of each seed, or of one side of it, told by their mask alone."""
    sides = mask_sides(rows.sparkSession, seeds)
    if is_test is not None:
        sides = sides.where(F.col("is_test") == is_test).drop("is_test")
    return rows.join(F.broadcast(sides), MASK).drop(MASK)


def group_size_summary(frame: DataFrame) -> DataFrame:
    """How large the groups are, the ten largest among them.

    Quantiles run over the sizes weighted by their frequency: there are far
    fewer different sizes than groups.
    """
    sizes = frame.groupBy(GROUP).agg(F.count(F.lit(1)).alias("size"))
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    size, groups = F.col("size"), F.col("groups")
    facts = by_size.agg(
        F.sum("groups").alias("n_groups"),
        F.percentile(size, 0.5, groups).alias("median_group_size"),
        F.percentile(size, 0.9, groups).alias("p90_group_size"),
        F.percentile(size, 0.99, groups).alias("p99_group_size"),
        F.max("size").alias("largest"),
        F.sum(size * groups).alias("total_rows"),
    )
    largest = sizes.orderBy(F.desc("size")).limit(TOP_GROUPS).select("size")
    both = facts.unionByName(largest, allowMissingColumns=True)
    summary = both.agg(
        *(F.max(c).alias(c) for c in facts.columns),
        F.sort_array(F.collect_list("size"), asc=False).alias("ten_largest_group_sizes"),
    )
    pct = rounded(F.col("largest") / F.col("total_rows") * 100.0, 3)
    return summary.withColumn("largest_group_pct", pct).drop("largest")


def placeholder_census(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """Rows per placeholder label, labels without rows included."""
    counts = df.agg(
        *(
            count_where(F.col(spec.creator) == label).alias(f"n{i}")
            for i, label in enumerate(spec.placeholder_creators)
        )
    )
    lines = [
        F.struct(F.lit(label).alias("label"), F.col(f"n{i}").alias("n_rows"))
        for i, label in enumerate(spec.placeholder_creators)
    ]
    return counts.select(F.inline(F.array(*lines)))


def placeholder_search(df: DataFrame, spec: CatalogSpec) -> DataFrame:
    """`label, pattern, n_rows, is_listed` of every creator whose whole name, in lower case
    and without spaces around it, matches one of the patterns; the first that does counts.

    Rows are counted per creator first, so a pattern is tried once per label.
    """
    creators = df.groupBy(F.col(spec.creator).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    plain = F.lower(F.trim("label"))
    # a pattern without anchors still has to match the whole label
    matched = F.coalesce(
        F.lit(None).cast("string"),
        *(F.when(plain.rlike(f"^(?:{p})$"), F.lit(p)) for p in spec.placeholder_patterns),
    )
    listed = F.col("label").isin(*spec.placeholder_creators) if spec.placeholder_creators else F.lit(False)
    found = creators.withColumn("pattern", matched).where(F.col("pattern").isNotNull())
    return found.select("label", "pattern", "n_rows", listed.alias("is_listed")).orderBy(F.desc("n_rows"), "label")


def split_checks(frame: DataFrame, cuts: dict[int, str], test_size: float) -> DataFrame:
    """Per seed: exact size, both sides of every row and purity of the groups.

    Each row has its own mask. A group is summed once; under a seed it is pure if the bit
    is the same in all its rows.
    """
    checked = None
    for seeds in seed_batches(cuts):
        some = {seed: cuts[seed] for seed in seeds}
        groups = group_sides(frame, some)
        ones = {seed: F.sum(F.shiftright(MASK, i).bitwiseAND(F.lit(1))) for i, seed in enumerate(seeds)}
        rows = frame.select(GROUP, unit_mask(F.col(GROUP), some).alias(MASK)).agg(
            F.count(F.lit(1)).alias("n"), *(n.alias(f"t{seed}") for seed, n in ones.items())
        )
        lines = [
            F.struct(F.lit(s).alias("seed"), (F.col("n") - F.col(f"t{s}")).alias("n_train"), F.col(f"t{s}").alias("n_test"))
            for s in seeds
        ]
        sizes = rows.select(F.inline(F.array(*lines)))
        # groups meet their seeds by the bits all their rows share, and by those some have
        sides = mask_sides(frame.sparkSession, seeds)
        every = groups.groupBy("every", "some").agg(F.count(F.lit(1)).alias("groups"))
        every = every.join(F.broadcast(sides.withColumnsRenamed({MASK: "every", "is_test": "all_out"})), "every")
        some_out = sides.withColumnsRenamed({MASK: "some", "is_test": "any_out"})
        every = every.join(F.broadcast(some_out), ["some", "seed"])
        test_groups = F.sum(F.when(F.col("any_out"), F.col("groups")).otherwise(0))
        purity = every.groupBy("seed").agg(
            F.sum(F.when(F.col("any_out"), 0).otherwise(F.col("groups"))).alias("n_train_groups"),
            test_groups.alias("n_test_groups"),
            (test_groups == F.ceil(F.lit(float(test_size)) * F.sum("groups"))).alias("exact_size"),
            F.every(F.col("any_out") == F.col("all_out")).alias("groups_pure"),
        )
        both = sizes.join(F.broadcast(purity), "seed")
        checked = both if checked is None else checked.unionByName(both)
    return checked.orderBy("seed")


def seed_batches(seeds) -> list[list[int]]:
    """The seeds in ascending order, as many at once as share a mask."""
    ordered = sorted(set(seeds))
    return [ordered[i : i + MASK_SEEDS] for i in range(0, len(ordered), MASK_SEEDS)]


def group_sides(frame: DataFrame, cuts: dict[int, str]) -> DataFrame:
    """Per group the bits that all its rows' masks share (`every`) and that some have (`some`)."""
    marked = frame.select(GROUP, unit_mask(F.col(GROUP), cuts).alias(MASK))
    return marked.groupBy(GROUP).agg(F.bit_and(MASK).alias("every"), F.bit_or(MASK).alias("some"))


def group_overlap(frame: DataFrame, cuts: dict[int, str]) -> DataFrame:
    """`seed, group_id` of groups found on both sides of a split; none are expected."""
    found = None
    for seeds in seed_batches(cuts):
        differ = F.col("every").bitwiseXOR(F.col("some")).alias(MASK)
        split = group_sides(frame, {s: cuts[s] for s in seeds}).select(GROUP, differ).where(F.col(MASK) != 0)
        rows = by_seed(split, seeds, True).select("seed", GROUP)
        found = rows if found is None else found.unionByName(rows)
    return found
