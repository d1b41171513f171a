"""Derivations, duplicates, KPIs and segment queries on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tallybook.functions import expressions as X
from tallybook.operators import audit, dedup, derive, lookup, metrics, quantiles, segments
from tallybook.presets import MUSIC
from tallybook.session import materialise

SCHEMA = (
    "track string, artist_1 string, release_date int, release_decade int, album_type string, "
    "popularity_score int, artist_1_pop double, artist_1_genre_1 string, duration_ms bigint, tempo double"
)
ROWS = [
    ("a", "x", 2005, 2000, "album", 10, 0.1, None, 60_000, 0.0),
    ("a", "x", 2005, 2000, "album", 10, 0.1, None, 60_000, 0.0),
    ("a", "x", 2010, 2010, "single", 90, 0.9, "pop", 120_000, 100.0),
    ("b", None, None, 1990, "album", 33, 0.5, "rock", 180_000, None),
    ("b", None, 1899, None, "album", 66, 0.5, "rock", 180_000, 90.0),
    (None, "y", None, None, "album", None, None, "pop", None, 90.0),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def derived(raw):
    return derive.add_derived_fields(raw, MUSIC).cache()


def test_derived_fields_keep_every_row(raw, derived):
    assert derived.count() == raw.count()
    assert set(derived.columns) == set(raw.columns) | set(MUSIC.derived)


def test_flags_are_never_null(derived):
    flags = ["is_high_popularity", "has_primary_genre", "exact_duplicate_flag",
             "track_artist_duplicate_flag", "suspicious_release_date_flag", "tempo_quality_flag"]
    nulls = derived.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in flags)).first()
    assert set(nulls) == {0}


def test_every_copy_of_a_duplicate_is_flagged(derived):
    assert derived.where("exact_duplicate_flag").count() == 2
    # a missing artist is a key value like any other
    assert derived.where("track_artist_duplicate_flag").count() == 5


def test_period_falls_back_when_the_year_is_missing(derived):
    rows = derived.where("track = 'b'").select("release_year", "release_decade_clean").collect()
    assert sorted(map(tuple, rows), key=str) == [(1899, 1890), (None, 1990)]


def test_tiers_agree_with_flag_and_bounds(derived):
    rows = derived.select("popularity_score", "popularity_tier", "is_high_popularity").collect()
    tiers = {r.popularity_score: (r.popularity_tier, r.is_high_popularity) for r in rows}
    assert tiers == {10: ("low", False), 33: ("low", False), 66: ("moderate", False),
                     90: ("high", True), None: (None, False)}


def test_measure_quality_leaves_the_value(derived):
    rows = derived.select("tempo", "tempo_quality_flag").distinct().collect()
    assert {(r.tempo, r.tempo_quality_flag) for r in rows} == {
        (0.0, "zero_tempo"), (100.0, "ok"), (None, "missing"), (90.0, "ok")}


def test_primary_drops_copies_and_keeps_key_repeats(raw):
    primary = derive.primary_dataset(raw, MUSIC)
    assert primary.count() == 5
    assert primary.where("exact_duplicate_flag").count() == 0
    flagged = primary.where("track_artist_duplicate_flag").select("track").collect()
    assert sorted(r.track for r in flagged) == ["a", "a", "b", "b"]


def test_sensitivity_never_looks_at_the_score(raw):
    primary = derive.primary_dataset(raw, MUSIC)
    kept = {r.track: r for r in derive.sensitivity_dataset(primary, MUSIC).collect()}
    assert len(kept) == 3
    assert kept["a"].popularity_score == 10  # 2005 comes before 2010
    assert kept["b"].release_date == 1899  # a missing year comes last
    assert not any(r.track_artist_duplicate_flag for r in kept.values())


def test_dedup_statistics(raw):
    stats = dedup.exact_repeat_stats(raw, raw.columns).first()
    assert tuple(stats) == (2, 1, 6, 5)
    repeats = dedup.key_repeat_stats(raw, MUSIC.key).first()
    assert tuple(repeats) == (2, 5, 3)
    distinct = raw.dropDuplicates()
    assert tuple(dedup.exact_repeat_stats(distinct, raw.columns).first()) == (0, 0, 5, 5)


def test_selection_works_without_the_other_columns(spark):
    df = spark.createDataFrame(
        [("waltz", "quartet", year, kind, score)
         for year, kind, score in ((1987, "single", 71), (1974, "single", 64), (None, "album", 88),
                                   (1974, "album", 12), (1999, "album", 95))],
        "track string, artist_1 string, release_date int, album_type string, popularity_score int",
    )
    # of the earliest year the first segment stays, whatever the scores are
    assert [r.popularity_score for r in derive.sensitivity_dataset(df, MUSIC).collect()] == [12]


@pytest.mark.parametrize("small", [True, False])
def test_hot_copies_and_keys(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "is_small", lambda df: False)
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 1000, F.lit(None)).otherwise(F.col("id").cast("string")).alias("v"),
    )
    assert dedup.drop_exact_repeats(rows, ["k", "v"]).count() == 2001
    flagged = dedup.flag_exact_repeats(rows, ["k", "v"], "e")
    assert flagged.where("e").count() == 1000 and flagged.count() == 3000


@pytest.mark.parametrize("small", [True, False])
def test_key_values_reach_hot_cold_and_null_keys(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "is_small", lambda df: False)
    rows = spark.range(1000).select(
        "id",
        F.when(F.col("id") < 400, F.lit(None).cast("bigint")).otherwise(F.col("id") % 50).alias("k"),
    )
    values = lookup.key_counts(rows, ["k"])
    joined = lookup.join_key_values(rows, values, ["k"], "n", task_rows=10)
    assert joined.count() == 1000
    found = {r.k: r.n for r in joined.select("k", "n").distinct().collect()}
    assert found == {None: 400, **{k: 12 for k in range(50)}}


def test_metrics_fall_back_to_raw_columns(spark):
    rows = [("reel", "duo", 22, "folk", 0.31, 150_000), ("jig", "duo", 71, None, 0.62, 90_000),
            ("reel", "duo", 68, "folk", 0.31, 210_000), ("air", "trio", 35, None, 0.47, 150_000),
            ("hymn", "choir", 4, "sacred", 0.08, 390_000)]
    df = spark.createDataFrame(
        rows,
        "track string, artist_1 string, popularity_score int, artist_1_genre_1 string, "
        "artist_1_pop double, duration_ms bigint",
    )
    kpis = {r.metric: r.value for r in metrics.kpi_summary(df, MUSIC).collect()}
    assert set(kpis) == set(metrics.METRICS)
    assert kpis["high_share"] == pytest.approx(2 / 5)
    assert kpis["category_coverage"] == pytest.approx(3 / 5)
    assert kpis["repeat_share"] == pytest.approx(2 / 5)
    assert (kpis["row_count"], kpis["median_score"], kpis["mean_score"]) == (5, 35, 40)
    assert (kpis["median_size"], kpis["median_creator_score"]) == (2.5, 0.31)
    for name in metrics.METRICS:
        assert metrics.metric(df, MUSIC, name).first().value == kpis[name]


def test_kpi_comparison_guards_a_zero_base(spark):
    base = spark.createDataFrame([("m", 0.0), ("k", 4.0)], "metric string, value double")
    other = spark.createDataFrame([("m", 1.0), ("k", 3.0)], "metric string, value double")
    rows = {r.metric: r for r in metrics.compare_kpis(base, other, "a", "b").collect()}
    assert rows["m"].rel_delta_pct is None and rows["k"].rel_delta_pct == -25.0


def test_cutoff_year_is_literal(spark):
    df = spark.createDataFrame(
        [("single", year) for year in (1931, 1999, 2000, 2000, 2003, 2014, 2021, None, None, 2001)],
        "album_type string, release_year int",
    )
    row = segments.period_profile_by_segment(df, MUSIC).first()
    assert (row.n_rows, row.pct_up_to_cutoff) == (8, 50.0)


def test_ranks_share_ties_and_leave_gaps(spark):
    cells = [("2000", c) for c in "aabbcd"]
    df = spark.createDataFrame(cells, "release_decade_clean string, artist_1_genre_1 string")
    rows = segments.category_rank_by_period(df, MUSIC).collect()
    assert [r.category_rank for r in rows] == [1, 1, 3, 3]
    shares = segments.category_share_by_period(df, MUSIC).collect()
    assert {r.period_total for r in shares} == {6}
    assert sum(r.share_pct for r in shares) == pytest.approx(100, abs=0.05)


def test_top_categories_keep_ties(spark):
    df = spark.createDataFrame(
        [("low", c) for c in "aabbcc"] + [("high", "a")],
        "popularity_tier string, artist_1_genre_1 string",
    )
    rows = segments.top_categories_by_tier(df, MUSIC, top=1).collect()
    assert [(r.popularity_tier, r.artist_1_genre_1) for r in rows] == [
        ("low", "a"), ("low", "b"), ("low", "c"), ("high", "a")]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("kind", ["copies", "wide", "signs"])
def test_quantiles_agree_with_percentile(spark, by, kind):
    value = {
        "copies": F.when(F.col("id") < 700, F.lit(5.25)).otherwise(F.col("id") * F.col("id") / 7),
        # every exponent of a double, of both signs
        "wide": F.pow(F.lit(-2.0), F.col("id") - 1050),
        "signs": F.when(F.col("id") % 5 == 0, F.lit(-0.0)).otherwise((F.col("id") % 9) - 4.0),
    }[kind]
    df = spark.range(2070).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("b").alias("g"),
        F.when(F.col("id") != 1500, value).alias("v"),
    )
    probs = {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = quantiles.exact_quantiles(df, "v", probs, by).collect()
    wanted = df.groupBy(*by).agg(
        F.count("v").alias("n"), *(F.percentile("v", p).alias(k) for k, p in probs.items())
    )
    key = lambda r: str(r[0]) if by else ""
    for got, want in zip(sorted(found, key=key), sorted(wanted.collect(), key=key), strict=True):
        assert got.n == want.n
        assert [got[k] for k in probs] == pytest.approx([want[k] for k in probs])


def test_quantiles_of_overlapping_groups(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("mask"), (F.col("id") * 37 % 101 - 50.5).alias("v"))

    def expand(counts):
        sides = F.expr("filter(array(0, 1), b -> shiftright(mask, b) % 2 = 0)")
        return counts.withColumn("bit", F.explode(sides))

    found = quantiles.exact_quantiles(df, "v", {"q": 0.5}, ["mask"], expand, ["bit"])
    for bit, masks in ((0, [0, 2]), (1, [0, 1])):
        want = df.where(F.col("mask").isin(masks)).agg(F.percentile("v", 0.5), F.count("v")).first()
        got = found.where(F.col("bit") == bit).first()
        assert (got.q, got.n) == (want[0], want[1])


def test_quantiles_of_no_values(spark):
    empty = spark.createDataFrame([(None, "a")], "v double, g string")
    assert quantiles.exact_quantiles(empty, "v", {"q": 0.5}).collect() == [(0, None)]
    assert quantiles.exact_quantiles(empty, "v", {"q": 0.5}, ["g"]).collect() == []


def test_expressions(spark):
    row = spark.range(1).select(
        X.rounded(F.lit(2.345), 2).alias("r"),
        X.clip(F.lit(None).cast("double"), 0.0, 100.0).alias("null"),
        F.transform(
            F.array(*(F.lit(v) for v in (-0.5, 73.25, 100.5))), lambda v: X.clip(v, 0.0, 100.0)
        ).alias("clip"),
        F.transform(
            F.array(*(F.lit(v) for v in (0, 1, 3, 5, 6, 20, 21, 100, 101))), X.frequency_bucket
        ).alias("buckets"),
        X.bin_index(F.lit(100), 0, 2, 50).alias("top"),
    ).first()
    assert row.null is None and row.clip == [0.0, 73.25, 100.0] and row.top == 49
    assert row.buckets == [
        None, "1", "3-5", "3-5", "6-20", "6-20", "21-100", "21-100", "100+"]


def test_rounding_leaves_what_has_no_digits(spark):
    values = [1.5e14, 9.3e18, float("inf"), float("-inf"), float("nan"), None, 2.675]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in rows.select(X.rounded(F.col("v"), 6)).collect()]
    assert found[:4] == values[:4] and found[4] != found[4] and found[5:] == [None, 2.675]


def test_histogram_has_its_empty_bins(spark):
    rows = spark.createDataFrame([(3,), (3,), (18,)], "v int")
    found = audit.histogram(rows, "v", 0, 20, 10).collect()
    assert [(r.bin, r.n) for r in found if r.n] == [(1, 2), (9, 1)] and len(found) == 10


def test_remaining_repeats_are_counted_on_the_rows(raw):
    primary = derive.primary_dataset(raw, MUSIC)
    assert audit.exact_repeats_left(primary, MUSIC).first()[0] == 0
    again = primary.unionByName(primary.where("popularity_score = 90"))
    assert audit.exact_repeats_left(again, MUSIC).first()[0] == 2


def test_many_heavy_keys_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    rows = spark.range(40_000).select((F.col("id") % 2000).alias("k"))
    values = lookup.key_counts(rows, ["k"]).withColumn("v", -F.col("k"))
    joined = lookup.join_key_values(rows, values, ["k"], "n", task_rows=7)
    assert joined.count() == 40_000 and joined.where("v <> -k OR n <> 20").count() == 0


def test_skewness_is_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 20)], "v double")
    # value of the adjusted Fisher-Pearson coefficient
    n, xs = 5, [1, 2, 3, 4, 20]
    m = sum(xs) / n
    m2, m3 = sum((x - m) ** 2 for x in xs) / n, sum((x - m) ** 3 for x in xs) / n
    expected = m3 / m2**1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
    assert df.agg(X.sample_skewness(F.col("v"))).first()[0] == pytest.approx(expected)
    assert df.limit(2).agg(X.sample_skewness(F.col("v"))).first()[0] is None


def test_audit_of_bands_and_missing_values(raw):
    missing = {r.column_name: r.n_missing for r in audit.missingness(raw).collect()}
    assert missing["release_date"] == 2 and missing["album_type"] == 0
    banded = raw.withColumn("popularity", F.when(F.col("popularity_score") <= 33, "low").otherwise("up"))
    assert all(r.is_disjoint for r in audit.band_recovery(banded, MUSIC).collect())
    crossed = raw.withColumn("popularity", F.when(F.col("popularity_score") == 33, "x").otherwise("y"))
    assert not all(r.is_disjoint for r in audit.band_recovery(crossed, MUSIC).collect())


@pytest.mark.parametrize("small", [True, False])
def test_rows_with_a_key_of_their_own_stay(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "is_small", lambda df: False)
    rows = spark.range(4000).select(
        "id",
        F.when(F.col("id") % 500 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"),
        F.lit("x" * 50).alias("v"),
    )
    alone, shared = dedup.split_by_key(rows, ["k"])
    assert {r.id for r in shared.collect()} == set(range(0, 4000, 500))
    assert {r.id for r in alone.collect()} == set(range(4000)) - set(range(0, 4000, 500))
    assert alone.columns == shared.columns == rows.columns
    flagged = dedup.flag_key_repeats(rows, ["k"], "again")
    assert flagged.where("again").count() == 8 and flagged.count() == 4000


def test_full_filter_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    monkeypatch.setattr(lookup, "FILTER_BYTES", lookup.CHUNK_BITS // 8)
    monkeypatch.setattr(lookup, "KEY_BITS", 100)
    rows = spark.range(60_000).select((F.col("id") % 40_000).alias("k"))
    flagged = dedup.flag_key_repeats(rows, ["k"], "again")
    wrong = flagged.where(F.col("again") != (F.col("k") < 20_000)).count()
    assert flagged.count() == 60_000 and wrong == 0


def moved_rows(spark, name, make):
    """Rows that the exchanges of the final plan of `make()` wrote."""
    df = make()
    df.write.format("noop").mode("overwrite").save()
    seen, rows = set(), 0
    plans = [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while plans:
        plan = plans.pop()
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
            continue
        if kind == "Exchange" and plan.id() not in seen:
            seen.add(plan.id())
            metric = plan.metrics().get(name)
            rows += metric.get().value() if metric.isDefined() else 0
        children = plan.children() if "QueryStage" not in kind else None
        if children is None:
            plans.append(plan.plan())
        else:
            plans += [children.apply(i) for i in range(children.size())]
    return rows


def test_few_repeats_move_few_rows(spark, monkeypatch):
    monkeypatch.setattr(lookup, "is_small", lambda df: False)
    rows = [(f"t{i // 2 if i < 100 else i}", "x", 2000 + i % 9, 2000, "album", i % 100, 0.1, None, 60_000, 0.0)
            for i in range(5000)]
    rows += rows[:10]
    raw = materialise(spark.createDataFrame(rows, SCHEMA))
    for make, n in (
        (lambda: derive.add_derived_fields(raw, MUSIC), 5010),
        (lambda: derive.primary_dataset(raw, MUSIC), 5000),
        (lambda: derive.sensitivity_dataset(raw, MUSIC), 4950),
    ):
        assert make().count() == n
        assert moved_rows(spark, "shuffleRecordsWritten", make) < 1500
