"""Splits, fits and diagnostics, checked against NumPy and Spark ML."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tallybook.operators import evaluate, linear, splits
from tallybook.operators.frame import (
    LeakageError,
    TARGET,
    check_features,
    frame_notes,
    modeling_frame,
)
from tallybook.plans import modeling
from tallybook.presets import MUSIC, MUSIC_MODEL_A, MUSIC_MODEL_B
from tallybook.spec import ModelSpec

LEVELS = ModelSpec("levels", ("x1", "x2"), {"c": "r", "d": "1"})


@pytest.fixture(scope="module")
def rows(spark):
    """300 rows with gaps, a test-only level and two categoricals."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(300):
        is_test = i % 4 == 0
        c = "only_test" if i == 8 else str(rng.choice(["r", "s", "t"]))
        d = str(rng.integers(1, 4))
        x1 = None if rng.random() < 0.2 else float(rng.normal(1000, 3))
        x2 = float(rng.exponential(2))
        y = 3 + 0.5 * (x1 or 1000) + x2 + 4 * (c == "s") - 2 * (d == "3") + float(rng.normal())
        data.append((7, is_test, y, x1, x2, c, d, f"g{i % 40}"))
    return spark.createDataFrame(
        data,
        "seed int, is_test boolean, target double, x1 double, x2 double, c string, d string, group_id string",
    ).cache()


def design(pdf, fit):
    """The standardised design with constant, built apart from the library."""
    columns = [np.ones(len(pdf))]
    for c in fit.model.numeric:
        columns.append(((pdf[c].fillna(fit.fills[c]) - fit.means[c]) / fit.sds[c]).to_numpy())
    for term in fit.terms:
        if term.kind == "level":
            columns.append((pdf[term.feature] == term.level).to_numpy().astype(float))
    return np.column_stack(columns)


def test_fit_equals_least_squares_on_training_rows(rows):
    fit = linear.fit_models(rows, [LEVELS])[0]
    pdf = rows.where("NOT is_test").toPandas()
    filled = pdf.x1.fillna(pdf.x1.median())
    assert fit.fills["x1"] == pdf.x1.median()
    assert fit.means["x1"] == pytest.approx(filled.mean())
    assert fit.sds["x1"] == pytest.approx(filled.std(ddof=0))
    expected = np.linalg.lstsq(design(pdf, fit), pdf.target.to_numpy(), rcond=None)[0]
    assert [fit.intercept, *fit.coefficients] == pytest.approx(expected.tolist())


def test_fit_equals_spark_ml(spark, rows):
    plain = ModelSpec("plain", ("x2",), {"c": "r"})
    fit = linear.fit_models(rows, [plain])[0]
    train = rows.where("NOT is_test").withColumns(
        {
            "z": (F.col("x2") - fit.means["x2"]) / fit.sds["x2"],
            "s": (F.col("c") == "s").cast("double"),
            "t": (F.col("c") == "t").cast("double"),
        }
    )
    vectors = VectorAssembler(inputCols=["z", "s", "t"], outputCol="features").transform(train)
    ml = LinearRegression(labelCol="target", solver="normal", standardization=False).fit(vectors)
    assert fit.coefficients == pytest.approx(list(ml.coefficients))
    assert fit.intercept == pytest.approx(ml.intercept)
    summary = modeling.ols_summary(spark, fit)
    lines = {r.term: r for r in summary.coefficients.collect()}
    names = ["x2", "c=s", "c=t", "const"]
    assert [lines[n].std_error for n in names] == pytest.approx(
        list(ml.summary.coefficientStandardErrors)
    )
    assert [lines[n].p_value for n in names] == pytest.approx(list(ml.summary.pValues), abs=1e-9)
    facts = {r.statistic: r.value for r in summary.statistics.collect()}
    assert facts["r2"] == pytest.approx(ml.summary.r2)
    assert facts["adj_r2"] == pytest.approx(ml.summary.r2adj)
    x = design(train.toPandas(), fit)
    singular = np.linalg.svd(x, compute_uv=False)
    assert facts["condition_number"] == pytest.approx(singular[0] / singular[-1])


def test_wide_route_equals_normal_equations(rows, monkeypatch):
    frame = rows.drop("seed", "is_test")
    models = [LEVELS, ModelSpec("small", ("x2",), {"d": "1"}), ModelSpec("none", ("x1",))]
    near = modeling.hold_out(frame, models, [1, 2, 3])
    one = linear.fit_models(rows, models)
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    far = modeling.hold_out(frame, models, [1, 2, 3])
    for a, b in zip([*near.fits, *one], [*far.fits, *linear.fit_models(rows, models)], strict=True):
        assert (a.seed, a.name, a.n, a.feature_names) == (b.seed, b.name, b.n, b.feature_names)
        assert b.intercept == pytest.approx(a.intercept, rel=1e-7)
        assert b.coefficients == pytest.approx(a.coefficients, rel=1e-6, abs=1e-6)
    with pytest.raises(linear.DesignError, match="too wide"):
        modeling.ols_summary(rows.sparkSession, far.fits[1])


def test_wide_route_on_aliased_columns_predicts_the_same(rows, monkeypatch):
    doubled = rows.withColumns({"x3": F.col("x2") * 2, "k": F.lit(4.0), "e": F.col("c")})
    model = ModelSpec("m", ("x2", "x3", "k"), {"c": "r", "e": "r"})
    near = linear.predict(rows.where("is_test").withColumns({"x3": F.col("x2") * 2, "k": F.lit(4.0), "e": F.col("c")}),
                          linear.fit_models(doubled, [model])).agg(F.sum("prediction")).first()[0]
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    far = linear.predict(doubled.where("is_test"), linear.fit_models(doubled, [model]))
    assert far.agg(F.sum("prediction")).first()[0] == pytest.approx(near, rel=1e-8)


def test_two_thousand_levels_twice_under_ten_seeds(spark):
    number = F.xxhash64("id")
    frame = spark.range(0, 60_000, 1, 4).select(
        F.concat(F.lit("a"), F.pmod(number, F.lit(2000))).alias("a"),
        F.concat(F.lit("b"), F.pmod(F.shiftright(number, 20), F.lit(2000))).alias("b"),
        F.pmod(F.shiftright(number, 40), F.lit(97)).cast("double").alias("x"),
        F.col("id").cast("string").alias("row_key"),
        (F.pmod(number, F.lit(13)) + F.pmod(F.shiftright(number, 30), F.lit(11))).cast("double").alias("target"),
    )
    model = ModelSpec("wide", ("x",), {"a": "a0", "b": "b0"})
    held = modeling.hold_out(frame, [model], splits.SWEEP_SEEDS, unit=splits.ROW, baseline=False)
    assert len(held.fits) == 10 and all(f.gram is None and len(f.terms) == 4001 for f in held.fits)
    train = linear.predict(held.rows.where("NOT is_test AND seed IN (7, 512)"), held.fits)
    for c in ("a", "b"):
        means = train.groupBy("seed", c).agg(F.avg(F.col("target") - F.col("prediction")).alias("r"))
        assert means.agg(F.max(F.abs("r"))).first()[0] < 1e-6


def test_more_seeds_than_a_mask_holds(rows):
    frame = rows.drop("seed", "is_test")
    held = modeling.hold_out(frame, [LEVELS], list(range(1, 13)), baseline=False)
    alone = modeling.hold_out(frame, [LEVELS], [12], baseline=False)
    assert [f.seed for f in held.fits] == list(range(1, 13))
    assert held.fits[-1].coefficients == pytest.approx(alone.fits[0].coefficients)
    assert held.composition.count() == 12 and held.metrics().count() == 12


def test_vocabulary_is_from_training_rows_and_unseen_levels_add_nothing(rows):
    fit = linear.fit_models(rows, [LEVELS])[0]
    assert "c=only_test" not in fit.feature_names
    assert fit.feature_names == ["x1", "x2", "c=s", "c=t", "d=2", "d=3"]
    test = rows.where("is_test")
    predicted = linear.predict(test, [fit]).toPandas()
    assert predicted.prediction.notna().all() and len(predicted) == 75
    pdf = predicted[list(rows.columns)]
    expected = design(pdf, fit) @ np.array([fit.intercept, *fit.coefficients])
    assert predicted.prediction.to_numpy() == pytest.approx(expected)


def test_absent_reference_is_an_error(rows):
    with pytest.raises(linear.DesignError, match="reference level"):
        linear.fit_models(rows, [ModelSpec("m", ("x2",), {"c": "nowhere"})])


def test_constant_and_aliased_columns(spark, rows):
    doubled = rows.withColumn("x3", F.col("x2") * 2).withColumn("k", F.lit(4.0))
    fit = linear.fit_models(doubled, [ModelSpec("m", ("x2", "x3", "k"))])[0]
    assert fit.sds["k"] == 1.0 and fit.coefficients[2] == pytest.approx(0)
    # least norm: both copies carry the same standardised weight
    assert fit.coefficients[0] == pytest.approx(fit.coefficients[1])
    with pytest.raises(linear.DesignError, match="aliased"):
        modeling.ols_summary(spark, fit)


def test_coefficient_tables(spark, rows):
    fits = linear.fit_models(rows, [LEVELS])
    numeric = linear.numeric_coefficients(spark, fits).collect()
    assert [r.coef for r in numeric] == sorted(r.coef for r in numeric) and len(numeric) == 2
    every = linear.level_coefficients(spark, fits).collect()
    assert {(r.feature, r.level): r.coef for r in every if r.kind == "reference"} == {
        ("c", "r"): 0.0,
        ("d", "1"): 0.0,
    }
    ends = linear.level_coefficients(spark, fits, top=1).collect()
    coefs = [r.coef for r in every if r.kind == "level"]
    assert {r.coef for r in ends if r.kind == "level"} == {max(coefs), min(coefs)}


def test_compared_splits_and_datasets(rows):
    frame = rows.drop("seed", "is_test").withColumn("row_key", F.md5(F.col("x2").cast("string")))
    model = ModelSpec("model_a", ("x1", "x2"), {"c": "r"})
    row = modeling.compare_splits(frame, [model], [1, 2, 3], seed=1).first()
    assert row.model == "model_a" and None not in tuple(row)


def test_many_seeds_fit_like_one(rows):
    frame = rows.drop("seed", "is_test")
    held = modeling.hold_out(frame, [LEVELS], [1, 2, 3])
    alone = modeling.hold_out(frame, [LEVELS], [2])
    many = next(f for f in held.fits if f.seed == 2 and f.name == "levels")
    one = next(f for f in alone.fits if f.name == "levels")
    assert many.coefficients == pytest.approx(one.coefficients)
    base = next(f for f in held.fits if f.seed == 2 and f.name == "baseline")
    train = held.rows.where("seed = 2 AND NOT is_test").agg(F.avg(TARGET)).first()[0]
    assert base.intercept == pytest.approx(train) and base.coefficients == []


def test_sweep_has_all_metrics_and_its_summary_the_range(rows):
    frame = rows.drop("seed", "is_test")
    model = ModelSpec("model_a", ("x1", "x2"), {"c": "r"})
    swept = modeling.sweep(frame, [model], [1, 2, 3]).toPandas()
    assert len(swept) == 3 and swept.notna().all().all()
    assert (swept.n_train + swept.n_test == 300).all()
    assert (swept.n_test_groups == 8).all() and (swept.n_train_groups == 32).all()
    spark = frame.sparkSession
    summary = modeling.summarise_sweep(spark.createDataFrame(swept), [model]).collect()
    values = {(r.subject, r.fact): r.value for r in summary}
    assert values["model_a", "median_r2"] == pytest.approx(swept.model_a_r2.median())
    assert values["model_a", "max_r2"] == pytest.approx(swept.model_a_r2.max())
    assert values["split_composition", "n_test_min"] == swept.n_test.min()


# --- groups and splits ----------------------------------------------------


def _groups(spark, creators):
    df = spark.createDataFrame(list(enumerate(creators)), "i int, artist_1 string")
    return splits.with_groups(df, MUSIC)


def test_unnamed_and_placeholder_creators_stand_alone(spark):
    creators = [None, None, "Real", "Real", "Various Artists", "Various Artists", "Unknown"]
    ids = [r.group_id for r in _groups(spark, creators).orderBy("i").collect()]
    assert ids[2] == ids[3] == "Real" and len(set(ids)) == 6


@pytest.fixture(scope="module")
def grouped(spark):
    creators = [f"c{i % 97}" for i in range(1000)] + ["Various Artists"] * 500 + [None] * 3
    return _groups(spark, creators).cache()


def test_grouped_split_is_exact_pure_and_complete(grouped):
    cuts = splits.grouped_cuts(grouped, [1, 2])
    n = grouped.select("group_id").distinct().count()
    assert n == 600
    for row in splits.split_checks(grouped, cuts, 0.2).collect():
        assert row.n_test_groups == math.ceil(0.2 * n) and row.exact_size and row.groups_pure
        assert row.n_train + row.n_test == 1503
    assert splits.group_overlap(grouped, cuts).count() == 0


def test_splits_repeat_per_seed_and_differ_between_seeds(grouped):
    first, again = (splits.row_cuts(grouped, [5, 6]) for _ in range(2))
    assert first == again and first[5] != first[6]
    sides = {s: splits.mark_test(grouped, "row_key", s, first[s]) for s in (5, 6)}
    tests = {s: {r.row_key for r in df.where("is_test").collect()} for s, df in sides.items()}
    assert len(tests[5]) == len(tests[6]) == math.ceil(0.2 * 1503)
    assert tests[5] != tests[6]
    shuffled = grouped.repartition(7).orderBy(F.rand(3))
    assert splits.row_cuts(shuffled, [5, 6]) == first


def test_group_sizes_and_census(spark, grouped):
    row = splits.group_size_summary(grouped).first()
    assert (row.n_groups, row.total_rows, row.median_group_size) == (600, 1503, 1.0)
    assert row.ten_largest_group_sizes == [11] * 10
    census = {r.label: r.n_rows for r in splits.placeholder_census(grouped, MUSIC).collect()}
    assert census["Various Artists"] == 500 and census["Original Cast"] == 0


# --- modeling sample ------------------------------------------------------


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        [
            ("X", 10, "0low", "low", False, 2005, "2000", 0.0, -5.0, 0.5, 3.0, "album", None, 0.2),
            ("Various Artists", 90, "2high", "high", True, 2012, "2010", 99.0, -6.0, 0.6, 4.0, "single", "pop", 0.0),
            (None, 50, "1moderate", "moderate", False, None, None, 98.0, -7.0, 0.7, 5.0, "album", "pop", 0.4),
        ],
        "artist_1 string, popularity_score int, popularity string, popularity_tier string, "
        "is_high_popularity boolean, release_date int, release_decade_clean string, tempo double, "
        "loudness double, valence double, track_duration_minutes double, album_type string, "
        "artist_1_genre_1 string, artist_1_pop double",
    )


def test_sample_recodes_and_accounts_for_rows(catalog):
    frame = modeling_frame(catalog, MUSIC, [MUSIC_MODEL_A, MUSIC_MODEL_B])
    kept = {r.creator: r for r in frame.collect()}
    assert set(kept) == {"X", "Various Artists"}
    assert kept["X"].tempo is None and kept["X"].artist_1_genre_1 == "Unknown"
    notes = frame_notes(catalog, MUSIC).first()
    assert tuple(notes) == (3, 1, 1, 1, 2, 0, 0, 1)


def test_nothing_derived_from_the_target_is_a_feature(catalog):
    frame = modeling_frame(catalog, MUSIC, [MUSIC_MODEL_B])
    assert not set(frame.columns) & {"popularity", "popularity_tier", "is_high_popularity", "popularity_score"}
    for leaked in ("popularity", "popularity_tier", "is_high_popularity", "popularity_score"):
        with pytest.raises(LeakageError):
            check_features(MUSIC, [leaked])


# --- diagnostics ----------------------------------------------------------


def _predictions(spark, pairs, model="m"):
    data = [(model, None if y is None else float(y), float(p)) for y, p in pairs]
    return spark.createDataFrame(data, "model string, target double, prediction double")


def test_accuracy_of_known_cases(spark):
    def score(pairs):
        return evaluate.accuracy(_predictions(spark, pairs)).first()

    assert score([(1, 1), (2, 2), (3, 3)]).r2 == 1.0
    assert score([(1, 2), (2, 2), (3, 2)]).r2 == pytest.approx(0.0)
    # errors 3, -4, 0, 1: their sizes add to 8, their squares to 26
    row = score([(7, 4), (30, 34), (12, 12), (41, 40)])
    assert row.mae == 2.0 and row.rmse == pytest.approx(6.5**0.5)
    assert score([(4, 4), (4, 4)]).r2 == 1.0 and score([(4, 3), (4, 4)]).r2 == 0.0
    # rows without a target are not evaluated
    assert score([(7, 4), (None, 99), (30, 34)]).n == 2


def test_bounds_count_strictly_outside(spark):
    # both edges count as inside
    values = [*(0.25 * i for i in range(13)), 0.0, 100.0, -3.5, 104.0, 233.0]
    row = evaluate.bounds(_predictions(spark, [(1, v) for v in values]), MUSIC).first()
    assert (row.n, row.n_below_0, row.n_above_100) == (18, 1, 2)
    assert (row.min_prediction, row.max_prediction) == (-3.5, 233)
    assert (row.pct_below_0, row.pct_above_100) == (5.556, 11.111)
    clipped = evaluate.clipped(_predictions(spark, [(1, -3.5), (1, 61.5), (1, 104)]), MUSIC)
    assert sorted(r.prediction for r in clipped.collect()) == [0, 61.5, 100]


def test_buckets_use_the_whole_frame_and_skip_placeholders(spark):
    frame = spark.createDataFrame(
        [("a",)] * 4 + [("b",)] + [("Various Artists",)] * 9 + [(None,)], "creator string"
    )
    predictions = spark.createDataFrame(
        [("m", "a", 1.0, 2.0), ("m", "a", 3.0, 2.0), ("m", "b", 5.0, 4.0),
         ("m", "Various Artists", 9.0, 0.0), ("m", None, 9.0, 0.0)],
        "model string, creator string, target double, prediction double",
    )
    found = {r.bucket: r for r in evaluate.creator_buckets(predictions, frame, MUSIC).collect()}
    assert set(found) == {"1", "3-5"}
    assert (found["3-5"].n, found["3-5"].mae) == (2, 1.0)
    assert found["3-5"].r2 == pytest.approx(0.0)
    left_out = evaluate.bucket_exclusions(predictions, MUSIC).first()
    assert (left_out.n_excluded, left_out.pct_excluded) == (2, 40.0)


def test_density_counts_every_row(spark):
    pairs = [(0, -3), (100, 120), (50, 50), (49.9, 50.1)]
    cells = evaluate.density(_predictions(spark, pairs), MUSIC).collect()
    assert sum(c.n for c in cells) == 4
    assert {(c.bin_target, c.bin_prediction) for c in cells} == {(0, 0), (39, 39), (20, 20), (19, 20)}


def test_wide_sums_hold_no_features_per_level(rows, monkeypatch):
    made = []
    sums = linear._training_sums
    monkeypatch.setattr(linear, "_training_sums", lambda *a: made.append(sums(*a)) or made[-1])
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    frame = rows.drop("seed", "is_test")
    held = modeling.hold_out(frame, [LEVELS], [1, 2, 3], baseline=False)
    kept = [s.levels for s in made[0].values()]
    # past the first level no array is kept, and seeds share their keys
    assert all(sum(z is not None for _, _, z in levels.values()) <= 1 for levels in kept)
    assert len({id(key) for levels in kept for key in levels}) == len({key for levels in kept for key in levels})
    assert held.predictions.where("prediction IS NULL").count() == 0


def test_a_feature_of_one_level_has_no_contrasts(rows):
    one = rows.withColumn("f", F.lit("only"))
    fits = linear.fit_models(one, [ModelSpec("m", ("x1",), {"f": "only"})])
    assert linear.predict(one, fits).where("prediction IS NULL AND x1 IS NOT NULL").count() == 0


def test_a_fit_without_levels_hides_none_of_later_fits(spark):
    def fit(name, levels):
        terms = [linear.Term("level", "c", level, coef) for level, coef in levels.items()]
        model = ModelSpec(name, (), {"c": "r"} if levels else {})
        return linear.Fit(7, model, 1, 10.0, terms, {}, {}, {}, None, None, 0.0)

    fits = [fit("a", {"s": 1.0}), fit("none", {}), fit("b", {"s": 2.0, "t": 3.0})]
    rows = spark.createDataFrame([(7, "r"), (7, "s"), (7, "t")], "seed int, c string")
    found = {(r.model, r.c): r.prediction for r in linear.predict(rows, fits).collect()}
    assert found == {("a", "r"): 10, ("a", "s"): 11, ("a", "t"): 10, ("none", "r"): 10, ("none", "s"): 10,
                     ("none", "t"): 10, ("b", "r"): 10, ("b", "s"): 12, ("b", "t"): 13}


def test_the_driver_holds_no_level_of_a_wide_design(rows, monkeypatch):
    made = []
    term = linear.Term
    monkeypatch.setattr(linear, "Term", lambda *a: made.append(a) or term(*a))
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    frame = rows.drop("seed", "is_test")
    held = modeling.hold_out(frame, [LEVELS], [1, 2, 3], baseline=False)
    train = linear.predict(held.rows.where("NOT is_test"), held.fits)
    assert train.where("prediction IS NULL").count() == 0
    assert {a[0] for a in made} == {"numeric", "reference"}
    # levels that rows bring along give what looking them up anew does
    plain = held.rows.select("seed", "is_test", *frame.columns)
    again = linear.predict(plain.where("NOT is_test"), held.fits)
    assert again.columns == [*plain.columns, "model", "prediction"] and set(train.columns) == set(again.columns)
    totals = [df.agg(F.sum("prediction"), F.sum(F.col("prediction") ** 2)).first() for df in (train, again)]
    assert tuple(totals[0]) == pytest.approx(tuple(totals[1]))
    with pytest.raises(Exception, match="not as it was"):
        linear.predict(held.rows.withColumn("c", F.lit("s")), held.fits).agg(F.sum("prediction")).collect()


@pytest.mark.parametrize("cells", [1, 95])
def test_levels_too_heavy_to_eliminate_fit_the_same(rows, monkeypatch, cells):
    near = linear.fit_models(rows, [LEVELS, ModelSpec("other", ("x2",), {"c": "s"})])
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    monkeypatch.setattr(linear.wide, "BLOCK_CELLS", cells)
    far = linear.fit_models(rows, [LEVELS, ModelSpec("other", ("x2",), {"c": "s"})])
    for a, b in zip(near, far, strict=True):
        assert a.feature_names == b.feature_names
        assert [b.intercept, *b.coefficients] == pytest.approx([a.intercept, *a.coefficients], rel=1e-6, abs=1e-6)


def test_wide_fits_are_saved_and_listed_like_narrow_ones(spark, rows, monkeypatch, tmp_path):
    models = [LEVELS, ModelSpec("small", ("x2",), {"d": "1"}), ModelSpec("none", ("x1",))]
    near = linear.fit_models(rows, models)
    listed = [tuple(r) for r in linear.level_coefficients(spark, near, top=1).collect()]
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    far = linear.fit_models(rows, models)
    found = [tuple(r) for r in linear.level_coefficients(spark, far, top=1).collect()]
    assert [r[:-1] for r in found] == [r[:-1] for r in listed]
    assert [r[-1] for r in found] == pytest.approx([r[-1] for r in listed], rel=1e-6, abs=1e-6)
    linear.save_fits(spark, far, str(tmp_path / "fits"))
    loaded = sorted(linear.load_fits(spark, str(tmp_path / "fits")), key=lambda f: [m.name for m in models].index(f.name))
    for a, b in zip(near, loaded, strict=True):
        assert (a.seed, a.name, a.n, a.feature_names) == (b.seed, b.name, b.n, b.feature_names)
        assert b.coefficients == pytest.approx(a.coefficients, rel=1e-6, abs=1e-6)
    test = rows.where("is_test")
    sums = [linear.predict(test, fits).agg(F.sum("prediction")).first()[0] for fits in (near, far, loaded)]
    assert sums[1:] == pytest.approx([sums[0]] * 2, rel=1e-7)


def test_an_absent_reference_of_a_wide_design_is_an_error(rows, monkeypatch):
    monkeypatch.setattr(linear, "GRAM_CELLS", 0)
    for reference in ({"c": "only_test", "d": "1"}, {"c": "r", "d": "nowhere"}):
        with pytest.raises(linear.DesignError, match="reference level"):
            linear.fit_models(rows, [ModelSpec("m", ("x2",), reference)])


def test_cuts_are_the_same_near_their_expected_place_and_elsewhere(spark, monkeypatch):
    # 20,000 rows of their own, and a unit that comes 4,000 times
    units = spark.range(24_000).select(F.when(F.col("id") < 20_000, F.col("id")).otherwise(7).cast("string").alias("u"))
    seeds, tries = list(range(1, 9)), []
    elsewhere = splits._cuts_by_prefix
    wanted = elsewhere(units, "u", seeds, 0.2)
    monkeypatch.setattr(splits, "_cuts_by_prefix", lambda *a: tries.append(a[2]) or elsewhere(*a))
    assert splits.split_cuts(units, "u", seeds) == wanted and len(tries) == 1
    own = units.distinct()
    assert splits.split_cuts(own, "u", seeds) == elsewhere(own, "u", seeds, 0.2) and len(tries) == 1
    assert splits.split_cuts(own.where("u IS NULL"), "u", seeds) == {}
