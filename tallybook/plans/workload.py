"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import audit, dedup, derive, evaluate, linear, metrics, segments, splits
from tallybook.operators.frame import TARGET, frame_notes, modeling_frame
from tallybook.plans import datasets, modeling, tables
from tallybook.plans.tables import (
    LINE_PAIRS,
    LINES,
    MODEL_A,
    MODEL_B,
    ORDER_A,
    ORDER_B,
    ORDERS,
    WIDE_A,
    WIDE_B,
)
from tallybook.session import materialise, scratch_path
from tallybook.sources import csv, manifest, publish
from tallybook.spec import ModelSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOCUMENT = ["text", "lang", "source", "n_chars"]
CATEGORICAL = ["band", "category", "creator", "grade", "segment", "year_raw"]
NUMERIC = ["creator_score", "m1", "m2", "measure", "score", "size_units", "year_raw"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: their last bits follow the order of summation.

    The rounding edge lies a little below the half, so that a mean which ends
    in an exact 5 does not fall on either side of it by chance.
    """
    scale = float(10**digits)
    numbers = [c for c, kind in df.dtypes if kind == "double"]
    limit = F.lit(2.0**53 / scale)
    edge = {
        c: F.when(F.abs(c) < limit, F.floor(F.col(c) * scale + 0.50001) / F.lit(scale)).otherwise(
            F.col(c)
        )
        for c in numbers
    }
    return df.withColumns(edge)


def _fields(spark: SparkSession, folder: str, *columns: str, costly: bool = False) -> DataFrame:
    """Lines with row-level derived fields. Columns of the line itself are always
    there; those that need a join only if named."""
    own = {"score", "segment", "year_raw", "period_raw", "size_units", "measure"}
    names = [c for c in tables._line_columns() if c in own | set(columns)]
    return derive.add_row_fields(tables.lines(spark, folder, *names, costly=costly), LINES)


# --- data quality ---------------------------------------------------------


@query
def dq_row_count(spark, folder):
    # the columns that the file has, not those that the views declare
    return audit.shape(spark.read.parquet(f"{folder.rstrip('/')}/lineitem.parquet"))


@query
def dq_missing_all(spark, folder):
    return audit.missingness(tables.lines(spark, folder))


@query
def dq_missing_selected(spark, folder):
    chosen = ["item", "creator", "aux_name", "aux_score", "category", "year_raw"]
    return audit.missing_shares(tables.lines(spark, folder, *chosen), chosen)


@query
def dq_flag_counts(spark, folder):
    # written, as keys are counted before rows are flagged
    fields = materialise(_fields(spark, folder, "item", "creator"))
    flagged = dedup.flag_key_repeats(fields, LINES.key, LINES.key_repeat)
    return audit.flag_counts(flagged, LINES)


@query
def dq_domain(spark, folder):
    rows = tables.lines(spark, folder, "grade")
    return audit.domain_counts(rows, LINES.domain_column, LINES.domain_values)


@query
def dq_pair_missingness(spark, folder):
    return audit.pair_missingness(tables.lines(spark, folder, "aux_name", "aux_score"), LINE_PAIRS)


@query
def dq_exact_dups(spark, folder):
    return dedup.exact_repeat_stats(tables.table(spark, folder, "documents"), DOCUMENT)


@query
def dq_exact_flags(spark, folder):
    documents = tables.table(spark, folder, "documents").select("doc_id", *DOCUMENT)
    flagged = dedup.flag_exact_repeats(documents, DOCUMENT, "exact_repeat")
    return flagged.select("doc_id", "exact_repeat")


@query
def dq_exact_dedup(spark, folder):
    documents = tables.table(spark, folder, "documents").select(*DOCUMENT)
    kept = dedup.drop_exact_repeats(documents, DOCUMENT)
    return kept.select(F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query
def dq_remaining_exact(spark, folder):
    # counted again on the rows as written
    primary = materialise(derive.primary_dataset(tables.line_extract(spark, folder), LINES))
    return audit.exact_repeats_left(primary, LINES)


@query
def dq_key_repeats(spark, folder):
    return dedup.key_repeat_stats(tables.lines(spark, folder, "item", "creator"), LINES.key)


@query
def dq_cardinality(spark, folder):
    return audit.cardinalities(tables.lines(spark, folder, *CATEGORICAL), CATEGORICAL)


@query
def dq_ranges(spark, folder):
    return neat(audit.numeric_ranges(tables.lines(spark, folder, *NUMERIC, costly=True), NUMERIC))


@query
def dq_score_distribution(spark, folder):
    return neat(audit.score_distribution(tables.lines(spark, folder, "score"), LINES))


@query
def dq_zero_sentinel(spark, folder):
    rows = tables.lines(spark, folder, "measure", "year_raw")
    zeros = audit.value_count(rows, LINES.measure, 0).select(F.lit("zero").alias("finding"), "n")
    sentinel = audit.value_count(rows, LINES.year, LINES.sentinel_year)
    return zeros.unionByName(sentinel.select(F.lit("sentinel").alias("finding"), "n"))


@query
def dq_category_completeness(spark, folder):
    return audit.category_completeness(tables.lines(spark, folder, "category"), LINES)


@query
def dq_freq_segment(spark, folder):
    return audit.frequency(tables.lines(spark, folder, "segment"), LINES.segment)


@query
def dq_freq_period(spark, folder):
    return audit.period_frequency(_fields(spark, folder), LINES)


@query
def dq_avail_bias(spark, folder):
    rows = tables.lines(spark, folder, "category", "score", "creator_score")
    return neat(audit.availability_bias(rows, LINES))


@query
def dq_period_mix(spark, folder):
    return audit.period_mix(_fields(spark, folder, "category"), LINES)


@query
def dq_band_recovery(spark, folder):
    return audit.band_recovery(tables.lines(spark, folder, "band", "score"), LINES)


@query
def dq_histogram(spark, folder):
    return audit.histogram(tables.lines(spark, folder, "score"), "score", 0, 100, 50)


@query
def dq_histogram_low(spark, folder):
    rows = tables.lines(spark, folder, "score").where(F.col("score") <= 20)
    return audit.histogram(rows, "score", 0, 21, 21)


# --- datasets -------------------------------------------------------------


@query
def derive_fields(spark, folder):
    return derive.add_derived_fields(tables.line_extract(spark, folder), LINES)


@query
def primary_dataset(spark, folder):
    return derive.primary_dataset(tables.line_extract(spark, folder), LINES)


@query
def sensitivity_dataset(spark, folder):
    # written, as keys are counted before rows are chosen
    rows = derive.add_row_fields(materialise(tables.lines(spark, folder)), LINES)
    return derive.sensitivity_dataset(rows, LINES)


def _built(spark: SparkSession, folder: str) -> datasets.Built:
    target = scratch_path(spark, "datasets")
    return datasets.build_datasets(tables.line_extract(spark, folder), LINES, target)


@query
def build_counts(spark, folder):
    return datasets.build_counts(_built(spark, folder))


@query
def build_dedup_stats(spark, folder):
    extract = tables.line_extract(spark, folder)
    return dedup.exact_repeat_stats(extract, extract.columns)


@query
def post_checks(spark, folder):
    return datasets.post_checks(_built(spark, folder), LINES)


@query
def publish_reconcile(spark, folder):
    rows = derive.add_row_fields(tables.lines(spark, folder), LINES)
    written = publish.write_datasets({"lines": rows}, scratch_path(spark, "published"))
    publish.publish_views({"catalog_lines": written["lines"]})
    published = publish.run_query(spark, "SELECT * FROM catalog_lines")
    return publish.reconcile(tables.lines(spark, folder, "score"), published, LINES, "lines")


def _both(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lines and one line per key, as published: written, then read."""
    needed = ["row_id", "item", "creator", "creator_score", "category"]
    rows = materialise(_fields(spark, folder, *needed))
    kept = derive.sensitivity_dataset(rows, LINES)
    return {"primary": rows, "sensitivity": materialise(kept)}


# --- metrics --------------------------------------------------------------


@query
def kpi_summary(spark, folder):
    needed = ["item", "creator", "creator_score", "category"]
    fields = _fields(spark, folder, *needed, costly=True)
    return neat(metrics.kpi_summary(fields, LINES))


@query
def kpi_compare(spark, folder):
    both = _both(spark, folder)
    base = metrics.kpi_summary(both["primary"], LINES)
    other = metrics.kpi_summary(both["sensitivity"], LINES)
    return neat(metrics.compare_kpis(base, other, "primary", "sensitivity"))


# --- segment queries ------------------------------------------------------


@query
def q1_period_score(spark, folder):
    return segments.score_by_period(_fields(spark, folder), LINES)


@query
def q2_category_score(spark, folder):
    return segments.score_by_category(_fields(spark, folder, "category"), LINES)


@query
def q3_category_high_share(spark, folder):
    return segments.high_share_by_category(_fields(spark, folder, "category"), LINES)


@query
def q4_period_coverage(spark, folder):
    return segments.coverage_by_period(_fields(spark, folder, "category"), LINES)


@query
def q5_segment_score(spark, folder):
    return segments.score_by_segment(_fields(spark, folder), LINES)


@query
def q6_period_category_rank(spark, folder):
    return segments.category_rank_by_period(_fields(spark, folder, "category"), LINES)


@query
def q6_top_ranks(spark, folder):
    return segments.category_rank_by_period(_fields(spark, folder, "category"), LINES, top=3)


@query
def q7_period_category_share(spark, folder):
    return segments.category_share_by_period(_fields(spark, folder, "category"), LINES)


@query
def q8a_tier_coverage(spark, folder):
    return segments.coverage_by_tier(_fields(spark, folder, "category"), LINES)


@query
def q8b_tier_top_categories(spark, folder):
    return segments.top_categories_by_tier(_fields(spark, folder, "category"), LINES, top=2)


@query
def q9_dataset_compare(spark, folder):
    return segments.compare_datasets(_both(spark, folder), LINES)


@query
def q10_period_profile(spark, folder):
    return segments.period_profile_by_segment(_fields(spark, folder), LINES)


# --- ingest ---------------------------------------------------------------

ORDER_LAYOUT = csv.CsvLayout(
    columns=(
        ("orderkey", "bigint"),
        ("custkey", "bigint"),
        ("status", "string"),
        ("price", "double"),
        ("year", "int"),
        ("priority", "string"),
    ),
    required=("orderkey", "price"),
)


def _order_text(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as text fields with missing tokens and a type line."""
    year = F.concat(F.year("o_orderdate").cast("string"), F.lit(".0"))
    rows = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("orderkey"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(F.year("o_orderdate") != 1996, year).otherwise("nan").alias("year"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Missing")
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
    )
    kinds = ["numeric", "numeric", "categorical", "numeric", "numeric", "string"]
    return rows.unionByName(spark.createDataFrame([tuple(kinds)], rows.schema))


def _order_files(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "orders-csv")
    _order_text(spark, folder).write.option("header", True).csv(path)
    return path


@query
def ingest_standardise(spark, folder):
    return csv.load_raw(spark, _order_files(spark, folder), ORDER_LAYOUT)


@query
def ingest_line_breaks(spark, folder):
    """Files whose lines are split beside files with quoted line breaks, in one load."""
    path = scratch_path(spark, "orders-both")
    rows = _order_text(spark, folder)
    urgent = F.col("priority") == "1-URGENT"
    plain = rows.where(~F.coalesce(urgent, F.lit(False)))
    torn = rows.where(urgent).withColumn("priority", F.concat("priority", F.lit("\nof "), "custkey", F.lit(",x")))
    for name, some in (("plain", plain), ("torn", torn)):
        some.write.option("header", True).csv(f"{path}/{name}")
    return csv.load_raw(spark, f"{path}/*", ORDER_LAYOUT)


@query
def ingest_counts(spark, folder):
    """Counts of a load whose row number is declared, with lines that are too wide."""
    path = scratch_path(spark, "orders-counted")
    orders = tables.table(spark, folder, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    line = F.concat_ws(
        ",",
        *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")),
        F.when(F.year("o_orderdate") == 1996, "soon").otherwise(F.year("o_orderdate").cast("string")),
        "o_orderpriority",
        F.when(urgent, ",extra"),
    )
    header = spark.createDataFrame([(",".join(ORDER_LAYOUT.names),)], "line string")
    header.unionByName(orders.select(line.alias("line"))).coalesce(1).write.text(path)
    layout = replace(ORDER_LAYOUT, expected_rows=orders.where(~urgent).count())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = csv.load_counted(spark, path, layout).counts
    names = "n_rows long, n_malformed long, n_headers long, years_not_parsed long"
    line = (found.n_rows, found.n_malformed, found.n_headers, found.failed["year"])
    return spark.createDataFrame([line], names)


ORDER_TABLES = {"primary": "built_orders_primary", "sensitivity": "built_orders_sensitivity"}
ORDER_FIELDS = csv.CsvLayout(
    columns=(
        ("row_id", "string"),
        ("item", "bigint"),
        ("creator", "string"),
        ("creator_score", "double"),
        ("score", "int"),
        ("category", "string"),
        ("segment", "string"),
        ("year_raw", "int"),
        ("period_raw", "int"),
        ("measure", "double"),
        ("size_units", "double"),
    ),
    required=("row_id", "score"),
)


@query
def build_from_files(spark, folder):
    """Files with copies of a fifth of their rows, checked, loaded, cleaned and published as
    tables, which are then read by SQL."""
    path = scratch_path(spark, "orders-build")
    # scores of the test orders go beyond the bounds that the build holds them to
    rows = tables.orders(spark, folder).withColumn("score", F.pmod("score", F.lit(101)))
    rows = rows.unionByName(rows.where("item % 5 = 0"))
    text = rows.select(*(F.col(n).cast("string").alias(n) for n in ORDER_FIELDS.names))
    text.write.option("header", True).option("nullValue", "NA").csv(path)
    listed = manifest.file_digests(spark, path).where("file LIKE '%.csv'").select("file", "digest")
    datasets.build_from_files(
        spark,
        path,
        ORDER_FIELDS,
        ORDERS,
        scratch_path(spark, "orders-built"),
        ORDER_TABLES,
        manifest=materialise(listed),
        as_tables=True,
    )
    parts = [
        f"SELECT '{k}' AS dataset, count(*) AS n_rows, sum(score) AS total_score, "
        f"count(DISTINCT creator) AS n_creators, count(category) AS n_categories FROM {name}"
        for k, name in ORDER_TABLES.items()
    ]
    return publish.run_query(spark, " UNION ALL ".join(parts))


@query
def ingest_schema_check(spark, folder):
    path = _order_files(spark, folder)
    csv.check_columns(csv.header_of(spark, path, ORDER_LAYOUT), ORDER_LAYOUT)
    return csv.load_profile(spark, path, ORDER_LAYOUT).drop("n_files", "example")


@query
def ingest_bad_rows(spark, folder):
    path = scratch_path(spark, "orders-malformed")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    fields = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    line = F.concat_ws(
        ",",
        *fields,
        F.lit('"1,5"'),
        F.year("o_orderdate").cast("string"),
        "o_orderpriority",
        F.when(urgent, ",extra"),
    )
    tables.table(spark, folder, "orders").select(line).write.text(path)
    report = csv.malformed_row_report(spark, path, ORDER_LAYOUT)
    return report.withColumn("examples", F.concat_ws("|", "examples"))


@query
def ingest_manifest(spark, folder):
    """Files of a thousand customer keys each against digests made from their rows."""
    path = scratch_path(spark, "customers-text")
    names = tables.table(spark, folder, "customer").select(
        F.floor(F.col("c_custkey") / 1000).alias("block"),
        "c_custkey",
        F.concat_ws(",", "c_custkey", "c_name").alias("line"),
    )
    one_file = names.repartition("block").sortWithinPartitions("block", "c_custkey")
    one_file.select("block", "line").write.partitionBy("block").text(path)
    found = manifest.file_digests(spark, path).withColumn(
        "file", F.regexp_extract("file", "^([^/]+)/part-", 1)
    )
    found = materialise(found.where("file <> ''"))
    # a block is bounded: its lines fit one value
    by_key = F.array_sort(F.collect_list(F.struct("c_custkey", "line")))
    text = F.concat(F.array_join(F.transform(by_key, lambda r: r["line"]), "\n"), F.lit("\n"))
    expected = names.groupBy("block").agg(F.sha2(text, 256).alias("digest"))
    expected = expected.withColumn("file", F.concat(F.lit("block="), "block"))
    return manifest.validate_manifest(found, expected.select("file", "digest"))


# --- splits ---------------------------------------------------------------


def _line_frame(spark: SparkSession, folder: str, *models: ModelSpec) -> DataFrame:
    chosen = list(models or (MODEL_A, MODEL_B))
    features = [c for m in chosen for c in m.features]
    fields = _fields(spark, folder, "row_id", "creator", "creator_score", *features)
    return modeling_frame(fields, LINES, chosen)


def _order_frame(spark: SparkSession, folder: str) -> DataFrame:
    fields = derive.add_row_fields(tables.orders(spark, folder), ORDERS)
    return modeling_frame(fields, ORDERS, [ORDER_A, ORDER_B])


@query
def group_ids(spark, folder):
    rows = tables.lines(spark, folder, "row_id", "creator")
    return splits.with_groups(rows, LINES).select("row_id", splits.GROUP)


@query
def group_size_summary(spark, folder):
    summary = splits.group_size_summary(_order_frame(spark, folder))
    sizes = F.transform("ten_largest_group_sizes", lambda n: n.cast("string"))
    return neat(summary.withColumn("ten_largest_group_sizes", F.concat_ws(",", sizes)))


@query
def placeholder_census(spark, folder):
    return splits.placeholder_census(tables.lines(spark, folder, "creator"), LINES)


@query
def placeholder_search(spark, folder):
    return splits.placeholder_search(tables.lines(spark, folder, "creator"), LINES)


@query
def grouped_split(spark, folder):
    frame = materialise(_line_frame(spark, folder).select(splits.GROUP, splits.ROW))
    cuts = splits.grouped_cuts(frame, [splits.SEED])
    marked = splits.mark_test(frame, splits.GROUP, splits.SEED, cuts[splits.SEED])
    return marked.select(splits.ROW, "is_test")


@query
def random_split(spark, folder):
    frame = materialise(_line_frame(spark, folder).select(splits.ROW))
    cuts = splits.row_cuts(frame, [splits.SEED])
    return splits.mark_test(frame, splits.ROW, splits.SEED, cuts[splits.SEED])


@query
def split_checks(spark, folder):
    frame = materialise(_order_frame(spark, folder).select(splits.GROUP))
    cuts = splits.grouped_cuts(frame, splits.SWEEP_SEEDS)
    return splits.split_checks(frame, cuts, splits.TEST_SIZE)


@query
def split_overlap(spark, folder):
    frame = materialise(_order_frame(spark, folder).select(splits.GROUP))
    cuts = splits.grouped_cuts(frame, splits.SWEEP_SEEDS)
    overlap = splits.group_overlap(frame, cuts)
    return overlap.agg(F.count(F.lit(1)).alias("groups_on_both_sides"))


# --- models ---------------------------------------------------------------


@query
def modeling_sample(spark, folder):
    return _line_frame(spark, folder)


@query
def modeling_notes(spark, folder):
    return frame_notes(_fields(spark, folder, "creator", "category"), LINES)


def _held(spark: SparkSession, folder: str, seeds: list[int] | None = None, **options):
    frame = materialise(_line_frame(spark, folder))
    return modeling.hold_out(frame, [MODEL_A, MODEL_B], seeds, **options)


@query
def baseline_eval(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    return neat(modeling.hold_out(frame, []).metrics())


@query
def model_eval(spark, folder):
    """Baseline, A and B on one grouped split, models as columns."""
    results = _held(spark, folder).metrics().drop("seed")
    return neat(evaluate.results_table(results, ["baseline", "model_a", "model_b"]))


@query
def saved_model_eval(spark, folder):
    """As `model_eval`, predicted by fits that were written and read again."""
    frame = materialise(_line_frame(spark, folder))
    held = modeling.hold_out(frame, [MODEL_A, MODEL_B])
    path = scratch_path(spark, "fits")
    linear.save_fits(spark, held.fits, path)
    test = held.rows.where("is_test").drop("is_test")
    predictions = linear.predict(test, linear.load_fits(spark, path))
    results = evaluate.accuracy(predictions)
    return neat(evaluate.results_table(results, ["baseline", "model_a", "model_b"]))


@query
def model_eval_gaps(spark, folder):
    """As `model_eval` where a fifth of the items has no score and a seventh a NaN measure."""
    features = [c for m in (MODEL_A, MODEL_B) for c in m.features]
    fields = _fields(spark, folder, "row_id", "item", "creator", "creator_score", *features)
    fields = fields.withColumns(
        {
            "score": F.when(F.col("item") % 5 != 0, F.col("score")),
            "measure": F.when(F.col("item") % 7 == 0, float("nan")).otherwise(F.col("measure")),
        }
    )
    frame = materialise(modeling_frame(fields, LINES, [MODEL_A, MODEL_B]))
    results = modeling.hold_out(frame, [MODEL_A, MODEL_B]).metrics().drop("seed")
    return neat(evaluate.results_table(results, ["baseline", "model_a", "model_b"]))


@query
def onehot_fit(spark, folder):
    model = ModelSpec("onehot", (), {"segment": "N"})
    frame = materialise(_line_frame(spark, folder, model))
    held = modeling.hold_out(frame, [model], baseline=False)
    by_level = held.predictions.groupBy("segment")
    return neat(by_level.agg(F.avg("prediction").alias("fitted"), F.count(F.lit(1)).alias("n")))


@query
def sweep(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    return neat(modeling.sweep(frame, [MODEL_A, MODEL_B]))


@query
def sweep_summary(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    swept = modeling.sweep(frame, [MODEL_A, MODEL_B])
    return neat(modeling.summarise_sweep(swept, [MODEL_A, MODEL_B]))


@query
def sweep_wide(spark, folder):
    """The sweep with four numeric and three categorical features."""
    frame = materialise(_line_frame(spark, folder, WIDE_A, WIDE_B))
    return modeling.sweep(frame, [WIDE_A, WIDE_B])


@query
def model_conditions(spark, folder):
    """First-order conditions of the wide model: residuals of the training rows
    average to zero against every numeric feature and within every level."""
    frame = materialise(_line_frame(spark, folder, WIDE_A, WIDE_B))
    held = modeling.hold_out(frame, [WIDE_B], baseline=False)
    fit = held.fits[0]
    train = linear.predict(held.rows.where(~F.col("is_test")), held.fits)
    residual = F.col(TARGET) - F.col("prediction")
    numeric = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(None).cast("string").alias("level"),
            (residual * (F.coalesce(F.col(c), F.lit(fit.fills[c])) - fit.means[c]) / fit.sds[c]).alias("r"),
        )
        for c in WIDE_B.numeric
    ]
    levels = [
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("level"), residual.alias("r"))
        for c in WIDE_B.categorical
    ]
    terms = train.select(F.inline(F.array(*numeric, *levels)))
    return terms.groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("n_train"), (F.abs(F.avg("r")) < 1e-6).alias("is_zero")
    )


@query
def wide_fit(spark, folder):
    """First-order conditions of a fit with a level per seller and per part, under ten row
    splits: in every seed's training rows the residuals average to zero."""
    model = ModelSpec("wide", ("measure", "m1"), {"seller": "Unknown", "part": "1"})
    fields = _fields(spark, folder, "row_id", "item", "creator", "m1")
    fields = fields.withColumns({"seller": F.col("creator"), "part": F.col("item").cast("string")})
    frame = materialise(modeling_frame(fields, LINES, [model]))
    held = modeling.hold_out(frame, [model], splits.SWEEP_SEEDS, unit=splits.ROW, baseline=False)
    train = linear.predict(held.rows.where(~F.col("is_test")), held.fits)
    residual = F.col(TARGET) - F.col("prediction")
    facts = {(f.seed, c): (f.fills[c], f.means[c], f.sds[c]) for f in held.fits for c in model.numeric}

    def scaled(c: str):
        of_seed = F.create_map(
            *(x for (seed, name), v in facts.items() if name == c for x in (F.lit(seed), F.array(*map(F.lit, v))))
        )[F.col("seed")]
        return (F.coalesce(F.col(c), of_seed[0]) - of_seed[1]) / of_seed[2]

    sets = train.select("seed", "seller", "part", residual.alias("r"), *(scaled(c).alias(c) for c in model.numeric))
    numeric = sets.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), *(F.abs(F.avg(F.col("r") * F.col(c))).alias(c) for c in model.numeric)
    )
    lines = [
        F.struct(F.lit(c).alias("feature"), F.lit(1).cast("bigint").alias("n_levels"), F.col("n").alias("n_train"), F.col(c).alias("far"))
        for c in model.numeric
    ]
    found = numeric.select("seed", F.inline(F.array(*lines)))
    for c in model.categorical:
        levels = sets.groupBy("seed", c).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("r")).alias("far"))
        found = found.unionByName(
            levels.groupBy("seed").agg(
                F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n_train"), F.max("far").alias("far")
            )
        )
    return found.select("seed", "feature", "n_levels", "n_train", (F.col("far") < 1e-6).alias("is_zero"))


@query
def coefs(spark, folder):
    held = _held(spark, folder, baseline=False)
    return neat(linear.coefficient_rows(spark, held.fits))


@query
def coef_ends(spark, folder):
    """The two highest and lowest level contrasts of each of two seeds."""
    model = ModelSpec("levels", (), {"category": "Unknown"})
    frame = materialise(_line_frame(spark, folder, model))
    held = modeling.hold_out(frame, [model], [7, 42], baseline=False)
    return neat(linear.level_coefficients(spark, held.fits, top=2))


@query
def reduced_ols(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    summary = modeling.reduced_ols(frame, MODEL_A).coefficients
    return neat(summary.select("term", "coef", "std_error", "t_value"))


@query
def reduced_ols_statistics(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    statistics = modeling.reduced_ols(frame, MODEL_A).statistics
    checked = ["n", "df_model", "df_error", "r2", "adj_r2", "f_value", "log_likelihood", "aic", "bic"]
    return neat(statistics.where(F.col("statistic").isin(checked)), 4)


def _pair(spark: SparkSession, folder: str) -> modeling.OlsSummary:
    model = ModelSpec("pair", ("m1", "creator_score"))
    return modeling.reduced_ols(materialise(_line_frame(spark, folder, model)), model)


@query
def ols_pair_inference(spark, folder):
    """P-values and intervals of a fit on two features."""
    return neat(_pair(spark, folder).coefficients)


@query
def ols_pair_statistics(spark, folder):
    """Its F value with p-value, and the condition number."""
    found = _pair(spark, folder).statistics
    return neat(found.where(F.col("statistic").isin("f_value", "f_p_value", "condition_number", "r2")))


@query
def reduced_ols_inference(spark, folder):
    """P-values and intervals for all numeric features and the segment."""
    model = ModelSpec("reduced", WIDE_A.numeric, {"segment": "N"})
    frame = materialise(_line_frame(spark, folder, model))
    return modeling.reduced_ols(frame, model).coefficients


# --- diagnostics ----------------------------------------------------------


@query
def bound_diag(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    return neat(modeling.bounds_sweep(frame, [MODEL_A, MODEL_B], LINES))


@query
def range_compression(spark, folder):
    return neat(evaluate.compression(_held(spark, folder).predictions))


@query
def tier_compression(spark, folder):
    return neat(evaluate.tier_errors(_held(spark, folder).predictions, LINES))


@query
def residuals_segment(spark, folder):
    return neat(evaluate.residuals_by(_held(spark, folder).predictions, "segment", "segment"))


@query
def residuals_known(spark, folder):
    by_category = ModelSpec("by_category", (), {"category": LINES.unknown_category})
    frame = materialise(_line_frame(spark, folder, by_category))
    held = modeling.hold_out(frame, [by_category])
    return neat(evaluate.residuals_by_known_category(held.predictions, LINES))


@query
def creator_buckets(spark, folder):
    frame = materialise(_order_frame(spark, folder))
    held = modeling.hold_out(frame, [ORDER_A, ORDER_B])
    return neat(evaluate.creator_buckets(held.predictions, frame, ORDERS))


@query
def bucket_exclusions(spark, folder):
    return evaluate.bucket_exclusions(_held(spark, folder).predictions, LINES)


@query
def creator_exclusion(spark, folder):
    predictions = _held(spark, folder).predictions
    return neat(evaluate.accuracy_without_creator(predictions, LINES.placeholder_creators[0]))


@query
def label_inspection(spark, folder):
    frame = _line_frame(spark, folder)
    return neat(evaluate.label_inspection(frame, LINES, LINES.placeholder_creators[0]))


@query
def label_top_values(spark, folder):
    frame = _line_frame(spark, folder)
    rows = frame.where(F.col("creator") == LINES.placeholder_creators[0])
    return evaluate.top_values(rows, TARGET)


@query
def density2d(spark, folder):
    return evaluate.density(_held(spark, folder).predictions, LINES)


@query
def split_comparison(spark, folder):
    frame = materialise(_line_frame(spark, folder))
    return neat(modeling.compare_splits(frame, [MODEL_A, MODEL_B]))


@query
def sensitivity_model(spark, folder):
    models = [MODEL_A, MODEL_B]
    return neat(modeling.compare_dataset_models(_both(spark, folder), LINES, models))
