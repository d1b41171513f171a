"""Catalog views over the star-schema test tables.

A view takes only the columns asked for and joins only the tables they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.expressions import tier_of
from tallybook.session import is_small, materialise, spread
from tallybook.spec import CatalogSpec, ModelSpec

LINES = CatalogSpec(
    item="item",
    creator="creator",
    creator_score="creator_score",
    score="score",
    category="category",
    segment="segment",
    year="year_raw",
    period_fallback="period_raw",
    size="size_units",
    measure="measure",
    band="band",
    domain_column="grade",
    domain_values=("1-URGENT", "2-HIGH", "3-MEDIUM"),
    identity=("row_id",),
    period_width=2,
    size_divisor=1000.0,
    sentinel_year=1995,
    cutoff_year=1998,
    min_group_rows=10_000,
    placeholder_creators=("Supplier#000000000", "Supplier#000000001"),
    placeholder_patterns=("^supplier#0+[0-3]$", "^supplier#0*1?5$", "^none$"),
)
LINE_PAIRS = {"aux_name": "aux_score"}

# Orders by customer: many creators with few rows each.
ORDERS = CatalogSpec(
    item="item",
    creator="creator",
    creator_score="creator_score",
    score="score",
    category="category",
    segment="segment",
    year="year_raw",
    period_fallback="period_raw",
    size="size_units",
    measure="measure",
    identity=("row_id",),
    period_width=2,
    size_divisor=1000.0,
    placeholder_creators=("Customer#000000000", "Customer#000000001"),
)

MODEL_A = ModelSpec("model_a", ("measure",), {"segment": "N"})
MODEL_B = MODEL_A.plus("model_b", "creator_score")
WIDE_A = ModelSpec(
    "model_a",
    ("m1", "m2", "measure", "size_scaled"),
    {"segment": "N", "category": "Unknown", "period": "1998"},
)
WIDE_B = WIDE_A.plus("model_b", "creator_score")
ORDER_A = ModelSpec("model_a", ("measure",), {"segment": "O"})
ORDER_B = ORDER_A.plus("model_b", "creator_score")


# Declared, so that no job reads file footers to infer them.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def _line_columns() -> dict[str, tuple[Column, str | None]]:
    """View column -> its expression and the table it needs besides lineitem."""
    year = F.year("l_shipdate")
    score = F.when(F.col("l_discount") == 0, 0).otherwise((F.col("l_quantity") * 2).cast("int"))
    no_tax = F.col("l_tax") == 0
    identity = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents("l_extendedprice")
    )
    decade = (F.floor(year / 2) * 2).cast("int")
    return {
        "row_id": (identity, None),
        "item": (F.col("l_partkey"), None),
        "creator": (F.nullif(F.col("s_name"), F.lit("Supplier#000000002")), "supplier"),
        "creator_score": (F.col("s_acctbal"), "supplier"),
        "score": (score, None),
        "band": (tier_of(score, (33, 66), ("0low", "1moderate", "2high")), None),
        "category": (F.nullif(F.col("p_type"), F.lit("STANDARD")), "part"),
        "segment": (F.col("l_returnflag"), None),
        "year_raw": (F.when(~no_tax, year), None),
        "period_raw": (F.when(~(no_tax & (F.col("l_linestatus") == "F")), decade), None),
        "measure": (F.col("l_discount"), None),
        "m1": (F.col("l_tax"), None),
        "m2": (F.col("p_retailprice"), "part"),
        "size_units": (F.col("l_extendedprice"), None),
        "grade": (F.col("o_orderpriority"), "orders"),
        "aux_name": (F.nullif(F.col("l_linestatus"), F.lit("F")), None),
        "aux_score": (F.nullif(F.col("l_tax"), F.lit(0.0)), None),
    }


# The largest table first: the rows that a join moves carry what former joins added.
LINE_JOINS = {
    "orders": ("l_orderkey", "o_orderkey", ["o_orderpriority"]),
    "part": ("l_partkey", "p_partkey", ["p_type", "p_retailprice"]),
    "supplier": ("l_suppkey", "s_suppkey", ["s_name", "s_acctbal"]),
}


def lines(spark: SparkSession, folder: str, *columns: str, costly: bool = False) -> DataFrame:
    """One observation per line item; all columns if none are named.

    `costly` says that much is computed per row, so that few splits would keep
    most cores idle. The row identity alone is costly.
    """
    known = _line_columns()
    chosen = {c: known[c] for c in columns or known}
    df = table(spark, folder, "lineitem")
    if costly or "row_id" in chosen:
        df = spread(df, "l_orderkey")
    for name, (left, right, values) in LINE_JOINS.items():
        if any(needed == name for _, needed in chosen.values()):
            side = table(spark, folder, name).select(right, *values)
            # orders are nearly as many as lines: not worth measuring
            side = F.broadcast(side) if name != "orders" and is_small(side) else side
            df = df.join(side, F.col(left) == F.col(right), "left")
    return df.select(*(expression.alias(c) for c, (expression, _) in chosen.items()))


def line_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The lines with whole-row duplicates, as a raw delivery may have them."""
    rows = materialise(lines(spark, folder))
    again = (F.col("segment") == "R") & (F.col("grade") == "5-LOW")
    return rows.unionByName(rows.where(again))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """One observation per order, credited to its customer."""
    year = F.year("o_orderdate")
    joined = spread(table(spark, folder, "orders"), "o_orderkey").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return joined.select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        F.col("o_orderkey").alias("item"),
        F.nullif(F.col("c_name"), F.lit("Customer#000000002")).alias("creator"),
        F.col("c_acctbal").alias("creator_score"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("category"),
        F.col("o_orderstatus").alias("segment"),
        year.alias("year_raw"),
        (F.floor(year / 2) * 2).cast("int").alias("period_raw"),
        (F.month("o_orderdate") - 1).cast("double").alias("measure"),
        F.col("o_totalprice").alias("size_units"),
    )
