"""SQL twins of the registered queries, for the correctness check.

Written independently of the operators: plain SQL over the same tables.
Queries without a twin are those whose result SQL does not give (p-values,
file digests, the fit with many categories), which the tests check instead.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def r(expression: str, digits: int) -> str:
    """Half-up rounding, the same in both engines."""
    return f"floor(({expression})::DOUBLE * 1e{digits} + 0.5) / 1e{digits}"


def near(expression: str, digits: int = 6) -> str:
    """Rounding for comparison, its edge off the exact half."""
    return f"floor(({expression})::DOUBLE * 1e{digits} + 0.50001) / 1e{digits}"


def pct(condition: str, digits: int) -> str:
    return r(f"100.0::DOUBLE * avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", digits)


def num(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


SCORE = "CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity * 2 AS INTEGER) END"

LINES = f"""
lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
         l_partkey AS item,
         nullif(s_name, 'Supplier#000000002') AS creator,
         s_acctbal AS creator_score,
         {SCORE} AS score,
         CASE WHEN {SCORE} <= 33 THEN '0low' WHEN {SCORE} <= 66 THEN '1moderate' ELSE '2high' END AS band,
         nullif(p_type, 'STANDARD') AS category,
         l_returnflag AS segment,
         CAST(CASE WHEN l_tax <> 0 THEN year(l_shipdate) END AS INTEGER) AS year_raw,
         CAST(CASE WHEN NOT (l_tax = 0 AND l_linestatus = 'F')
              THEN floor(year(l_shipdate) / 2.0) * 2 END AS INTEGER) AS period_raw,
         l_discount AS measure, l_tax AS m1, p_retailprice AS m2, l_extendedprice AS size_units,
         o_orderpriority AS grade, nullif(l_linestatus, 'F') AS aux_name, nullif(l_tax, 0.0) AS aux_score
  FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN orders ON l_orderkey = o_orderkey)"""


def fields(source: str, name: str) -> str:
    """The row-level derived columns over a catalog view."""
    return f"""
{name} AS (
  SELECT *, year_raw AS year_value,
         coalesce(CAST(floor(year_raw / 2.0) * 2 AS INTEGER), period_raw) AS period,
         size_units / 1000.0::DOUBLE AS size_scaled,
         CASE WHEN score IS NULL THEN NULL WHEN score <= 33 THEN 'low'
              WHEN score <= 66 THEN 'moderate' ELSE 'high' END AS tier,
         coalesce(score >= 67, false) AS is_high,
         category IS NOT NULL AS has_category,
         CASE WHEN measure IS NULL THEN 'missing' WHEN measure = 0 THEN 'zero' ELSE 'ok' END AS measure_quality,
         coalesce(year_raw = 1995, false) AS is_sentinel_year
  FROM {source})"""


RAW = (
    "row_id, item, creator, creator_score, score, band, category, segment, year_raw, period_raw, "
    "measure, m1, m2, size_units, grade, aux_name, aux_score"
)
FIELDS = f"WITH {LINES}, {fields('lines', 'f')}"
EXTRACT = f"""{LINES},
extract_ AS (SELECT * FROM lines
             UNION ALL SELECT * FROM lines WHERE segment = 'R' AND grade = '5-LOW')"""
ONE_PER_KEY = """
sens AS (
  SELECT * FROM f
  QUALIFY row_number() OVER (PARTITION BY item, creator
    ORDER BY year_raw NULLS LAST, segment NULLS LAST, md5('=' || row_id)) = 1)"""
DERIVED = (
    "year_value, period, size_scaled, tier, is_high, has_category, measure_quality, is_sentinel_year"
)

# --- data quality ---------------------------------------------------------

ORACLES["dq_row_count"] = "SELECT count(*) AS n_rows, (SELECT count(*)::INTEGER FROM (DESCRIBE lineitem)) AS n_columns FROM lineitem"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


ORACLES["dq_missing_all"] = f"WITH {LINES}\n" + _union(
    [
        f"SELECT '{c}' AS column_name, {num(f'{c} IS NULL')} AS n_missing, "
        f"{r(f'({num(f'{c} IS NULL')})::DOUBLE / count(*) * 100.0', 3)} AS pct_missing FROM lines"
        for c in RAW.split(", ")
    ]
)
ORACLES["dq_missing_selected"] = f"WITH {LINES} SELECT " + ", ".join(
    f"{pct(f'{c} IS NULL', 3)} AS pct_missing_{c}"
    for c in ("item", "creator", "aux_name", "aux_score", "category", "year_raw")
) + " FROM lines"
ORACLES["dq_flag_counts"] = f"""{FIELDS},
k AS (SELECT *, count(*) OVER (PARTITION BY item, creator) > 1 AS key_repeat FROM f)
SELECT {num("measure_quality = 'zero'")} AS n_zero_measure,
       {num("measure_quality = 'missing'")} AS n_missing_measure,
       {num("is_sentinel_year")} AS n_sentinel_year,
       {num("key_repeat")} AS n_rows_in_key_repeats,
       {num("is_high")} AS n_high
FROM k"""
ORACLES["dq_domain"] = f"""WITH {LINES}
SELECT grade, count(*) AS n, grade IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS in_domain
FROM lines GROUP BY grade"""
ORACLES["dq_pair_missingness"] = f"""WITH {LINES}
SELECT 'aux_name' AS name_column, 'aux_score' AS value_column,
       {pct("aux_name IS NULL", 3)} AS pct_name_missing,
       {pct("aux_score IS NULL", 3)} AS pct_value_missing,
       {num("aux_name IS NULL AND aux_score IS NOT NULL")} AS n_value_without_name
FROM lines"""
REPEATS = """
SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_groups,
       CAST(sum(n - 1) AS BIGINT) AS rows_removed,
       CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after
FROM g"""
ORACLES["dq_exact_dups"] = f"""
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars){REPEATS}"""
ORACLES["dq_exact_flags"] = """
SELECT doc_id, count(*) OVER (PARTITION BY text, lang, source, n_chars) > 1 AS exact_repeat FROM documents"""
ORACLES["dq_exact_dedup"] = """
SELECT md5(text) AS text_md5, lang, source, n_chars
FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)"""
ORACLES["dq_remaining_exact"] = f"""WITH {EXTRACT},
p AS (SELECT DISTINCT * FROM extract_),
x AS (SELECT {RAW}, count(*) AS n FROM p GROUP BY {RAW})
SELECT {num("n > 1")} AS remaining_exact_repeats FROM x"""
ORACLES["dq_key_repeats"] = f"""WITH {LINES},
g AS (SELECT item, creator, count(*) AS n FROM lines GROUP BY item, creator)
SELECT {num("n > 1")} AS repeat_groups,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS rows_in_repeat_groups,
       max(n) AS largest_group_size
FROM g"""
ORACLES["dq_cardinality"] = f"WITH {LINES}\n" + _union(
    [
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM lines"
        for c in ("band", "category", "creator", "grade", "segment", "year_raw")
    ]
)
ORACLES["dq_ranges"] = f"WITH {LINES}\n" + _union(
    [
        f"""SELECT '{c}' AS column_name, {near(f'min({c})')} AS "min", {near(f'max({c})')} AS "max",
            {near(f'avg({c})')} AS "mean", {near(f'median({c}::DOUBLE)')} AS "median" FROM lines"""
        for c in ("creator_score", "m1", "m2", "measure", "score", "size_units", "year_raw")
    ]
)
_Q = {"p0": 0, "p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75,
      "p90": 0.9, "p99": 0.99, "p100": 1}
ORACLES["dq_score_distribution"] = f"""WITH {LINES}
SELECT count(*) AS n, {num("score = 0")} AS n_zero, {pct("score = 0", 3)} AS pct_zero,
       {near("avg(score)")} AS mean, {near("median(score)")} AS median, {near("skewness(score)")} AS skew,
       {", ".join(f"{near(f'quantile_cont(score, {p})')} AS {name}" for name, p in _Q.items())}
FROM lines"""
ORACLES["dq_zero_sentinel"] = f"""WITH {LINES}
SELECT 'zero' AS finding, {num("measure = 0")} AS n FROM lines
UNION ALL SELECT 'sentinel', {num("year_raw = 1995")} FROM lines"""
ORACLES["dq_category_completeness"] = f"""WITH {LINES}
SELECT {num("category IS NOT NULL")} AS n_present, {num("category IS NULL")} AS n_missing,
       {pct("category IS NOT NULL", 3)} AS pct_present
FROM lines"""
ORACLES["dq_freq_segment"] = f"WITH {LINES} SELECT segment, count(*) AS n FROM lines GROUP BY segment"
ORACLES["dq_freq_period"] = f"{FIELDS} SELECT period, count(*) AS n FROM f GROUP BY period"
_SIDES = {"with_category": "category IS NOT NULL", "without_category": "category IS NULL"}
ORACLES["dq_avail_bias"] = f"WITH {LINES}\n" + _union(
    [
        f"SELECT '{name}' AS measure, "
        + ", ".join(f"{near(text.replace('@', f'FILTER (WHERE {c})'))} AS {side}" for side, c in _SIDES.items())
        + " FROM lines"
        for name, text in {
            "n": "count(*) @",
            "share_of_rows": "floor((count(*) @) / count(*)::DOUBLE * 1e4 + 0.5) / 1e4",
            "median_score": "median(score) @",
            "mean_score": "avg(score) @",
            "mean_creator_score": "avg(creator_score) @",
        }.items()
    ]
)
ORACLES["dq_period_mix"] = f"""{FIELDS},
c AS (SELECT has_category, period, count(*) AS n FROM f GROUP BY has_category, period)
SELECT *, {r("100.0::DOUBLE * n / sum(n) OVER (PARTITION BY has_category)", 3)} AS share_pct FROM c"""
ORACLES["dq_band_recovery"] = f"""WITH {LINES},
b AS (SELECT band, min(score) AS min_score, max(score) AS max_score, count(score) AS n
      FROM lines GROUP BY band)
SELECT *, coalesce(lag(max_score) OVER (ORDER BY min_score) < min_score, true) AS is_disjoint FROM b"""


def _histogram(where: str, low: int, width: int, bins: int) -> str:
    return f"""WITH {LINES},
h AS (SELECT CAST(least(floor((score - {low}) / {width}.0::DOUBLE), {bins - 1}) AS BIGINT) AS bin
      FROM lines WHERE {where})
SELECT b.bin, count(h.bin) AS n, {low}.0::DOUBLE + b.bin * {width}.0::DOUBLE AS bin_low
FROM range({bins}) AS b(bin) LEFT JOIN h ON h.bin = b.bin GROUP BY b.bin"""


ORACLES["dq_histogram"] = _histogram("score BETWEEN 0 AND 100", 0, 2, 50)
ORACLES["dq_histogram_low"] = _histogram("score <= 20", 0, 1, 21)

# --- datasets -------------------------------------------------------------

ORACLES["derive_fields"] = f"""WITH {EXTRACT}, {fields("extract_", "f")}
SELECT {RAW}, {DERIVED},
       count(*) OVER (PARTITION BY {RAW}) > 1 AS exact_repeat,
       count(*) OVER (PARTITION BY item, creator) > 1 AS key_repeat
FROM f"""
PRIMARY = f"""WITH {EXTRACT}, p AS (SELECT DISTINCT * FROM extract_), {fields("p", "f")}"""
ORACLES["primary_dataset"] = f"""{PRIMARY}
SELECT {RAW}, {DERIVED}, false AS exact_repeat,
       count(*) OVER (PARTITION BY item, creator) > 1 AS key_repeat
FROM f"""
ORACLES["sensitivity_dataset"] = f"""{FIELDS}, {ONE_PER_KEY}
SELECT {RAW}, {DERIVED}, false AS key_repeat FROM sens"""
ORACLES["build_counts"] = f"""{PRIMARY}, {ONE_PER_KEY}
SELECT 'primary' AS dataset, count(*) AS n_rows FROM f
UNION ALL SELECT 'sensitivity', count(*) FROM sens"""
ORACLES["build_dedup_stats"] = f"""WITH {EXTRACT},
g AS (SELECT count(*) AS n FROM extract_ GROUP BY {RAW}){REPEATS}"""
_RULES = {
    "score_out_of_range": "NOT score BETWEEN 0 AND 100",
    "tier_and_flag_differ": "is_high <> coalesce(tier = 'high', false)",
    "category_flag_differs": "has_category <> (category IS NOT NULL)",
    "scaled_size_differs": "size_scaled IS DISTINCT FROM size_units / 1000.0::DOUBLE",
    "exact_repeat_flagged": "false",
}
ORACLES["post_checks"] = f"{PRIMARY}, {ONE_PER_KEY}\n" + _union(
    [
        f"""SELECT '{name}' AS dataset, '{check}' AS "check", {num(rule)} AS violations FROM {source}"""
        for name, source in (("primary", "f"), ("sensitivity", "sens"))
        for check, rule in _RULES.items()
    ]
    + [
        f"""SELECT 'primary', 'exact_repeats_left', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
            FROM (SELECT count(*) AS n FROM f GROUP BY {RAW})""",
        """SELECT 'sensitivity', 'key_repeats_left', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
           FROM (SELECT count(*) AS n FROM sens GROUP BY item, creator)""",
    ]
)
ORACLES["publish_reconcile"] = f"""WITH {LINES}
SELECT 'lines' AS dataset, count(*) AS source_rows, count(*) AS published_rows, true AS rows_match,
       min(score) >= 0 AND max(score) <= 100 AS scores_in_bounds
FROM lines"""

# --- metrics --------------------------------------------------------------


def _kpis(source: str) -> str:
    repeats = f"(SELECT count(*) AS n FROM {source} GROUP BY item, creator)"
    lines = {
        "row_count": "count(*)",
        "median_score": "median(score)",
        "mean_score": "avg(score)",
        "high_share": "avg(CASE WHEN is_high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
        "category_coverage": "count(category)::DOUBLE / count(*)",
        "median_size": "median(size_scaled)",
        "median_creator_score": "median(creator_score)",
    }
    parts = [f"SELECT '{m}' AS metric, ({e})::DOUBLE AS value FROM {source}" for m, e in lines.items()]
    parts.append(
        "SELECT 'repeat_share', sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE"
        f" FROM {repeats}"
    )
    return _union(parts)


ORACLES["kpi_summary"] = f"""{FIELDS}, k AS ({_kpis("f")})
SELECT metric, {near("value")} AS value FROM k"""
ORACLES["kpi_compare"] = f"""{FIELDS}, {ONE_PER_KEY}, a AS ({_kpis("f")}), b AS ({_kpis("sens")})
SELECT a.metric, {near("a.value")} AS "primary", {near("b.value")} AS sensitivity,
       {near("b.value - a.value")} AS abs_delta,
       {near("(b.value - a.value) / nullif(a.value, 0) * 100.0")} AS rel_delta_pct
FROM a JOIN b ON a.metric = b.metric"""

# --- segment queries ------------------------------------------------------

CENTER = f"median(score) AS median_score, {r('avg(score)', 2)} AS mean_score"
HIGH = f"{num('score >= 67')} AS n_high, {pct('score >= 67', 2)} AS high_share_pct"
COVERAGE = (
    f"count(category) AS n_with_category, {pct('category IS NOT NULL', 2)} AS coverage_pct"
)
ORACLES["q1_period_score"] = f"""{FIELDS}
SELECT period, count(*) AS n_rows, {CENTER} FROM f WHERE period IS NOT NULL
GROUP BY period ORDER BY period"""
ORACLES["q2_category_score"] = f"""{FIELDS}
SELECT category, count(*) AS n_rows, {CENTER} FROM f WHERE category IS NOT NULL
GROUP BY category ORDER BY median_score DESC, category"""
ORACLES["q3_category_high_share"] = f"""{FIELDS}
SELECT category, count(*) AS n_rows, {HIGH} FROM f WHERE category IS NOT NULL
GROUP BY category ORDER BY high_share_pct DESC, category"""
ORACLES["q4_period_coverage"] = f"""{FIELDS}
SELECT period, count(*) AS n_rows, {COVERAGE} FROM f WHERE period IS NOT NULL
GROUP BY period HAVING count(*) >= 10000 ORDER BY period"""
ORACLES["q5_segment_score"] = f"""{FIELDS}
SELECT segment, count(*) AS n_rows, {CENTER}, {HIGH} FROM f GROUP BY segment
ORDER BY median_score DESC, segment"""


def _cells(within: str) -> str:
    return f"""c AS (SELECT {within}, category, count(*) AS n_rows FROM f
WHERE {within} IS NOT NULL AND category IS NOT NULL GROUP BY {within}, category)"""


RANKED = f"""{FIELDS}, {_cells("period")}
SELECT *, CAST(rank() OVER (PARTITION BY period ORDER BY n_rows DESC) AS INTEGER) AS category_rank
FROM c"""
ORACLES["q6_period_category_rank"] = RANKED
ORACLES["q6_top_ranks"] = f"{RANKED} QUALIFY category_rank <= 3"
ORACLES["q7_period_category_share"] = f"""{FIELDS}, {_cells("period")}
SELECT *, CAST(sum(n_rows) OVER (PARTITION BY period) AS BIGINT) AS period_total,
       {r("100.0::DOUBLE * n_rows / sum(n_rows) OVER (PARTITION BY period)", 2)} AS share_pct
FROM c"""
ORACLES["q8a_tier_coverage"] = f"""{FIELDS}
SELECT tier, count(*) AS n_rows, {COVERAGE} FROM f WHERE tier IS NOT NULL GROUP BY tier"""
ORACLES["q8b_tier_top_categories"] = f"""{FIELDS}, {_cells("tier")}
SELECT *, CAST(rank() OVER (PARTITION BY tier ORDER BY n_rows DESC) AS INTEGER) AS rank_in_tier
FROM c QUALIFY rank_in_tier <= 2"""
ORACLES["q9_dataset_compare"] = f"{FIELDS}, {ONE_PER_KEY}\n" + _union(
    [
        f"""SELECT '{name}' AS dataset, count(*) AS n_rows, median(score) AS median_score,
            {r("avg(score)", 4)} AS mean_score, {pct("score >= 67", 4)} AS high_share_pct,
            {pct("category IS NOT NULL", 4)} AS coverage_pct FROM {source}"""
        for name, source in (("primary", "f"), ("sensitivity", "sens"))
    ]
)
ORACLES["q10_period_profile"] = f"""{FIELDS}
SELECT segment, count(*) AS n_rows, median(year_value) AS median_year,
       {pct("year_value <= 1998", 2)} AS pct_up_to_cutoff
FROM f WHERE year_value IS NOT NULL GROUP BY segment"""

# --- ingest ---------------------------------------------------------------

ORACLES["ingest_standardise"] = """
SELECT o_orderkey AS orderkey, o_custkey AS custkey, nullif(o_orderstatus, 'P') AS status,
       o_totalprice AS price, CAST(nullif(year(o_orderdate), 1996) AS INTEGER) AS year,
       nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority
FROM orders"""
ORACLES["ingest_line_breaks"] = """
SELECT o_orderkey AS orderkey, o_custkey AS custkey, nullif(o_orderstatus, 'P') AS status,
       o_totalprice AS price, CAST(nullif(year(o_orderdate), 1996) AS INTEGER) AS year,
       CASE o_orderpriority WHEN '1-URGENT' THEN '1-URGENT' || chr(10) || 'of ' || o_custkey || ',x'
            WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority
FROM orders"""
ORACLES["ingest_counts"] = """
SELECT count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS n_rows,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_malformed, CAST(1 AS BIGINT) AS n_headers,
       count(*) FILTER (WHERE o_orderpriority <> '1-URGENT' AND year(o_orderdate) = 1996) AS years_not_parsed
FROM orders"""
ORACLES["build_from_files"] = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS dataset, count(*) AS n_rows, sum(floor(o_totalprice / 5000)::BIGINT % 101)::BIGINT AS total_score,
       count(DISTINCT nullif(c_name, 'Customer#000000002')) AS n_creators,
       count(nullif(c_mktsegment, 'MACHINERY')) AS n_categories
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
    for name in ("primary", "sensitivity")
)
ORACLES["ingest_schema_check"] = """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_malformed, CAST(0 AS BIGINT) AS n_files_without_header
FROM orders"""
ORACLES["ingest_bad_rows"] = """
WITH b AS (SELECT concat_ws(',', o_orderkey, o_custkey, o_orderstatus, '"1,5"', year(o_orderdate),
                  o_orderpriority, ',extra') AS line
           FROM orders WHERE o_orderpriority = '1-URGENT'),
t AS (SELECT line FROM b ORDER BY line LIMIT 5)
SELECT (SELECT count(*) FROM b) AS n_malformed,
       (SELECT string_agg(line, '|' ORDER BY line) FROM t) AS examples"""

ORACLES["ingest_manifest"] = """
WITH t AS (
  SELECT c_custkey // 1000 AS block,
         string_agg(c_custkey || ',' || c_name, chr(10) ORDER BY c_custkey) || chr(10) AS text
  FROM customer GROUP BY block)
SELECT 'block=' || block AS file, sha256(text) AS digest, strlen(text) AS n_bytes,
       sha256(text) AS found, 'ok' AS status
FROM t"""

# --- splits ---------------------------------------------------------------

PLACEHOLDERS = "('Supplier#000000000', 'Supplier#000000001')"
GROUP = f"""CASE WHEN creator IS NULL OR creator IN {PLACEHOLDERS}
  THEN '__row_' || md5('=' || row_id) ELSE creator END"""
FRAME = f"""{FIELDS},
mf AS (
  SELECT score::DOUBLE AS target, nullif(measure, 0.0) AS measure, creator_score, segment,
         coalesce(category, 'Unknown') AS category_, period, m1, m2, size_scaled, creator,
         md5('=' || row_id) AS row_key, {GROUP} AS group_id
  FROM f WHERE period IS NOT NULL)"""
ORDER_PLACEHOLDERS = "('Customer#000000000', 'Customer#000000001')"
ORDER_FRAME = f"""
WITH o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS row_id, nullif(c_name, 'Customer#000000002') AS creator,
         c_acctbal AS creator_score, CAST(floor(o_totalprice / 5000) AS INTEGER) AS score,
         o_orderstatus AS segment, (month(o_orderdate) - 1)::DOUBLE AS measure
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
mf AS (
  SELECT score::DOUBLE AS target, nullif(measure, 0.0) AS measure, creator_score, segment, creator,
         md5('=' || row_id) AS row_key,
         CASE WHEN creator IS NULL OR creator IN {ORDER_PLACEHOLDERS}
           THEN '__row_' || md5('=' || row_id) ELSE creator END AS group_id
  FROM o)"""
SEEDS = "[1, 7, 21, 42, 73, 101, 202, 314, 512, 999]"


def folds(unit: str = "group_id", seeds: str = "[42]") -> str:
    """`rows_`: every modeling row per seed with its side."""
    return f"""
seeds AS (SELECT CAST(unnest({seeds}) AS INTEGER) AS seed),
units AS (SELECT DISTINCT {unit} AS unit FROM mf),
hashes AS (SELECT seed, unit, md5(seed || ':' || unit) AS h FROM units, seeds),
sides AS (SELECT seed, unit, row_number() OVER (PARTITION BY seed ORDER BY h)
            <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY seed)) AS is_test FROM hashes),
rows_ AS (SELECT mf.*, seed, is_test FROM mf JOIN sides ON mf.{unit} = sides.unit)"""


ORACLES["group_ids"] = f"WITH {LINES} SELECT row_id, {GROUP} AS group_id FROM lines"
ORACLES["group_size_summary"] = f"""{ORDER_FRAME},
s AS (SELECT count(*) AS n FROM mf GROUP BY group_id),
t AS (SELECT n FROM s ORDER BY n DESC LIMIT 10)
SELECT count(*) AS n_groups, {near("median(n)")} AS median_group_size,
       {near("quantile_cont(n, 0.9)")} AS p90_group_size, {near("quantile_cont(n, 0.99)")} AS p99_group_size,
       (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) FROM t) AS ten_largest_group_sizes,
       {r("max(n)::DOUBLE / sum(n)::DOUBLE * 100.0", 3)} AS largest_group_pct,
       CAST(sum(n) AS BIGINT) AS total_rows
FROM s"""
ORACLES["placeholder_census"] = f"WITH {LINES}\n" + _union(
    [
        f"SELECT '{label}' AS label, {num(f"creator = '{label}'")} AS n_rows FROM lines"
        for label in ("Supplier#000000000", "Supplier#000000001")
    ]
)
ORACLES["grouped_split"] = f"{FRAME}, {folds()} SELECT row_key, is_test FROM rows_"
ORACLES["random_split"] = f"{FRAME}, {folds('row_key')} SELECT row_key, is_test FROM rows_"
ORACLES["split_checks"] = f"""{ORDER_FRAME}, {folds(seeds=SEEDS)}
SELECT seed, {num("NOT is_test")} AS n_train, {num("is_test")} AS n_test,
       count(DISTINCT group_id) FILTER (WHERE NOT is_test) AS n_train_groups,
       count(DISTINCT group_id) FILTER (WHERE is_test) AS n_test_groups,
       true AS exact_size, true AS groups_pure
FROM rows_ GROUP BY seed"""
ORACLES["split_overlap"] = f"""{ORDER_FRAME}, {folds(seeds=SEEDS)}
SELECT count(*) AS groups_on_both_sides FROM (
  SELECT seed, group_id FROM rows_ GROUP BY seed, group_id HAVING count(DISTINCT is_test) > 1)"""

# --- models ---------------------------------------------------------------

ORACLES["modeling_sample"] = f"""{FRAME}
SELECT target, measure, creator_score, segment, creator, row_key, group_id FROM mf"""
ORACLES["modeling_notes"] = f"""{FIELDS}
SELECT count(*) AS input_rows, {num("period IS NULL")} AS rows_dropped_missing_period,
       {num("period IS NOT NULL AND measure = 0")} AS measures_treated_as_missing,
       {num("period IS NOT NULL AND category IS NULL")} AS rows_with_unknown_category,
       count(period) AS output_rows,
       {num("period IS NOT NULL AND score IS NULL")} AS rows_without_target,
       {num("period IS NOT NULL AND creator IS NULL")} AS rows_missing_creator,
       {num(f"period IS NOT NULL AND creator IN {PLACEHOLDERS}")} AS rows_with_placeholder_creator
FROM f"""

# Least squares with one or two numeric features and one categorical has a
# closed form: slopes from the covariances within the levels.
FITS = """
med AS (SELECT seed, median(measure) AS m FROM rows_ WHERE NOT is_test GROUP BY seed),
xs AS (SELECT rows_.*, coalesce(measure, m) AS x1, creator_score AS x2
       FROM rows_ JOIN med ON rows_.seed = med.seed),
lev AS (SELECT seed, segment, count(*) AS n, avg(x1) AS m1_, avg(x2) AS m2_, avg(target) AS my,
          var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22,
          covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, target) * count(*) AS s1y,
          covar_pop(x2, target) * count(*) AS s2y
        FROM xs WHERE NOT is_test GROUP BY seed, segment),
tot AS (SELECT seed, avg(target) AS y0, avg(x1) AS mean1, avg(x2) AS mean2,
          stddev_pop(x1) AS sd1, stddev_pop(x2) AS sd2, count(*) AS n_train
        FROM xs WHERE NOT is_test GROUP BY seed),
slope AS (SELECT seed, sum(s1y) / sum(s11) AS a1,
            (sum(s1y) * sum(s22) - sum(s2y) * sum(s12)) / (sum(s11) * sum(s22) - sum(s12) * sum(s12)) AS b1,
            (sum(s2y) * sum(s11) - sum(s1y) * sum(s12)) / (sum(s11) * sum(s22) - sum(s12) * sum(s12)) AS b2
          FROM lev GROUP BY seed),
wide AS (SELECT xs.*, y0 AS p0, my + a1 * (x1 - m1_) AS pa,
           my + b1 * (x1 - m1_) + b2 * (x2 - m2_) AS pb
         FROM xs JOIN tot ON xs.seed = tot.seed JOIN slope ON xs.seed = slope.seed
         JOIN lev ON xs.seed = lev.seed AND xs.segment = lev.segment
         WHERE is_test),
pred AS (SELECT *, 'baseline' AS model, p0 AS prediction FROM wide
         UNION ALL SELECT *, 'model_a', pa FROM wide
         UNION ALL SELECT *, 'model_b', pb FROM wide)"""
ACCURACY = """count(*) AS n,
  CASE WHEN max(target) > min(target)
    THEN 1.0 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*))
    WHEN sum(abs(target - prediction)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  avg(abs(target - prediction)) AS mae,
  sqrt(avg((target - prediction) * (target - prediction))) AS rmse"""


def held(unit: str = "group_id", seeds: str = "[42]", frame: str = FRAME) -> str:
    return f"{frame}, {folds(unit, seeds)}, {FITS}"


ROUNDED = f"n, {near('r2')} AS r2, {near('mae')} AS mae, {near('rmse')} AS rmse"
ORACLES["baseline_eval"] = f"""{held()},
e AS (SELECT seed, model, {ACCURACY} FROM pred WHERE model = 'baseline' GROUP BY seed, model)
SELECT seed, model, {ROUNDED} FROM e"""
GAPS = FRAME.replace(
    "score::DOUBLE AS target, nullif(measure, 0.0) AS measure",
    "CASE WHEN item % 5 <> 0 THEN score::DOUBLE END AS target, "
    "CASE WHEN item % 7 <> 0 THEN nullif(measure, 0.0) END AS measure",
)
# rows without a target take part in the split, not in fits and metrics
HELD_GAPS = f"""{GAPS}, {folds()},
known AS (SELECT * FROM rows_ WHERE target IS NOT NULL), {FITS.replace("rows_", "known")}"""
MODEL_EVAL = "{held},\ne AS (SELECT model, {accuracy} FROM pred GROUP BY model)\n" + _union(
    [
        f"SELECT '{m}' AS metric, "
        + ", ".join(
            f"{near(f"max({m}) FILTER (WHERE model = '{name}')")} AS {name}"
            for name in ("baseline", "model_a", "model_b")
        )
        + " FROM e"
        for m in ("n", "r2", "mae", "rmse")
    ]
)
ORACLES["model_eval"] = MODEL_EVAL.format(held=held(), accuracy=ACCURACY)
ORACLES["model_eval_gaps"] = MODEL_EVAL.format(held=HELD_GAPS, accuracy=ACCURACY)
ORACLES["onehot_fit"] = f"""{FRAME}, {folds()},
fit AS (SELECT segment, avg(target) AS y FROM rows_ WHERE NOT is_test GROUP BY segment)
SELECT t.segment, {near("max(y)")} AS fitted, count(*) AS n
FROM rows_ t JOIN fit ON t.segment = fit.segment WHERE is_test GROUP BY t.segment"""
# with one categorical only, the contrasts are differences of the levels' means
ORACLES["coef_ends"] = f"""{FRAME}, {folds(seeds="[7, 42]")},
lev AS (SELECT seed, category_ AS level, avg(target) AS y FROM rows_ WHERE NOT is_test GROUP BY seed, category_),
c AS (SELECT a.seed, a.level, a.y - b.y AS coef FROM lev a JOIN lev b ON a.seed = b.seed AND b.level = 'Unknown'),
e AS (SELECT * FROM c WHERE level <> 'Unknown'
      QUALIFY row_number() OVER (PARTITION BY seed ORDER BY coef DESC, level) <= 2
           OR row_number() OVER (PARTITION BY seed ORDER BY coef, level) <= 2)
SELECT seed, 'levels' AS model, 'level' AS kind, 'category' AS feature, level, {near("coef")} AS coef FROM e
UNION ALL
SELECT seed, 'levels', 'reference', 'category', level, {near("coef")} FROM c WHERE level = 'Unknown'"""
SWEEP = f"""{held(seeds=SEEDS)},
e AS (SELECT seed, model, {ACCURACY} FROM pred GROUP BY seed, model),
comp AS (SELECT seed, {num("NOT is_test")} AS n_train, {num("is_test")} AS n_test,
           count(DISTINCT group_id) FILTER (WHERE NOT is_test) AS n_train_groups,
           count(DISTINCT group_id) FILTER (WHERE is_test) AS n_test_groups,
           avg(target) FILTER (WHERE is_test) AS test_mean_target
         FROM rows_ GROUP BY seed),
sw AS (SELECT seed, {", ".join(
    f"max({m}) FILTER (WHERE model = '{name}') AS {name}_{m}"
    for name in ("baseline", "model_a", "model_b") for m in ("r2", "mae", "rmse"))}
  FROM e GROUP BY seed)"""
ORACLES["sweep"] = f"""{SWEEP}
SELECT sw.seed, n_train, n_test, n_train_groups, n_test_groups, {near("test_mean_target")} AS test_mean_target,
       {", ".join(f"{near(f'{name}_{m}')} AS {name}_{m}"
                  for name in ("baseline", "model_a", "model_b") for m in ("r2", "mae", "rmse"))}
FROM sw JOIN comp ON sw.seed = comp.seed"""
_FACTS = [
    (name, f"{how}_{m}", f"{how}({name}_{m})")
    for name in ("model_a", "model_b")
    for how, m in (("median", "r2"), ("min", "r2"), ("max", "r2"), ("median", "mae"), ("median", "rmse"))
] + [
    ("split_composition", f"{c}_{how}", f"{how}({c})")
    for c in ("n_test", "n_test_groups", "test_mean_target")
    for how in ("min", "max")
]
ORACLES["sweep_summary"] = f"""{SWEEP}, j AS (SELECT * FROM sw JOIN comp USING (seed))\n""" + _union(
    [f"SELECT '{s}' AS subject, '{f}' AS fact, {near(e)} AS value FROM j" for s, f, e in _FACTS]
)
_NUMERIC = ("m1", "m2", "measure", "size_scaled", "creator_score")
ORACLES["model_conditions"] = f"{FRAME}, {folds()}\n" + _union(
    [
        f"""SELECT '{c}' AS feature, NULL::VARCHAR AS level, count(*) AS n_train, true AS is_zero
            FROM rows_ WHERE NOT is_test"""
        for c in _NUMERIC
    ]
    + [
        f"""SELECT '{name}', CAST({c} AS VARCHAR), count(*), true FROM rows_ WHERE NOT is_test
            GROUP BY {c}"""
        for name, c in (("segment", "segment"), ("category", "category_"), ("period", "period"))
    ]
)
ORACLES["placeholder_search"] = f"""WITH {LINES},
c AS (SELECT creator AS label, count(*) AS n_rows FROM lines GROUP BY creator),
m AS (SELECT *, CASE WHEN regexp_matches(lower(trim(label)), '^supplier#0+[0-3]$') THEN '^supplier#0+[0-3]$'
                     WHEN regexp_matches(lower(trim(label)), '^supplier#0*1?5$') THEN '^supplier#0*1?5$' END AS pattern
      FROM c)
SELECT label, pattern, n_rows, label IN {PLACEHOLDERS} AS is_listed FROM m WHERE pattern IS NOT NULL"""
ORACLES["saved_model_eval"] = ORACLES["model_eval"]
# two standardised features: everything follows from three correlations
PAIR = f"""{FRAME}, {folds()},
s AS (SELECT count(*)::DOUBLE AS n, avg(target) AS my, var_pop(target) AS vy, corr(target, m1) AS a,
             corr(target, creator_score) AS b, corr(m1, creator_score) AS r FROM rows_ WHERE NOT is_test),
q AS (SELECT *, (a * a + b * b - 2 * a * b * r) / (1 - r * r) AS r2, n - 3 AS df FROM s),
v AS (SELECT *, n * vy * (1 - r2) / df AS s2 FROM q)"""
ORACLES["ols_pair_inference"] = f"""{PAIR},
t AS (SELECT 'const' AS term, my AS coef, sqrt(s2 / n) AS se, df FROM v UNION ALL
      SELECT 'm1', sqrt(vy) * (a - r * b) / (1 - r * r), sqrt(s2 / n / (1 - r * r)), df FROM v UNION ALL
      SELECT 'creator_score', sqrt(vy) * (b - r * a) / (1 - r * r), sqrt(s2 / n / (1 - r * r)), df FROM v),
-- the tail by Simpson's rule, the critical value by its expansion around the normal one
p AS (SELECT term, sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
             * pow(1 + pow(abs(coef / se) + i * 0.005, 2) / df, -(df + 1) / 2)) * 2 * 0.005 / 3 AS p_value
      FROM t, (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
               FROM range(4001) AS x(i)) GROUP BY term),
k AS (SELECT *, z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) AS reach
      FROM t, (SELECT 1.959963984540054 AS z))
SELECT term, {near("coef")} AS coef, {near("se")} AS std_error, {near("coef / se")} AS t_value,
       {near("p_value")} AS p_value, {near("coef - reach * se")} AS ci_low, {near("coef + reach * se")} AS ci_high
FROM k JOIN p USING (term)"""
# with two features the tail of F has a closed form
ORACLES["ols_pair_statistics"] = f"""{PAIR},
fv AS (SELECT *, r2 / 2 / ((1 - r2) / df) AS fvalue FROM v)
SELECT 'f_value' AS statistic, {near("fvalue")} AS value FROM fv UNION ALL
SELECT 'f_p_value', {near("pow(1 + 2 * fvalue / df, -df / 2)")} FROM fv UNION ALL
SELECT 'r2', {near("r2")} FROM fv UNION ALL
SELECT 'condition_number', {near("sqrt((1 + abs(r)) / (1 - abs(r)))")} FROM fv"""
_WIDE_FRAME = FRAME.replace("size_scaled, creator,", "size_scaled, coalesce(creator, 'Unknown') AS seller, item AS part,")
ORACLES["wide_fit"] = f"{_WIDE_FRAME}, {folds('row_key', SEEDS)}\n" + _union(
    [
        f"""SELECT seed, '{c}' AS feature, 1::BIGINT AS n_levels, count(*) AS n_train, true AS is_zero
            FROM rows_ WHERE NOT is_test GROUP BY seed"""
        for c in ("measure", "m1")
    ]
    + [
        f"""SELECT seed, '{c}', count(DISTINCT {c}), count(*), true FROM rows_ WHERE NOT is_test
            GROUP BY seed"""
        for c in ("seller", "part")
    ]
)
CONTRASTS = f"""
con AS (SELECT lev.seed, lev.segment, lev.n, lev.m1_, lev.m2_, lev.my, ref.n AS ref_n,
          ref.m1_ AS ref_m1, lev.my - a1 * lev.m1_ - (ref.my - a1 * ref.m1_) AS ca,
          lev.my - b1 * lev.m1_ - b2 * lev.m2_ - (ref.my - b1 * ref.m1_ - b2 * ref.m2_) AS cb
        FROM lev JOIN lev ref ON lev.seed = ref.seed AND ref.segment = 'N'
        JOIN slope ON lev.seed = slope.seed)"""
ORACLES["coefs"] = f"""{held()}, {CONTRASTS}
SELECT slope.seed, 'model_a' AS model, 'numeric' AS kind, 'measure' AS feature,
       NULL::VARCHAR AS level, {near("a1 * sd1")} AS coef FROM slope JOIN tot ON slope.seed = tot.seed
UNION ALL SELECT slope.seed, 'model_b', 'numeric', 'measure', NULL, {near("b1 * sd1")}
  FROM slope JOIN tot ON slope.seed = tot.seed
UNION ALL SELECT slope.seed, 'model_b', 'numeric', 'creator_score', NULL, {near("b2 * sd2")}
  FROM slope JOIN tot ON slope.seed = tot.seed
UNION ALL SELECT seed, 'model_a', CASE WHEN segment = 'N' THEN 'reference' ELSE 'level' END,
  'segment', segment, {near("ca")} FROM con
UNION ALL SELECT seed, 'model_b', CASE WHEN segment = 'N' THEN 'reference' ELSE 'level' END,
  'segment', segment, {near("cb")} FROM con"""
OLS = f"""{held()}, {CONTRASTS},
fitted AS (SELECT xs.*, my + a1 * (x1 - m1_) AS p FROM xs JOIN slope ON xs.seed = slope.seed
           JOIN lev ON xs.seed = lev.seed AND xs.segment = lev.segment WHERE NOT is_test),
o AS (SELECT count(*) AS n, count(DISTINCT segment) AS w, sum((target - p) * (target - p)) AS sse,
        var_pop(target) * count(*) AS sst FROM fitted),
within_ AS (SELECT sum(s11) AS sxx FROM lev),
s AS (SELECT o.*, sxx, sse / (n - w - 1) AS s2 FROM o, within_)"""
ORACLES["reduced_ols"] = f"""{OLS},
t AS (
  SELECT 'measure' AS term, a1 * sd1 AS coef, sqrt(s2 / sxx) * sd1 AS std_error FROM slope, tot, s
  UNION ALL SELECT 'segment=' || segment, ca,
    sqrt(s2 * (1.0::DOUBLE / con.n + 1.0::DOUBLE / ref_n + (m1_ - ref_m1) * (m1_ - ref_m1) / sxx))
    FROM con, s WHERE segment <> 'N'
  UNION ALL SELECT 'const', my + a1 * (mean1 - m1_),
    sqrt(s2 * (1.0::DOUBLE / lev.n + (mean1 - m1_) * (mean1 - m1_) / sxx))
    FROM lev, slope, tot, s WHERE segment = 'N')
SELECT term, {near("coef")} AS coef, {near("std_error")} AS std_error, {near("coef / std_error")} AS t_value FROM t"""
_LL = "(-n / 2.0::DOUBLE * (ln(2 * pi()) + ln(sse / n) + 1))"
_STATISTICS = {
    "n": "n",
    "df_model": "w",
    "df_error": "n - w - 1",
    "r2": "1 - sse / sst",
    "adj_r2": "1 - (sse / sst) * (n - 1) / (n - w - 1)",
    "f_value": "(sst - sse) / w / (sse / (n - w - 1))",
    "log_likelihood": _LL,
    "aic": f"-2 * {_LL} + 2 * (w + 1)",
    "bic": f"-2 * {_LL} + ln(n) * (w + 1)",
}
ORACLES["reduced_ols_statistics"] = f"{OLS}\n" + _union(
    [f"SELECT '{k}' AS statistic, {near(e, 4)} AS value FROM s" for k, e in _STATISTICS.items()]
)

# --- diagnostics ----------------------------------------------------------

ORACLES["bound_diag"] = f"""{held(seeds=SEEDS)}
SELECT seed, model, count(*) AS n, {near("min(prediction)")} AS min_prediction,
       {near("max(prediction)")} AS max_prediction,
       {num("prediction < 0")} AS n_below_0, {pct("prediction < 0", 3)} AS pct_below_0,
       {num("prediction > 100")} AS n_above_100, {pct("prediction > 100", 3)} AS pct_above_100
FROM pred WHERE model <> 'baseline' GROUP BY seed, model"""
ORACLES["range_compression"] = f"""{held()}
SELECT model, {near("min(prediction)")} AS min_prediction, {near("max(prediction)")} AS max_prediction,
       {near("stddev_pop(prediction)")} AS sd_prediction, {near("min(target)")} AS min_target,
       {near("max(target)")} AS max_target, {near("stddev_pop(target)")} AS sd_target
FROM pred GROUP BY model"""
ORACLES["tier_compression"] = f"""{held()}
SELECT model, CASE WHEN target <= 33 THEN 'low' WHEN target <= 66 THEN 'moderate' ELSE 'high' END AS tier,
       count(*) AS n, {near("avg(abs(target - prediction))")} AS mae,
       {near("avg(prediction)")} AS mean_prediction, {near("avg(target)")} AS mean_target
FROM pred GROUP BY ALL"""
RESIDUALS = f"""{near("avg(abs(target - prediction))")} AS mae, {near("avg(prediction - target)")} AS bias,
       count(*) AS n"""
ORACLES["residuals_segment"] = f"""{held()}
SELECT model, segment, {RESIDUALS} FROM pred GROUP BY model, segment"""
ORACLES["residuals_known"] = f"""{FRAME}, {folds()},
fit AS (SELECT category_, avg(target) AS y FROM rows_ WHERE NOT is_test GROUP BY category_),
pred AS (
  SELECT 'by_category' AS model, t.category_, target, y AS prediction
  FROM rows_ t JOIN fit ON t.category_ = fit.category_ WHERE is_test
  UNION ALL SELECT 'baseline', category_, target, (SELECT avg(target) FROM rows_ WHERE NOT is_test)
  FROM rows_ WHERE is_test)
SELECT model, category_ <> 'Unknown' AS category_known, {RESIDUALS} FROM pred GROUP BY ALL"""
ORACLES["creator_buckets"] = f"""{held(frame=ORDER_FRAME)},
cnt AS (SELECT creator, count(*) AS k FROM mf
        WHERE creator IS NOT NULL AND creator NOT IN {ORDER_PLACEHOLDERS} GROUP BY creator),
b AS (SELECT pred.*, CASE WHEN k <= 1 THEN '1' WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5'
        WHEN k <= 20 THEN '6-20' WHEN k <= 100 THEN '21-100' ELSE '100+' END AS bucket
      FROM pred JOIN cnt ON pred.creator = cnt.creator),
e AS (SELECT model, bucket, {ACCURACY} FROM b GROUP BY model, bucket)
SELECT model, bucket, n, {near("r2")} AS r2, {near("mae")} AS mae FROM e"""
_LEFT_OUT = f"creator IS NULL OR creator IN {PLACEHOLDERS}"
ORACLES["bucket_exclusions"] = f"""{held()}
SELECT model, {num(_LEFT_OUT)} AS n_excluded, {pct(_LEFT_OUT, 1)} AS pct_excluded
FROM pred GROUP BY model"""
_ONE = "coalesce(creator = 'Supplier#000000000', false)"
ORACLES["creator_exclusion"] = f"""{held()},
e AS (SELECT model, {ACCURACY} FROM pred GROUP BY model),
x AS (SELECT model, {ACCURACY} FROM pred WHERE NOT {_ONE} GROUP BY model),
s AS (SELECT model, avg(CASE WHEN {_ONE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0 AS p FROM pred GROUP BY model)
SELECT e.model, e.n, {near("e.r2")} AS r2_full, x.n AS n_without, {near("x.r2")} AS r2_without,
       {near("p")} AS creator_pct
FROM e JOIN x ON e.model = x.model JOIN s ON e.model = s.model"""
ORACLES["label_inspection"] = f"{FRAME}\n" + _union(
    [
        f"""SELECT '{c}' AS measure, count({c}) AS n, count(DISTINCT {c}) AS n_distinct,
            {near(f"min({c})")} AS "min", {near(f"max({c})")} AS "max", {near(f"avg({c})")} AS "mean",
            {near(f"stddev_samp({c})")} AS sd, {near(f"median({c})")} AS "median"
            FROM mf WHERE creator = 'Supplier#000000000'"""
        for c in ("creator_score", "target")
    ]
)
ORACLES["label_top_values"] = f"""{FRAME}
SELECT target, count(*) AS n FROM mf WHERE creator = 'Supplier#000000000'
GROUP BY target ORDER BY n DESC, target LIMIT 3"""
ORACLES["density2d"] = f"""{held()}
SELECT model, CAST(least(floor(target / 2.5::DOUBLE), 39) AS BIGINT) AS bin_target,
       CAST(least(floor(least(greatest(prediction, 0), 100) / 2.5::DOUBLE), 39) AS BIGINT) AS bin_prediction,
       count(*) AS n
FROM pred GROUP BY ALL"""
ORACLES["split_comparison"] = f"""WITH g AS (
  {held(seeds=SEEDS)} SELECT seed, model, {ACCURACY} FROM pred GROUP BY seed, model),
rnd AS ({held("row_key")} SELECT model, {ACCURACY} FROM pred GROUP BY model)
SELECT g.model, {near("median(g.r2)")} AS grouped_median_r2,
       {near("max(g.r2) FILTER (WHERE g.seed = 42)")} AS grouped_seed_r2, {near("max(rnd.r2)")} AS random_seed_r2
FROM g JOIN rnd ON g.model = rnd.model WHERE g.model <> 'baseline' GROUP BY g.model"""
SENS_FRAME = FRAME.replace("FROM f WHERE period", "FROM sens WHERE period").replace(
    ",\nmf AS", f", {ONE_PER_KEY},\nmf AS"
)
ORACLES["sensitivity_model"] = f"""WITH a AS (
  {held()} SELECT seed, model, {ACCURACY} FROM pred GROUP BY seed, model),
b AS ({held(frame=SENS_FRAME)} SELECT seed, model, {ACCURACY} FROM pred GROUP BY seed, model)
SELECT 'primary' AS dataset, seed, model, {ROUNDED} FROM a WHERE model <> 'baseline'
UNION ALL SELECT 'sensitivity', seed, model, {ROUNDED} FROM b WHERE model <> 'baseline'"""
