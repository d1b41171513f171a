"""Validated load of delimited text with a declared layout.

Nothing is inferred: every field is read as text under the declared names,
then missing tokens become NULL and fields are cast to their declared types.
The files are read in parallel splits, so header and type-declaration lines
are told from data by their content, not by line number. Files in which a quoted
field goes on over a line break are found by it and read again, each as a whole.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.expressions import all_of, count_where, flag
from tallybook.session import materialise

_LINE = "_line"
_FILE = "_file"
_KIND = "_kind"
_FAILED = "_failed"
EXAMPLES = 5

# Literal missing tokens, then the default tokens of data frames.
LITERAL_MISSING = ("Missing", "missing", "MISSING", "N/A", "n/a", "NA")
DEFAULT_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Words a type-declaration line is made of.
TYPE_WORDS = ("string", "numeric", "categorical")


class RawDataError(Exception):
    """A raw file cannot be trusted."""


class SchemaError(RawDataError):
    """Columns or row count differ from the layout."""


@dataclass(frozen=True)
class CsvLayout:
    """Columns in file order with their types, and how the text is written."""

    columns: tuple[tuple[str, str], ...]
    required: tuple[str, ...] = ()
    expected_rows: int | None = None
    missing: tuple[str, ...] = tuple(dict.fromkeys(LITERAL_MISSING + DEFAULT_MISSING))
    type_words: tuple[str, ...] = TYPE_WORDS
    separator: str = ","
    # Whole-file parsing of every file, which gives up splitting. Without it only files
    # with quoted line breaks are read so.
    multi_line: bool = False

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]


def _reader(spark: SparkSession, layout: CsvLayout):
    return spark.read.options(
        sep=layout.separator, quote='"', escape='"', multiLine=layout.multi_line
    )


def read_fields(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """Every line as text fields, with its raw text if its width is off."""
    fields = [T.StructField(name, T.StringType()) for name in layout.names]
    schema = T.StructType([*fields, T.StructField(_LINE, T.StringType())])
    return (
        _reader(spark, layout)
        .schema(schema)
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, columnPruning=False)
        .csv(path)
        .withColumn(_FILE, F.col("_metadata.file_path"))
    )


def _field_count(line: Column, separator: str) -> Column:
    unquoted = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator))) + 1


def is_too_wide(layout: CsvLayout) -> Column:
    """More fields than columns. Short lines are padded with NULL and kept.

    Only lines Spark already marked are measured, so well-formed lines cost
    nothing here.
    """
    wide = _field_count(F.col(_LINE), layout.separator) > len(layout.columns)
    return F.when(F.col(_LINE).isNotNull(), wide).otherwise(F.lit(False))


def is_header(layout: CsvLayout) -> Column:
    return all_of([F.col(name).eqNullSafe(name) for name in layout.names])


def is_type_line(layout: CsvLayout) -> Column:
    words = [F.coalesce(F.col(name).isin(*layout.type_words), F.lit(False)) for name in layout.names]
    return all_of(words)


def standardise_missing(df: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """Whole-value missing tokens of every string column become NULL."""
    return df.select(
        *(
            F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def _typed(name: str, kind: str) -> Column:
    """The text column as `kind`; what does not parse is NULL, as is NaN."""
    text = F.col(name)
    if kind in ("int", "bigint"):
        # "2010.0" is a whole number written as a double, 2.7 is none
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(text.try_cast(kind), whole)
    if kind == "double":
        number = text.try_cast("double")
        return F.when(~F.isnan(number), number)
    return text.try_cast(kind)


def cast_fields(df: DataFrame, layout: CsvLayout) -> DataFrame:
    """Declared types; a value that does not parse is NULL, as is NaN."""
    return df.select(*(_typed(name, kind).alias(name) for name, kind in layout.columns))


def check_columns(found: list[str], layout: CsvLayout) -> None:
    """Ordered column check, then the required subset."""
    if found != layout.names:
        missing = sorted(set(layout.names) - set(found))
        extra = sorted(set(found) - set(layout.names))
        raise SchemaError(
            f"columns differ from the layout: missing {missing}, extra {extra}, "
            f"same names in another order: {not missing and not extra}"
        )
    absent = [name for name in layout.required if name not in found]
    if absent:
        raise SchemaError(f"required columns absent: {absent}")


def header_of(spark: SparkSession, path: str, layout: CsvLayout) -> list[str]:
    """Column names of the first file."""
    return _reader(spark, layout).option("header", True).csv(path).columns


def load_profile(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """One row: data rows, bad rows, one bad example, files without the header."""
    header, kinds, wide = is_header(layout), is_type_line(layout), is_too_wide(layout)
    by_file = (
        read_fields(spark, path, layout)
        .groupBy(_FILE)
        .agg(count_where(header).alias("headers"), *_line_counts(header, kinds, wide))
    )
    return by_file.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_malformed").alias("n_malformed"),
        F.min("example").alias("example"),
        count_where(F.col("headers") != 1).alias("n_files_without_header"),
    )


def _line_counts(header: Column, kinds: Column, wide: Column) -> list[Column]:
    return [
        count_where(~header & ~kinds & ~wide).alias("n_rows"),
        count_where(wide).alias("n_malformed"),
        F.min(F.when(wide, F.col(_LINE))).alias("example"),
    ]


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def has_open_quote(layout: CsvLayout) -> Column:
    """A quote that the line does not close, or a field with a stray one: a quoted line
    break may have been taken for the end. Then the file is worth a whole reading."""
    stray = [F.coalesce(F.instr(F.col(name), '"') > 0, F.lit(False)) for name in layout.names]
    return reduce(or_, stray) | flag(_quotes(F.col(_LINE)) % 2 == 1)


def _unclosed(layout: CsvLayout) -> Column:
    """A quote that a file read as a whole does not close: the last field swallowed at least
    one whole line up to the file's end."""
    line = f"\n([^\n]*{re.escape(layout.separator)}){{{len(layout.columns) - 1}}}[^\n]*\n$"
    return flag(F.col(layout.names[-1]).rlike(line)) | flag(_quotes(F.col(_LINE)) % 2 == 1)


@dataclass(frozen=True)
class LoadCounts:
    """What a load found: lines by kind, and values that do not parse by column."""

    n_rows: int
    n_malformed: int
    n_headers: int
    n_type_lines: int
    n_open: int
    example: str | None
    failed: dict[str, int]

    def plus(self, other: LoadCounts) -> LoadCounts:
        return LoadCounts(
            *(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)[:5]),
            min((e for e in (self.example, other.example) if e is not None), default=None),
            {c: self.failed[c] + other.failed[c] for c in self.failed},
        )


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    counts: LoadCounts


def _facts(layout: CsvLayout, failed: dict[str, Column]) -> list[Column]:
    """The counts of a load as aggregates; `failed` tells rows whose value does not parse."""
    kinds = [count_where(F.col(_KIND) == k).alias(k) for k in ("data", "wide", "header", "types", "open")]
    bad = [count_where(failed[name]).alias(f"f{i}") for i, name in enumerate(layout.names)]
    return [*kinds, F.min(_LINE).alias("example"), *bad]


def _counts(found: dict, layout: CsvLayout) -> LoadCounts:
    return LoadCounts(
        *(found.get(k) or 0 for k in ("data", "wide", "header", "types", "open")),
        found.get("example"),
        {name: found.get(f"f{i}") or 0 for i, name in enumerate(layout.names)},
    )


def _written(lines: DataFrame, layout: CsvLayout) -> tuple[DataFrame, LoadCounts]:
    """All lines with kind and file, written once; they are counted as they are written."""
    opened = _unclosed(layout) if layout.multi_line else has_open_quote(layout)
    kind = (
        F.when(is_header(layout), "header")
        .when(is_type_line(layout), "types")
        .when(opened, "open")
        .when(is_too_wide(layout), "wide")
        .otherwise("data")
    )
    known = standardise_missing(lines.withColumn(_KIND, kind), layout.missing)
    typed = {name: _typed(name, kind) for name, kind in layout.columns}
    failed = {
        name: (F.col(_KIND) == "data") & F.col(name).isNotNull() & value.isNull() for name, value in typed.items()
    }
    odd = F.coalesce(F.col(_LINE), F.col(layout.names[-1]))
    known = known.withColumn(_LINE, F.when(F.col(_KIND).isin("wide", "open"), odd))
    names = F.filter(F.array(*(F.when(f, F.lit(n)) for n, f in failed.items())), lambda n: n.isNotNull())
    seen = Observation()
    table = known.observe(seen, *_facts(layout, failed)).select(
        *(value.alias(name) for name, value in typed.items()),
        _KIND,
        _FILE,
        _LINE,
        F.when(F.size(names) > 0, names).alias(_FAILED),
    )
    table = materialise(table)
    return table, _counts(seen.get, layout)


def load_counted(
    spark: SparkSession, path: str | list[str], layout: CsvLayout, validate_shape: bool = True
) -> Loaded:
    """Typed rows of all files under `path`, and the counts of what was found.

    The text is parsed a single time: all lines are written with their kind and file, and
    counted on the way. If lines leave a quote open, their files are read again as whole
    files and take the place of what was read of them. Lines with too many fields are left
    out with a warning that counts them, values that do not parse are NULL with a warning
    that counts them per column. A quote that is never closed raises `RawDataError`. With
    `validate_shape`, a wrong column list, header, row count or more than one type line in
    a file raises `SchemaError`; check digests beforehand with `sources.manifest`.
    """
    if validate_shape:
        check_columns(header_of(spark, path, layout), layout)
    source = read_fields(spark, path, layout)
    lines, counts = _written(source, layout)
    if counts.n_open and not layout.multi_line:
        torn = [r[_FILE] for r in lines.where(F.col(_KIND) == "open").select(_FILE).distinct().collect()]
        whole = replace(layout, multi_line=True)
        again, counts = _written(read_fields(spark, torn, whole), whole)
        lines = lines.where(~F.col(_FILE).isin(torn))
        failed = {n: F.coalesce(F.array_contains(_FAILED, n), F.lit(False)) for n in layout.names}
        counts = counts.plus(_counts(lines.agg(*_facts(layout, failed)).first().asDict(), layout))
        lines = lines.unionByName(again)
    _check_counts(lines, len(source.inputFiles()), counts, path, layout, validate_shape)
    return Loaded(lines.where(F.col(_KIND) == "data").select(*layout.names), counts)


def load_raw(
    spark: SparkSession, path: str | list[str], layout: CsvLayout, validate_shape: bool = True
) -> DataFrame:
    """The rows of `load_counted`."""
    return load_counted(spark, path, layout, validate_shape).rows


def _check_counts(
    lines: DataFrame, files: int, counts: LoadCounts, path, layout: CsvLayout, validate_shape: bool
) -> None:
    """Warn of lines and values left out; raise if the files cannot be trusted."""
    if counts.n_open:
        raise RawDataError(
            f"{counts.n_open} record(s) of {path} never close a quote, one of them {counts.example!r}"
        )
    if counts.n_malformed:
        warnings.warn(
            f"{counts.n_malformed} malformed row(s) left out of {path}; one of them: {counts.example!r}",
            stacklevel=4,
        )
    failed = {c: n for c, n in sorted(counts.failed.items()) if n}
    if failed:
        told = ", ".join(f"{c}: {n}" for c, n in failed.items())
        warnings.warn(f"value(s) of {path} that do not parse are NULL ({told})", stacklevel=4)
    if not validate_shape:
        return
    if files > 1 or counts.n_headers != 1 or counts.n_type_lines > 1:
        # told apart by file where totals could hide a fault: few lines, two narrow columns
        by_file = lines.where(F.col(_KIND).isin("header", "types")).groupBy(_FILE).agg(
            count_where(F.col(_KIND) == "header").alias("headers"),
            count_where(F.col(_KIND) == "types").alias("types"),
        )
        found = by_file.agg(
            count_where(F.col("headers") == 1).alias("headed"), count_where(F.col("types") > 1).alias("typed")
        ).first()
        if found.headed != files:
            raise SchemaError(f"{files - found.headed} file(s) without the header line")
        if found.typed:
            raise SchemaError(f"{found.typed} file(s) with more than one type line")
    if layout.expected_rows is not None and counts.n_rows != layout.expected_rows:
        raise SchemaError(f"expected {layout.expected_rows} rows, found {counts.n_rows}")


def malformed_rows(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """Raw text of every line with too many fields."""
    # Spark refuses to read the raw text of a line without one of its fields
    any_field = F.length(F.coalesce(F.col(layout.names[0]), F.lit(""))) >= 0
    return (
        read_fields(spark, path, layout)
        .where(is_too_wide(layout) & any_field)
        .select(F.col(_FILE).alias("file"), F.col(_LINE).alias("line"))
    )


def malformed_row_report(spark: SparkSession, path: str, layout: CsvLayout) -> DataFrame:
    """One row: how many malformed lines, and the first few of them."""
    bad = malformed_rows(spark, path, layout)
    count = bad.agg(F.count(F.lit(1)).alias("n")).withColumn("line", F.lit(None).cast("string"))
    first = bad.orderBy("line").limit(EXAMPLES).select(F.lit(0).cast("bigint").alias("n"), "line")
    return count.unionByName(first).agg(
        F.sum("n").alias("n_malformed"),
        F.sort_array(F.collect_list("line")).alias("examples"),
    )
