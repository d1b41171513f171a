"""Least squares with train-only preprocessing, for many holdouts at once.

A fit needs only sums over the training rows: of the target, the features and their
products. Rows are summed once per cell of the categories and of the seeds' test mask;
the sums of a seed's training side are those of the masks that leave its bit unset. A gap
in a feature is a feature of its own until the seed's median fills it, so rows are never
copied per seed. A narrow design is solved by its normal equations; the contrasts of a
wide one are tables, of whose largest no level comes to the driver (see `wide`).
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators import wide
from tallybook.operators.frame import TARGET
from tallybook.operators.lookup import join_key_values
from tallybook.operators.quantiles import exact_quantiles
from tallybook.operators.splits import MASK, by_seed
from tallybook.session import BROADCAST_BYTES, materialise
from tallybook.spec import ModelSpec

# Cells of the Gram matrices of all seeds that the driver holds; beyond them no matrix is made.
GRAM_CELLS = 4_000_000
# Columns of rows that bring the contrasts of their levels with them.
BROUGHT = "_contrasts_"
# Bytes of one line of contrasts, about.
LINE_BYTES = 64
BASELINE = ModelSpec("baseline")


class DesignError(ValueError):
    """The training rows do not support the design."""


@dataclass(frozen=True, slots=True)
class Term:
    """One column of the design and its coefficient (0 for a reference)."""

    kind: str
    feature: str
    level: str | None
    coef: float

    @property
    def name(self) -> str:
        return self.feature if self.level is None else f"{self.feature}={self.level}"


@dataclass(frozen=True, eq=False)
class Contrasts:
    """The level contrasts of the fits of a wide design, shared by them.

    A feature's table has `level, n, coefs`: `n` rows of the level, and a contrast for each
    system (seed and model), NULL if the level is its reference or not among its training rows.
    """

    tables: dict[str, DataFrame]
    systems: list[tuple[int, str]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex[:8])

    def column(self, feature: str) -> str:
        return f"{BROUGHT}{self.key}_{list(self.tables).index(feature)}"

    def lines(self, fits: list[Fit]) -> DataFrame:
        """`seed, model, feature, level, coef` of the given fits."""
        own = {self.systems.index((f.seed, f.name)): f for f in fits}
        found = None
        for feature, table in self.tables.items():
            of_fit = F.array(
                *(
                    F.struct(F.lit(f.seed).alias("seed"), F.lit(f.name).alias("model"), F.col("coefs")[at].alias("coef"))
                    for at, f in own.items()
                )
            )
            long = table.select(F.lit(feature).alias("feature"), "level", F.inline(of_fit))
            long = long.where(F.col("coef").isNotNull()).select("seed", "model", "feature", "level", "coef")
            found = long if found is None else found.unionByName(long)
        return found

    def terms(self, seed: int, model: ModelSpec) -> list[Term]:
        """The contrasts of one fit, in the order of its features and of their levels."""
        at, terms = self.systems.index((seed, model.name)), []
        for feature in model.categorical:
            known = self.tables[feature].select("level", F.col("coefs")[at].alias("coef")).dropna(subset="coef")
            terms += [Term("level", feature, r.level, r.coef) for r in sorted(known.collect(), key=lambda r: r.level)]
        return terms


class WideTerms(Sequence):
    """Terms of a wide fit: contrasts come to the driver only if someone asks for them."""

    def __init__(self, seed: int, model: ModelSpec, head: list[Term], contrasts: Contrasts):
        self.head, self._made_by = head, lambda: contrasts.terms(seed, model)

    @cached_property
    def _all(self) -> list[Term]:
        numeric = [t for t in self.head if t.kind == "numeric"]
        return numeric + self._made_by() + [t for t in self.head if t.kind == "reference"]

    def __len__(self) -> int:
        return len(self._all)

    def __getitem__(self, at):
        return self._all[at]


@dataclass(frozen=True)
class Fit:
    """A fitted model: numeric features standardised, levels against a reference."""

    seed: int
    model: ModelSpec
    n: int
    intercept: float
    terms: Sequence[Term]
    fills: dict[str, float]
    means: dict[str, float]
    sds: dict[str, float]
    # Gram matrix with constant (none of a wide design), its right-hand side, and sum of squares
    gram: np.ndarray | None = field(repr=False)
    moment: np.ndarray | None = field(repr=False)
    squares: float = field(repr=False)
    # of a wide design the terms of levels, which `terms` brings to the driver
    contrasts: Contrasts | None = field(default=None, repr=False)

    @property
    def name(self) -> str:
        return self.model.name

    @property
    def held(self) -> Sequence[Term]:
        """The terms that the driver holds anyway: all of a narrow design, of a wide one no levels."""
        return self.terms.head if isinstance(self.terms, WideTerms) else self.terms

    @property
    def feature_names(self) -> list[str]:
        """Names in coefficient order, references left out."""
        return [t.name for t in self.terms if t.kind != "reference"]

    @property
    def coefficients(self) -> list[float]:
        return [t.coef for t in self.terms if t.kind != "reference"]


@dataclass
class _Sums:
    """Training sums of one seed; features shifted by a constant, 0 and a mark at gaps."""

    n: float = 0.0
    y: float = 0.0
    yy: float = 0.0
    z: np.ndarray | None = None  # sums of features and gap marks
    zz: np.ndarray | None = None
    zy: np.ndarray | None = None
    levels: dict = field(default_factory=dict)  # (cat, level) -> (n, y, sums of z), none in a wide design
    pairs: dict = field(default_factory=dict)  # (cat, level, cat, level) -> n


@dataclass(frozen=True)
class _Rows:
    """Training rows counted by `key`, and how counts reach the seeds they belong to."""

    rows: DataFrame
    key: str
    expand: Callable[[DataFrame], DataFrame] | None
    seeds: list[int]


def _union(models: list[ModelSpec], pick) -> list[str]:
    return list(dict.fromkeys(c for m in models for c in pick(m)))


def _profile(
    frame: DataFrame, numeric: list[str], categorical: list[str]
) -> tuple[dict[str, float], list[str], list[int]]:
    """A constant near the mean of each feature; the features with gaps; about how many levels a category has."""
    if not numeric and not categorical:
        return {}, [], []
    facts = frame.agg(
        *(F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)),
        *(F.count_if(F.col(c).isNull()).alias(f"g{i}") for i, c in enumerate(numeric)),
        *(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(categorical)),
    ).first()
    shifts = {c: facts[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
    gaps = [c for i, c in enumerate(numeric) if facts[f"g{i}"]]
    return shifts, gaps, [facts[f"d{i}"] for i in range(len(categorical))]


def train_medians(train: _Rows, features: list[str]) -> dict[int, dict[str, float]]:
    """Median of each feature over the training rows of each seed."""
    medians: dict[int, dict[str, float]] = {}
    if not features:
        return medians
    numbers = train.rows.select(train.key, *(F.col(c).cast("double").alias(c) for c in features))
    long = numbers.unpivot([train.key], features, "_feature", "_v")
    keys = ["_feature", "seed"]
    found = exact_quantiles(long, "_v", {"median": 0.5}, ["_feature", train.key], train.expand, keys)
    for row in found.collect():
        medians.setdefault(row.seed, {})[row["_feature"]] = row.median
    return medians


def _sum_rows(train: _Rows, numeric: list[str], gaps: list[str], categorical: list[str], shifts: dict) -> DataFrame:
    """The rows by key, with target, features and categories.

    The features are z0, z1, ...: shifted values with 0 at gaps, then a mark per feature with gaps.
    """
    z = [F.coalesce(F.col(f) - F.lit(shifts[f]), F.lit(0.0)) for f in numeric]
    z += [F.col(f).isNull().cast("double") for f in gaps]
    return train.rows.select(
        F.col(train.key).alias("_key"),
        F.col(TARGET).alias("y"),
        *(value.alias(f"z{i}") for i, value in enumerate(z)),
        *(F.col(f).alias(f"c{i}") for i, f in enumerate(categorical)),
    )


def _cells(train: _Rows, numeric: list[str], gaps: list[str], categorical: list[str], shifts: dict) -> DataFrame:
    """One row per cell of the key and the categories: counts, sums and products."""
    rows = _sum_rows(train, numeric, gaps, categorical, shifts)
    c, names = [f"c{i}" for i in range(len(categorical))], [f"z{i}" for i in range(len(numeric) + len(gaps))]
    products = itertools.combinations_with_replacement(range(len(names)), 2)
    # on the map side first: a cell is sent once per task
    cells = rows.groupBy("_key", *c).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("y"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
        *(F.sum(a).alias(a) for a in names),
        *(F.sum(F.col(a) * F.col("y")).alias(f"{a}y") for a in names),
        *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in products),
    )
    return materialise(cells)


def _margins(
    train: _Rows, cells: DataFrame, sets: list[list[str]], c: list[str], sums: list[str]
) -> Iterator[Row]:
    """Sums of every seed over the margins of the cells that `sets` names, a partition at a time."""
    grouped = [[F.col(name) for name in ["_key", *group]] for group in sets]
    margins = cells.groupingSets(grouped, "_key", *c).agg(
        F.grouping_id().alias("_set"), *(F.sum(name).alias(name) for name in sums)
    )
    if train.expand is None:
        margins = margins.withColumnRenamed("_key", "seed")
    else:
        margins = train.expand(margins.withColumnRenamed("_key", train.key))
        margins = margins.groupBy("seed", "_set", *c).agg(*(F.sum(name).alias(name) for name in sums))
    return materialise(margins).toLocalIterator()


def _training_sums(train: _Rows, cells: DataFrame, k: int, n_cat: int) -> dict[int, _Sums]:
    """Sums of each seed, the pairs of levels left out: as many as the design is wide."""
    c = [f"c{i}" for i in range(n_cat)]
    sums = [name for name in cells.columns if name not in ("_key", *c)]
    result: dict[int, _Sums] = {}
    # one key per level, however many seeds have it
    known: dict[tuple, tuple] = {}
    for row in _margins(train, cells, [[], *([a] for a in c)], c, sums):
        s = result.setdefault(row.seed, _Sums())
        # a set bit of the grouping id means the column is summed over
        used = [i for i in range(n_cat) if not row["_set"] >> (n_cat - 1 - i) & 1]
        z = np.array([row[f"z{i}"] for i in range(k)])
        if used:
            key = (used[0], row[c[used[0]]])
            s.levels[known.setdefault(key, key)] = (float(row.n), row.y, z)
            continue
        s.n, s.y, s.yy, s.z = float(row.n), row.y, row.yy, z
        s.zy = np.array([row[f"z{i}y"] for i in range(k)])
        s.zz = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        s.zz = s.zz.reshape(k, k)
    return result


def _add_pairs(train: _Rows, cells: DataFrame, result: dict[int, _Sums], n_cat: int) -> None:
    """Row counts of pairs of levels."""
    c = [f"c{i}" for i in range(n_cat)]
    sets = [list(pair) for pair in itertools.combinations(c, 2)]
    if not sets:
        return
    for row in _margins(train, cells, sets, c, ["n"]):
        i, j = (i for i in range(n_cat) if not row["_set"] >> (n_cat - 1 - i) & 1)
        result[row.seed].pairs[i, row[c[i]], j, row[c[j]]] = row.n


@dataclass(frozen=True)
class Design:
    """The standardised columns of one seed's training rows, for all features of a query.

    Standardised feature i is `turn[i] @ z + base[i]` of the sums' features z.
    """

    turn: np.ndarray
    base: np.ndarray
    means: np.ndarray
    sds: np.ndarray


def _design(sums: _Sums, numeric: list[str], gaps: list[str], shifts: dict, fills: dict) -> Design:
    p, n = len(numeric), max(sums.n, 1.0)
    turn = np.zeros((p, p + len(gaps)))
    turn[:, :p] = np.eye(p)
    for g, feature in enumerate(gaps):
        turn[numeric.index(feature), p + g] = fills.get(feature, shifts[feature]) - shifts[feature]
    center = turn @ sums.z / n if p else np.zeros(0)
    square = np.diag(turn @ sums.zz @ turn.T) if p else np.zeros(0)
    variance = square / n - center**2
    scale = np.where(variance > 1e-12 * np.maximum(1.0, center**2), np.sqrt(np.maximum(variance, 0)), 1.0)
    means = np.array([shifts[f] for f in numeric]) + center
    return Design(turn / scale[:, None], -center / scale, means, scale)


def _columns(model: ModelSpec, sums: _Sums, categorical: list[str]) -> tuple[list, list[Term]]:
    """The dummies of a model, and the reference levels left out of them."""
    dummies: list[tuple[int, str]] = []
    references: list[Term] = []
    for feature, reference in model.categorical.items():
        i = categorical.index(feature)
        # the keys themselves: they are shared by all seeds
        levels = sorted((key for key in sums.levels if key[0] == i), key=lambda key: key[1])
        if (i, reference) not in sums.levels:
            raise DesignError(f"reference level {reference!r} of {feature} not among training rows")
        dummies += [key for key in levels if key[1] != reference]
        references.append(Term("reference", feature, reference, 0.0))
    return dummies, references


def _fit(
    seed: int, model: ModelSpec, sums: _Sums, made: Design, numeric: list[str], categorical: list[str],
    fills: dict[str, float], intercept: float, coefs: np.ndarray, gram=None, moment=None,
    contrasts: Contrasts | None = None,
) -> Fit:
    k = len(model.numeric)
    terms: Sequence[Term] = [Term("numeric", f, None, float(coefs[a])) for a, f in enumerate(model.numeric)]
    if contrasts is None:
        dummies, references = _columns(model, sums, categorical)
        terms += [
            Term("level", categorical[i], level, float(coefs[b])) for b, (i, level) in enumerate(dummies, start=k)
        ]
        terms += references
    else:
        terms += [Term("reference", f, reference, 0.0) for f, reference in model.categorical.items()]
        terms = WideTerms(seed, model, terms, contrasts)
    at = {f: numeric.index(f) for f in model.numeric}
    means = {f: float(made.means[i]) for f, i in at.items()}
    return Fit(
        seed=seed,
        model=model,
        n=int(sums.n),
        intercept=float(intercept),
        terms=terms,
        # gaps only occur where a training median was taken
        fills={f: fills.get(f, means[f]) for f in model.numeric},
        means=means,
        sds={f: float(made.sds[i]) for f, i in at.items()},
        gram=gram,
        moment=moment,
        squares=float(sums.yy),
        contrasts=contrasts,
    )


def _solve(
    seed: int, model: ModelSpec, sums: _Sums, made: Design, numeric: list[str], categorical: list[str],
    fills: dict[str, float],
) -> Fit:
    """One model solved by its normal equations; on aliased columns with least norm."""
    dummies, _ = _columns(model, sums, categorical)
    xs = [numeric.index(f) for f in model.numeric]
    turn, base, n = made.turn[xs], made.base[xs], sums.n
    k, width = len(xs), len(xs) + len(dummies)
    total, gram, moment = np.zeros(width), np.zeros((width, width)), np.zeros(width)
    if k:
        across = np.outer(turn @ sums.z, base)
        total[:k] = turn @ sums.z + n * base
        gram[:k, :k] = turn @ sums.zz @ turn.T + across + across.T + n * np.outer(base, base)
        moment[:k] = turn @ sums.zy + sums.y * base
    for b, key in enumerate(dummies, start=k):
        count, y, z = sums.levels[key]
        total[b], moment[b], gram[b, b] = count, y, count
        if k:
            gram[:k, b] = gram[b, :k] = turn @ z + count * base
    for (a, (i, li)), (b, (j, lj)) in itertools.combinations(enumerate(dummies, start=k), 2):
        if i != j:
            key = (i, li, j, lj) if i < j else (j, lj, i, li)
            gram[a, b] = gram[b, a] = sums.pairs.get(key, 0)
    centered = gram - np.outer(total, total) / n
    right = moment - total * sums.y / n
    coefs = np.linalg.pinv(centered, rcond=1e-11, hermitian=True) @ right if width else right
    intercept = (sums.y - total @ coefs) / n
    full = np.empty((width + 1, width + 1))
    full[0, 0], full[0, 1:], full[1:, 0], full[1:, 1:] = n, total, total, gram
    return _fit(
        seed, model, sums, made, numeric, categorical, fills, intercept, coefs,
        full, np.concatenate([[sums.y], moment]),
    )


def _fit_all(train: _Rows, models: list[ModelSpec], frame: DataFrame) -> list[Fit]:
    numeric = _union(models, lambda m: m.numeric)
    categorical = _union(models, lambda m: m.categorical)
    # the shift only keeps the sums well conditioned; it cancels in the fit
    shifts, gaps, sizes = _profile(frame, numeric, categorical)
    fills = train_medians(train, gaps)
    k = len(numeric) + len(gaps)
    # an estimate: a design near the limit is measured by its sums
    is_wide = max(1, len(train.seeds)) * (sum(sizes) + len(numeric)) ** 2 > 4 * GRAM_CELLS
    by = [] if is_wide else categorical
    cells = _cells(train, numeric, gaps, by, shifts)
    sums = _training_sums(train, cells, k, len(by))
    made = {
        seed: _design(s, numeric, gaps, shifts, fills.get(seed, {})) for seed, s in sums.items()
    }
    width = max((len(s.levels) + len(numeric) for s in sums.values()), default=0)
    if not is_wide and len(sums) * width * width <= GRAM_CELLS:
        _add_pairs(train, cells, sums, len(categorical))
        return [
            _solve(seed, model, s, made[seed], numeric, categorical, fills.get(seed, {}))
            for seed, s in sorted(sums.items())
            for model in models
        ]
    if not sums:
        return []
    pairs = [(seed, model) for seed in sorted(sums) for model in models]
    systems = [
        wide.System(
            seed,
            [numeric.index(f) for f in model.numeric],
            {categorical.index(f): reference for f, reference in model.categorical.items()},
            made[seed].turn,
            made[seed].base,
            sums[seed],
        )
        for seed, model in pairs
    ]
    rows = _sum_rows(train, numeric, gaps, categorical, shifts)
    bits = None if train.expand is None else train.seeds
    try:
        solved = wide.solve(rows, systems, k, sizes, categorical, bits)
    except (ArithmeticError, LookupError) as error:
        raise DesignError(str(error)) from error
    # the most levels first: rows are not moved for them with the contrasts of others
    widest_first = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tables = {categorical[i]: solved.contrasts[i] for i in widest_first}
    contrasts = Contrasts(tables, [(seed, model.name) for seed, model in pairs])
    return [
        _fit(
            seed, model, sums[seed], made[seed], numeric, [], fills.get(seed, {}), head[0], head[1:],
            contrasts=contrasts,
        )
        for (seed, model), head in zip(pairs, solved.heads)
    ]


def fit_models(rows: DataFrame, models: list[ModelSpec], frame: DataFrame | None = None) -> list[Fit]:
    """Fit every model on the training rows of every seed.

    `rows` are modeling rows with `seed` and `is_test` (see `splits.folds`); `frame`, if
    given, is the same rows once. Medians, means, deviations and level vocabularies come
    from training rows.
    """
    # a row without a target teaches nothing
    train = rows.where(~F.col("is_test") & F.col(TARGET).isNotNull())
    return _fit_all(_Rows(train, "seed", None, []), models, rows if frame is None else frame)


def fit_masked(masked: DataFrame, seeds: list[int], models: list[ModelSpec]) -> list[Fit]:
    """As `fit_models`, on rows with a mask of the seeds that hold them out: no row is copied."""
    train = masked.where(F.col(TARGET).isNotNull())
    rows = _Rows(train, MASK, lambda counts: by_seed(counts, seeds, False), sorted(seeds))
    return _fit_all(rows, models, masked)


SAVED = (
    "seed int, model string, place int, kind string, feature string, level string, coef double, "
    "fill double, mean double, sd double, n long, squares double"
)


def _of_contrasts(fits: list[Fit]) -> list[tuple[Contrasts, list[Fit]]]:
    """The wide fits by the contrasts that they share."""
    shared = {id(f.contrasts): f.contrasts for f in fits if f.contrasts is not None}
    return [(c, [f for f in fits if f.contrasts is c]) for c in shared.values() if c.tables]


def save_fits(spark: SparkSession, fits: list[Fit], path: str) -> None:
    """Write fits as a table: an intercept and every term, features with fill, mean and deviation."""
    lines = []
    for f in fits:
        lines.append((f.seed, f.name, -1, "intercept", None, None, f.intercept, None, None, None, f.n, f.squares))
        for place, t in enumerate(f.held):
            facts = (None, None, None)
            if t.kind == "numeric":
                facts = (f.fills[t.feature], f.means[t.feature], f.sds[t.feature])
            lines.append((f.seed, f.name, place, t.kind, t.feature, t.level, t.coef, *facts, None, None))
    table = spark.createDataFrame(lines, SAVED)
    for contrasts, own in _of_contrasts(fits):
        wide_lines = contrasts.lines(own).withColumn("kind", F.lit("level"))
        table = table.unionByName(wide_lines, allowMissingColumns=True)
    table.write.mode("overwrite").parquet(path)


def load_fits(spark: SparkSession, path: str) -> list[Fit]:
    """Fits as `save_fits` wrote them, ready to predict; without the sums behind standard errors.

    The contrasts of wide fits stay a table, which is written anew.
    """
    fits: list[Fit] = []
    saved = spark.read.schema(SAVED).parquet(path)
    # those of a wide fit have no place
    long = saved.where(F.col("place").isNull())
    kept = saved.where(F.col("place").isNotNull()).orderBy("seed", "model", "place").collect()
    groups = [(key, list(group)) for key, group in itertools.groupby(kept, key=lambda r: (r.seed, r.model))]
    wide_keys = {tuple(r) for r in long.select("seed", "model").distinct().collect()}
    contrasts = None
    if wide_keys:
        systems = [key for key, _ in groups]
        coefs = F.array(
            *(F.max(F.when((F.col("seed") == s) & (F.col("model") == m), F.col("coef"))) for s, m in systems)
        )
        features = list(dict.fromkeys(r.feature for _, g in groups for r in g if r.kind == "reference"))
        tables = {
            feature: materialise(
                long.where(F.col("feature") == feature)
                .groupBy("level")
                .agg(F.count(F.lit(1)).alias("n"), coefs.alias("coefs"))
            )
            for feature in features
        }
        contrasts = Contrasts(tables, systems)
    for (seed, name), (head, *lines) in groups:
        if head.kind != "intercept":
            raise DesignError(f"the saved fit of {name!r} under seed {seed} has no intercept")
        terms: Sequence[Term] = [Term(r.kind, r.feature, r.level, r.coef) for r in lines]
        numeric = [r for r in lines if r.kind == "numeric"]
        references = {t.feature: t.level for t in terms if t.kind == "reference"}
        model = ModelSpec(name, tuple(r.feature for r in numeric), references)
        is_wide = (seed, name) in wide_keys
        fits.append(
            Fit(
                seed=seed,
                model=model,
                n=head.n,
                intercept=head.coef,
                terms=WideTerms(seed, model, list(terms), contrasts) if is_wide else terms,
                fills={r.feature: r["fill"] for r in numeric},
                means={r.feature: r["mean"] for r in numeric},
                sds={r.feature: r["sd"] for r in numeric},
                gram=None,
                moment=None,
                squares=head.squares,
                contrasts=contrasts if is_wide else None,
            )
        )
    return fits


def coefficient_rows(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """Every term of every fit, references with their 0."""
    schema = "seed int, model string, kind string, feature string, level string, coef double"
    rows = [(f.seed, f.name, t.kind, t.feature, t.level, t.coef) for f in fits for t in f.held]
    table = spark.createDataFrame(rows, schema)
    for contrasts, own in _of_contrasts(fits):
        table = table.unionByName(contrasts.lines(own).withColumn("kind", F.lit("level")))
    return table


def numeric_coefficients(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """Per standard deviation; not comparable with the level contrasts."""
    rows = coefficient_rows(spark, fits).where(F.col("kind") == "numeric")
    return rows.select("seed", "model", "feature", "coef").orderBy("seed", "model", "coef")


def level_coefficients(spark: SparkSession, fits: list[Fit], top: int | None = None) -> DataFrame:
    """Contrasts to the reference levels; with `top` only the ends of each fit's list."""
    rows = coefficient_rows(spark, fits).where(F.col("kind") != "numeric")
    if top is not None:
        levels = rows.where(F.col("kind") == "level")
        fit = Window.partitionBy("seed", "model")
        ends = levels.withColumns(
            {
                "_high": F.row_number().over(fit.orderBy(F.desc("coef"), "feature", "level")),
                "_low": F.row_number().over(fit.orderBy("coef", "feature", "level")),
            }
        ).where((F.col("_high") <= top) | (F.col("_low") <= top))
        references = rows.where(F.col("kind") == "reference")
        rows = ends.drop("_high", "_low").unionByName(references)
    return rows.orderBy("seed", "model", F.desc("coef"), "feature", "level")


def _contrasts(fit: Fit, feature: str) -> pa.Table:
    """The level contrasts of one feature, as columns and not as a row object each."""
    terms = [t for t in fit.held if t.kind == "level" and t.feature == feature]
    return pa.table(
        {
            "seed": pa.array([fit.seed] * len(terms), pa.int32()),
            "model": pa.array([fit.name] * len(terms), pa.string()),
            "level": pa.array([t.level for t in terms], pa.string()),
            "contrast": pa.array([t.coef for t in terms], pa.float64()),
        }
    )


def bring_contrasts(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """The rows with the contrasts of their levels, if there are wide fits.

    For rows that are predicted under many seeds: levels are looked up once per row before
    the rows are copied. `predict` knows the columns and leaves them out of its result; it
    looks up levels of rows without them itself.
    """
    for contrasts, _ in _of_contrasts(fits):
        for feature in contrasts.tables:
            rows = _look_up(rows, contrasts, feature)
    return rows


def _look_up(rows: DataFrame, contrasts: Contrasts, feature: str) -> DataFrame:
    """Adds the contrasts of the rows' levels, and the levels that they were looked up by."""
    name = contrasts.column(feature)
    table = contrasts.tables[feature].withColumnsRenamed({"level": feature, "n": f"{name}_n", "coefs": name})
    joined = join_key_values(rows, table, [feature], f"{name}_n").drop(f"{name}_n")
    return joined.withColumn(f"{name}_of", F.col(feature))


def predict(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """Raw predictions of every model for the rows of its seed.

    Adds `model` and `prediction`; a level unseen in training adds nothing. The joined
    tables hold one line per fit or per level; they are sent to all rows if they fit.
    """
    spark = rows.sparkSession
    shown = [c for c in rows.columns if not c.startswith(BROUGHT)]
    numeric = _union([f.model for f in fits], lambda m: m.numeric)
    narrow = [f for f in fits if f.contrasts is None]
    of_contrasts = _of_contrasts(fits)
    parts = ["weight", "fill", "mean"]
    schema = T.StructType(
        [T.StructField("seed", T.IntegerType()), T.StructField("model", T.StringType())]
        + [T.StructField("_intercept", T.DoubleType())]
        + [T.StructField(f"_{p}{i}", T.DoubleType()) for i in range(len(numeric)) for p in parts]
        + [T.StructField(f"_system{i}", T.IntegerType()) for i in range(len(of_contrasts))]
    )
    lines = []
    for f in fits:
        weight = {t.feature: t.coef / f.sds[t.feature] for t in f.held if t.kind == "numeric"}
        line = [f.seed, f.name, f.intercept]
        for c in numeric:
            line += [weight.get(c, 0.0), f.fills.get(c, 0.0), f.means.get(c, 0.0)]
        line += [c.systems.index((f.seed, f.name)) if f.contrasts is c else None for c, _ in of_contrasts]
        lines.append(tuple(line))
    base = F.broadcast(spark.createDataFrame(lines, schema))
    for contrasts, _ in of_contrasts:
        for feature in contrasts.tables:
            if contrasts.column(feature) not in rows.columns:
                rows = _look_up(rows, contrasts, feature)
    scored = rows.join(base, "seed")
    prediction = F.col("_intercept")
    for i, c in enumerate(numeric):
        known = F.coalesce(F.col(c), F.col(f"_fill{i}"))
        prediction = prediction + F.col(f"_weight{i}") * (known - F.col(f"_mean{i}"))
    for i, c in enumerate(_union([f.model for f in narrow], lambda m: m.categorical)):
        parts = [_contrasts(f, c) for f in narrow]
        # in one chunk: Spark reads no chunk that comes after an empty one
        contrasts = pa.concat_tables(parts).combine_chunks()
        contrasts = contrasts.rename_columns(["seed", "model", c, f"_contrast{i}"])
        table = spark.createDataFrame(contrasts)
        side = F.broadcast(table) if contrasts.num_rows * LINE_BYTES <= BROADCAST_BYTES else table
        scored = scored.join(side, ["seed", "model", c], "left")
        prediction = prediction + F.coalesce(F.col(f"_contrast{i}"), F.lit(0.0))
    for i, (contrasts, _) in enumerate(of_contrasts):
        for feature in contrasts.tables:
            name = contrasts.column(feature)
            changed = F.raise_error(F.lit(f"{feature} is not as it was when its contrasts were brought: drop {name}"))
            same = F.col(feature).eqNullSafe(F.col(f"{name}_of")) | F.col(f"_system{i}").isNull()
            coef = F.when(same, F.col(name)[F.col(f"_system{i}")]).otherwise(changed.cast("double"))
            prediction = prediction + F.coalesce(coef, F.lit(0.0))
    return scored.select(*shown, "model", prediction.alias("prediction"))
