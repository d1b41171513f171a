"""Descriptions of a catalog table and of the models fitted on it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CatalogSpec:
    """Which column plays which role, and the constants of the rules.

    The first block names input columns, the second the rule constants, the
    third the columns that cleaning adds.
    """

    item: str
    creator: str
    creator_score: str
    score: str
    category: str
    segment: str
    year: str
    period_fallback: str
    size: str
    measure: str
    band: str | None = None
    domain_column: str | None = None
    # Columns whose values identify a row apart from its outcome. Rows that tie
    # on the documented order are told apart by a hash of these.
    identity: tuple[str, ...] = ()

    score_min: int = 0
    score_max: int = 100
    # Upper-inclusive bounds of all tiers but the last.
    tier_bounds: tuple[int, ...] = (33, 66)
    tier_labels: tuple[str, ...] = ("low", "moderate", "high")
    period_width: int = 10
    size_divisor: float = 60_000.0
    sentinel_year: int = 1899
    cutoff_year: int = 2000
    domain_values: tuple = ()
    min_group_rows: int = 50
    zero_label: str = "zero"
    placeholder_creators: tuple[str, ...] = ()
    # whole labels, in lower case, that name no one creator
    placeholder_patterns: tuple[str, ...] = ()
    unknown_category: str = "Unknown"

    year_value: str = "year_value"
    period: str = "period"
    size_scaled: str = "size_scaled"
    tier: str = "tier"
    is_high: str = "is_high"
    has_category: str = "has_category"
    exact_repeat: str = "exact_repeat"
    key_repeat: str = "key_repeat"
    measure_quality: str = "measure_quality"
    is_sentinel_year: str = "is_sentinel_year"

    @property
    def key(self) -> list[str]:
        return [self.item, self.creator]

    @property
    def high_min(self) -> int:
        """Lowest score of the top tier; tier and flag share this bound."""
        return self.tier_bounds[-1] + 1

    @property
    def derived(self) -> list[str]:
        return [
            self.year_value,
            self.period,
            self.size_scaled,
            self.tier,
            self.is_high,
            self.has_category,
            self.exact_repeat,
            self.key_repeat,
            self.measure_quality,
            self.is_sentinel_year,
        ]

    @property
    def target_derived(self) -> set[str]:
        """Columns that restate the score and so may never be features."""
        return {c for c in (self.band, self.tier, self.is_high) if c}

    def raw_columns(self, columns: list[str]) -> list[str]:
        return [c for c in columns if c not in set(self.derived)]


@dataclass(frozen=True)
class ModelSpec:
    """A linear model: numeric features and categoricals with fixed references."""

    name: str
    numeric: tuple[str, ...] = ()
    # categorical column -> reference level, dropped from the design
    categorical: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def plus(self, name: str, *numeric: str) -> "ModelSpec":
        return ModelSpec(name, (*self.numeric, *numeric), self.categorical)
