"""Run configuration: sizes, quality levels, time window and validation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

# Scale factor per size preset and error rate per quality preset.
SIZES = {"small": 0.2, "medium": 1.0, "large": 5.0}
QUALITY_LEVELS = {"clean": 0.0, "light": 0.02, "moderate": 0.05, "heavy": 0.10}
FORMATS = ("csv", "parquet", "json", "table", "all")

# Entity counts per industry at scale 1.
BASE_COUNTS = {
    "retail": {"customers": 500, "products": 100, "stores": 20, "transactions": 5000},
    "ecommerce": {"customers": 500, "products": 100, "orders": 2000},
    "banking": {"customers": 500, "accounts": 800, "branches": 30, "transactions": 10000},
    "healthcare": {"patients": 500, "doctors": 50, "hospitals": 10, "encounters": 3000},
    "saas": {"customers": 300},
    "logistics": {"routes": 100, "vehicles": 50, "warehouses": 10, "shipments": 5000},
}

# Default bound of an error rate.
MAX_RATE = 0.5


@dataclass(frozen=True)
class GenConfig:
    """Everything one data set depends on. Equal configs give equal rows on any cluster.

    ``counts`` overrides single entity counts; the others follow ``scale``.
    ``as_of`` is the last calendar day. ``growth_dates`` weights dates by the
    compound growth curve instead of drawing them uniformly. ``max_rate`` bounds
    ``quality_rate``. ``keys`` maps entities to one-column tables of their keys 1..n:
    the generated rows then enrich those keys instead of a range.
    """

    industry: str
    size: str = "medium"
    scale: float | None = None
    months: int = 12
    quality: str = "clean"
    quality_rate: float | None = None
    format: str = "parquet"
    output_dir: str = "./output"
    seed: int = 42
    growth_rate: float = 5
    growth_dates: bool = False
    generate_report: bool = True
    as_of: date = date(2025, 1, 31)
    counts: dict = field(default_factory=dict)
    max_rate: float = MAX_RATE
    keys: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if self.industry not in BASE_COUNTS:
            raise ValueError(f"unknown industry {self.industry!r}, expected one of {sorted(BASE_COUNTS)}")
        if self.scale is None:
            if self.size not in SIZES:
                raise ValueError(f"unknown size {self.size!r}, expected one of {sorted(SIZES)}")
            object.__setattr__(self, "scale", SIZES[self.size])
        if self.scale <= 0:
            raise ValueError("scale must be positive")
        if self.quality_rate is None:
            if self.quality not in QUALITY_LEVELS:
                raise ValueError(f"unknown quality {self.quality!r}, expected one of {sorted(QUALITY_LEVELS)}")
            object.__setattr__(self, "quality_rate", QUALITY_LEVELS[self.quality])
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format!r}, expected one of {FORMATS}")
        object.__setattr__(self, "quality_rate", min(max(self.quality_rate, 0.0), self.max_rate))
        if int(self.months) < 1:
            raise ValueError("months must be positive")
        object.__setattr__(self, "months", int(self.months))
        if not 0 <= self.growth_rate <= 50:
            raise ValueError("growth_rate is a monthly percentage from 0 to 50")
        unknown = set(self.counts) - set(BASE_COUNTS[self.industry])
        if unknown:
            raise ValueError(f"unknown counts for {self.industry}: {sorted(unknown)}")
        for name in BASE_COUNTS[self.industry]:
            if self.n(name) < 1:
                raise ValueError(f"{name} would be empty at scale {self.scale}")

    def n(self, name: str) -> int:
        """Row count of one entity."""
        if name in self.counts:
            return int(self.counts[name])
        return int(BASE_COUNTS[self.industry][name] * self.scale)

    @property
    def end_date(self) -> date:
        return self.as_of

    @property
    def start_date(self) -> date:
        return self.as_of - timedelta(days=self.months * 30)

    @property
    def n_days(self) -> int:
        """Calendar rows; both ends of the window are included."""
        return self.months * 30 + 1

    @property
    def growth(self) -> float:
        return self.growth_rate / 100

    def years_before(self, years: int) -> date:
        """The as-of date some whole years earlier (29 February becomes the 28th)."""
        target = self.as_of.year - years
        try:
            return self.as_of.replace(year=target)
        except ValueError:
            return self.as_of.replace(year=target, day=28)

    def with_(self, **changes) -> "GenConfig":
        if "quality" in changes and "quality_rate" not in changes:
            changes["quality_rate"] = None
        if "size" in changes and "scale" not in changes:
            changes["scale"] = None
        return replace(self, **changes)
