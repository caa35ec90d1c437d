"""Job parameters. They are passed to the operators; nothing is kept in module globals."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, fields, replace

WEEK_ANCHORS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


@dataclass(frozen=True)
class PlanPeriod:
    """One subscription period: ``end=None`` marks the open plan."""

    plan: str
    start: dt.date
    end: dt.date | None
    cost_usd: float
    cost_local: float | None = None
    currency_symbol: str | None = None
    billing_day: int | None = None
    billing_cycle: str = "monthly"
    cost_eur: float | None = None

    @property
    def local_cost(self) -> float | None:
        return self.cost_local if self.cost_local is not None else self.cost_eur

    @property
    def symbol(self) -> str | None:
        if self.currency_symbol:
            return self.currency_symbol
        legacy_euro = self.cost_local is None and self.cost_eur is not None
        return "€" if legacy_euro else None


@dataclass(frozen=True)
class EngineConfig:
    week_anchor: str = "mon"
    plan_history: tuple[PlanPeriod, ...] = field(default_factory=tuple)
    plan_capacity_override_pro_usd: float | None = None
    cache_eff_min_messages: int = 3
    source_label: str = "local"
    weekday_labels: tuple[str, ...] = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
    local_tz: str = "UTC"
    as_of: dt.date = dt.date(1970, 1, 1)

    def __post_init__(self) -> None:
        if self.week_anchor not in WEEK_ANCHORS:
            object.__setattr__(self, "week_anchor", "mon")

    @property
    def anchor_weekday(self) -> int:
        return WEEK_ANCHORS.index(self.week_anchor)

    def with_options(self, **options) -> "EngineConfig":
        """Copy with changed settings; an unknown setting name is an error."""
        known = {f.name for f in fields(self)}
        unknown = sorted(set(options) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **options)
