"""The plan: immutable records that name columns and touch no data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Bound:
    """An auxiliary column whose levels' counts are bounded in a balanced draw."""

    column: str


def bound(column: str) -> Bound:
    return Bound(column)


@dataclass(frozen=True)
class Strata:
    columns: tuple[str, ...]
    alloc: str | None = None
    #: Rows of stratum attributes: dictionaries with the strata columns and the value.
    variance: tuple[dict, ...] | None = None
    cost: tuple[dict, ...] | None = None
    cv: tuple[dict, ...] | None = None
    importance: tuple[dict, ...] | None = None
    power: float = 0.5


@dataclass(frozen=True)
class Clusters:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Draw:
    n: Any = None  # a number, or rows of strata columns and "n"
    frac: Any = None
    method: str = "srswor"
    mos: str | None = None
    prn: str | None = None
    aux: tuple[str, ...] = ()
    bounds: tuple[str, ...] = ()
    spread: tuple[str, ...] = ()
    min_n: int | None = None
    max_n: int | None = None
    round: str = "up"
    control: tuple = ()
    certainty_size: Any = None
    certainty_prop: Any = None
    certainty_overflow: str = "error"
    on_empty: str = "warn"


@dataclass(frozen=True)
class Stage:
    label: str | None = None
    strata: Strata | None = None
    clusters: Clusters | None = None
    draw: Draw | None = None


@dataclass(frozen=True)
class Plan:
    title: str | None = None
    stages: tuple[Stage, ...] = field(default_factory=lambda: (Stage(),))

    def ancestors(self, stage: int) -> list[str]:
        """Cluster columns of the stages before ``stage`` (from 1), without repeats."""
        return list(dict.fromkeys(c for s in self.stages[: stage - 1] if s.clusters for c in s.clusters.columns))

    def requirements(self) -> list[tuple[str, str, int]]:
        """(column, role, stage) of everything the plan names."""
        found = []
        for k, s in enumerate(self.stages, 1):
            d = s.draw or Draw()
            from ..functions.ordering import term_columns

            roles = [("strata", s.strata.columns if s.strata else ()), ("clusters", s.clusters.columns if s.clusters else ()), ("mos", [d.mos] if d.mos else ()), ("prn", [d.prn] if d.prn else ()), ("aux", d.aux), ("bounds", d.bounds), ("spread", d.spread), ("control", term_columns(d.control))]
            found += [(c, role, k) for role, columns in roles for c in columns]
        return found
