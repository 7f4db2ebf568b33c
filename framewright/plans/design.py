"""Verbs that build a plan step by step; each returns a new design."""

from __future__ import annotations

import builtins
import math
import warnings
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from ..errors import AuxiliaryError, DesignError, SamplingWarning
from ..functions.ordering import Asc, Desc, Serp, terms
from .methods import Method, method
from .spec import Bound, Clusters, Draw, Plan, Stage, Strata

ALLOCATIONS = {"equal": (), "proportional": (), "neyman": ("variance",), "optimal": ("variance", "cost"), "power": ("cv", "importance")}
ROUNDINGS = ("up", "down", "nearest")


def _require(right: Any, message: str, kind: type = DesignError) -> None:
    if not right:
        raise kind(message)


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def table_rows(value: Any, strata: Strata | None, name: str) -> tuple[dict, ...]:
    """Rows of strata columns and ``name``: from rows, a pandas frame, or, with one
    strata column, a dictionary by stratum."""
    _require(strata is not None, f"a table for {name!r} needs strata")
    if isinstance(value, dict):
        _require(len(strata.columns) == 1, f"a dictionary for {name!r} needs one strata column; give rows")
        value = [{strata.columns[0]: k, name: v} for k, v in value.items()]
    elif hasattr(value, "to_dict"):
        value = value.to_dict("records")
    rows = tuple(dict(r) for r in value)
    seen = set()
    for r in rows:
        _require(set(r) >= {*strata.columns, name}, f"the table for {name!r} needs {[*strata.columns, name]}", AuxiliaryError)
        key = tuple(r[c] for c in strata.columns)
        _require(all(k is not None for k in key), f"a null key in the table for {name!r}", AuxiliaryError)
        _require(key not in seen, f"{key} stands twice in the table for {name!r}", AuxiliaryError)
        _require(_number(r[name]), f"{name!r} of {key} is not a finite number", AuxiliaryError)
        seen.add(key)
    _require(rows, f"the table for {name!r} is empty", AuxiliaryError)
    return rows


def is_table(value: Any) -> bool:
    return value is not None and not isinstance(value, int | float)


@dataclass(frozen=True)
class Design:
    """A sampling design: a plan and the verbs that extend it."""

    plan: Plan = field(default_factory=Plan)

    # building

    def _last(self, **changes: Any) -> Design:
        *before, last = self.plan.stages
        return Design(replace(self.plan, stages=(*before, replace(last, **changes))))

    def add_stage(self, label: str | None = None) -> Design:
        """Open the next stage; an empty first one is used."""
        last = self.plan.stages[-1]
        if last == Stage() and len(self.plan.stages) == 1:
            return self._last(label=label)
        _require(last.draw is not None, "the stage before needs a draw")
        return Design(replace(self.plan, stages=(*self.plan.stages, Stage(label))))

    def stratify_by(self, *columns: str, alloc: str | None = None, variance=None, cost=None, cv=None, importance=None, power: float | None = None) -> Design:
        stage = self.plan.stages[-1]
        _require(columns and all(isinstance(c, str) for c in columns), "strata are named by columns")
        _require(len(set(columns)) == len(columns), "a strata column stands twice")
        _require(stage.strata is None and stage.draw is None, "one stratify_by in a stage, before the draw")
        _require(alloc is None or alloc in ALLOCATIONS, f"alloc is one of {', '.join(ALLOCATIONS)}")
        given = {"variance": variance, "cost": cost, "cv": cv, "importance": importance}
        needed = ALLOCATIONS.get(alloc, ())
        for name, value in given.items():
            _require((value is not None) == (name in needed), f"{alloc or 'no'} allocation {'needs' if name in needed else 'takes no'} {name}")
        _require(power is None or (alloc == "power" and _number(power) and 0 <= power <= 1), "power is for power allocation, from 0 to 1")
        strata = Strata(columns, alloc, power=0.5 if power is None else power)
        tables = {name: table_rows(value, strata, name) for name, value in given.items() if value is not None}
        for name, rows in tables.items():
            _require(all(r[name] > 0 or (name == "variance" and r[name] == 0) for r in rows), f"{name} must be {'at least 0' if name == 'variance' else 'above 0'}", AuxiliaryError)
        return self._last(strata=replace(strata, **tables))

    def cluster_by(self, *columns: str) -> Design:
        stage = self.plan.stages[-1]
        _require(columns and all(isinstance(c, str) for c in columns), "clusters are named by columns")
        _require(stage.clusters is None and stage.draw is None, "one cluster_by in a stage, before the draw")
        return self._last(clusters=Clusters(columns))

    def draw(self, n=None, *, frac=None, method: str = "srswor", mos: str | None = None, prn: str | None = None, aux=None, spread=None, min_n: int | None = None, max_n: int | None = None, round: str = "up", control=None, certainty_size=None, certainty_prop=None, certainty_overflow: str = "error", on_empty: str = "warn") -> Design:
        stage = self.plan.stages[-1]
        _require(stage.draw is None, "one draw in a stage")
        m = _method(method)
        strata = stage.strata
        if hasattr(n, "to_draw_n"):  # a planned size knows what it means in this stage
            n = n.to_draw_n(len(self.plan.stages), stage.clusters is not None)
        _require((n is None) != (frac is None), "give either n or frac")
        _require(m.probabilities != "unknown", f"{method} has no known probabilities")
        if n is not None:
            _require(not (is_table(n) and strata and strata.alloc), "n by stratum and an allocation exclude each other")
            sizes = [n] if not is_table(n) else [r["n"] for r in table_rows(n, strata, "n")]
            _require(all(_number(x) and x > 0 and abs(x - round_half(x)) < 1e-8 for x in sizes), "n is a whole number above 0")
            n = int(round_half(n)) if not is_table(n) else table_rows(n, strata, "n")
        else:
            _require(m.name != "pps_cps", "pps_cps takes n only")
            _require(not (strata and strata.alloc), "frac and an allocation exclude each other")
            rates = [frac] if not is_table(frac) else [r["frac"] for r in table_rows(frac, strata, "frac")]
            _require(all(_number(x) and x > 0 for x in rates), "frac is a number above 0")
            _require(m.multi_hit or all(x <= 1 for x in rates), f"frac is 1 at most for {m.name}")
            frac = table_rows(frac, strata, "frac") if is_table(frac) else float(frac)
        aux_items = [aux] if isinstance(aux, str | Bound) else list(aux or ())
        bounds = tuple(a.column for a in aux_items if isinstance(a, Bound))
        aux_columns = tuple(a for a in aux_items if isinstance(a, str))
        spread = (spread,) if isinstance(spread, str) else tuple(spread or ())
        _require(mos is not None if m.family == "pps" else (mos is None or m.family in ("balanced", "spatial")), f"{m.name} {'needs' if m.family == 'pps' else 'takes no'} mos")
        _require(not aux_items or m.aux, f"{m.name} takes no aux")
        _require(not bounds or m.name == "cube", "bounds are for cube")
        _require(bool(spread) == m.spread, f"{m.name} {'needs' if m.spread else 'takes no'} spread")
        _require(prn is None or m.prn, f"{m.name} takes no prn")
        _require(round in ROUNDINGS, f"round is one of {', '.join(ROUNDINGS)}")
        for name, value in (("min_n", min_n), ("max_n", max_n)):
            _require(value is None or (isinstance(value, int) and value > 0), f"{name} is a whole number above 0")
        _require(min_n is None or max_n is None or min_n <= max_n, "min_n is at most max_n")
        if (min_n or max_n) and not (strata and strata.alloc):
            warnings.warn("min_n and max_n do nothing without an allocation", SamplingWarning, stacklevel=2)
        _require(certainty_size is None or certainty_prop is None, "certainty by size or by proportion, not both")
        certain = certainty_size if certainty_size is not None else certainty_prop
        if certain is not None:
            name = "certainty_size" if certainty_size is not None else "certainty_prop"
            _require(m.family == "pps" and not m.multi_hit, f"{name} is for pps without replacement")
            values = [certain] if not is_table(certain) else [r[name] for r in table_rows(certain, strata, name)]
            _require(all(_number(x) and x > 0 and (name == "certainty_size" or x < 1) for x in values), f"{name} is above 0{' and below 1' if name == 'certainty_prop' else ''}")
            certain = table_rows(certain, strata, name) if is_table(certain) else float(certain)
            certainty_size, certainty_prop = (certain, None) if certainty_size is not None else (None, certain)
        _require(certainty_overflow in ("error", "allow"), "certainty_overflow is error or allow")
        _require(on_empty in ("error", "warn", "silent"), "on_empty is error, warn or silent")
        control = terms(control)
        _require(all(isinstance(t, Asc | Desc | Serp) for t in control), "control holds columns, desc() and serp() terms")
        return self._last(draw=Draw(n, frac, m.name, mos, prn, aux_columns, bounds, spread, min_n, max_n, round, control, certainty_size, certainty_prop, certainty_overflow, on_empty))

    # reading

    @property
    def stages(self) -> tuple[Stage, ...]:
        return self.plan.stages

    def check_complete(self) -> None:
        for k, s in enumerate(self.stages, 1):
            _require(s.draw is not None, f"stage {k} has no draw")
            _require(_method(s.draw.method).probabilities != "unknown", f"{s.draw.method} has no known probabilities")
        _require(sum(_method(s.draw.method).aux for s in self.stages) <= 2, "two balanced stages at most")

    def to_dict(self) -> dict:
        return asdict(self.plan)

    def __repr__(self) -> str:
        from .text import design_text

        return design_text(self.plan)

    # running

    def execute(self, frame, unit_key, **options):
        """Draw a sample; see :func:`framewright.operators.execute.execute`."""
        from ..operators.execute import execute

        return execute(self, frame, unit_key, **options)


def _method(name: str) -> Method:
    return method(name)


def round_half(x: float) -> int:
    """The nearest whole number, halves to the even one."""
    return int(builtins.round(x))


def sampling_design(title: str | None = None) -> Design:
    _require(title is None or isinstance(title, str), "a title is text")
    return Design(Plan(title))


def is_sampling_design(x: Any) -> bool:
    return isinstance(x, Design)
