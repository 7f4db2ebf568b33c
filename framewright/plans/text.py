"""Designs and samples in words."""

from __future__ import annotations

from ..functions.ordering import Desc, Serp
from .spec import Draw, Plan


def term_text(t) -> str:
    if isinstance(t, Serp):
        return f"serp({', '.join(t.columns)})"
    return f"desc({t.column})" if isinstance(t, Desc) else t.column


def draw_text(d: Draw) -> str:
    size = ("n", d.n) if d.n is not None else ("frac", d.frac)
    parts = [f"{size[0]} = {size[1] if not isinstance(size[1], tuple) else 'by stratum'}", f"method = {d.method}"]
    for name in ("mos", "prn", "min_n", "max_n"):
        if getattr(d, name) is not None:
            parts.append(f"{name} = {getattr(d, name)}")
    for name in ("aux", "bounds", "spread"):
        if getattr(d, name):
            parts.append(f"{name} = {', '.join(getattr(d, name))}")
    for name in ("certainty_size", "certainty_prop"):
        value = getattr(d, name)
        if value is not None:
            parts.append(f"{name} = {value if not isinstance(value, tuple) else 'by stratum'}")
    if d.control:
        parts.append(f"control = {', '.join(map(term_text, d.control))}")
    return ", ".join(parts)


def design_text(plan: Plan) -> str:
    lines = [f"Sampling design{': ' + plan.title if plan.title else ''}"]
    for k, s in enumerate(plan.stages, 1):
        lines.append(f"  stage {k}{': ' + s.label if s.label else ''}")
        if s.strata:
            lines.append(f"    strata   {', '.join(s.strata.columns)}{' (' + s.strata.alloc + ')' if s.strata.alloc else ''}")
        if s.clusters:
            lines.append(f"    clusters {', '.join(s.clusters.columns)}")
        lines.append(f"    draw     {draw_text(s.draw)}" if s.draw else "    no draw yet")
    return "\n".join(lines)
