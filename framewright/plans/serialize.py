"""Designs as JSON, with a receipt of their execution, and exact replay."""

from __future__ import annotations

import json
import logging
import re
import warnings
from dataclasses import asdict
from datetime import UTC, datetime

import pyspark

from ..errors import ReplayError, SamplingWarning
from ..functions.ordering import Asc, Desc, Serp
from .design import Design
from .methods import method
from .spec import Clusters, Draw, Plan, Stage, Strata

FORMAT, VERSION = "framewright-design", 1
ROLES = ("strata", "clusters", "mos", "prn", "aux", "bounds", "spread", "control")


def encode_term(t) -> dict:
    kind = {Asc: "ascending", Desc: "descending", Serp: "serpentine"}[type(t)]
    return {"order": kind, "columns": list(t.columns) if isinstance(t, Serp) else [t.column]}


def decode_term(x: dict):
    kind = {"ascending": Asc, "descending": Desc, "serpentine": Serp}.get(x.get("order"))
    columns = x.get("columns")
    if kind is None or not columns or not all(isinstance(c, str) for c in columns):
        raise ReplayError(f"a control term is ascending, descending or serpentine in columns, not {x}")
    return Serp(tuple(columns)) if kind is Serp else kind(columns[0])


def encode_plan(plan: Plan) -> dict:
    stages = []
    for s in plan.stages:
        d = asdict(s.draw) if s.draw else None
        if d:
            m = method(s.draw.method)
            d["control"] = [encode_term(t) for t in s.draw.control]
            d["method"] = {"name": m.name, "family": m.family, "replacement": m.replacement, "fixed_size": m.fixed_size, "probabilities": m.probabilities, "implementation": m.fingerprint()}
        stages.append({"label": s.label, "strata": asdict(s.strata) if s.strata else None, "clusters": list(s.clusters.columns) if s.clusters else None, "draw": d})
    return {"title": plan.title, "stages": stages, "requirements": [{"column": c, "role": r, "stage": k} for c, r, k in plan.requirements()]}


def _rows(x):
    return tuple(x) if isinstance(x, list) else x


def decode_plan(x: dict) -> Plan:
    stages = []
    for s in x["stages"]:
        d = s["draw"]
        if d:
            given = d["method"]
            m = method(given["name"])
            if given.get("implementation") != m.fingerprint():
                raise ReplayError(f"method {m.name} is implemented otherwise here")
            d = Draw(**{**d, "method": m.name, "n": _rows(d["n"]), "frac": _rows(d["frac"]), "aux": tuple(d["aux"]), "bounds": tuple(d["bounds"]), "spread": tuple(d["spread"]), "control": tuple(map(decode_term, d["control"])), "certainty_size": _rows(d["certainty_size"]), "certainty_prop": _rows(d["certainty_prop"])})
        strata = Strata(**{k: _rows(v) for k, v in s["strata"].items()}) if s["strata"] else None
        stages.append(Stage(s["label"], strata, Clusters(tuple(s["clusters"])) if s["clusters"] else None, d))
    return Plan(x["title"], tuple(stages))


def design_json(x, frame=None, pretty: bool = True) -> str:
    """JSON of a design or a sample; with a frame, its fingerprint is kept."""
    from ..operators.sample import Sample
    from ..operators.validate import fingerprint

    design = x.design if isinstance(x, Sample) else x
    out = {"format": FORMAT, "format_version": VERSION, "design": encode_plan(design.plan), "frame": fingerprint(frame) if frame is not None else None, "tools": {"spark": pyspark.__version__}}
    if isinstance(x, Sample):
        out["execution"] = {"seed": x.seed, "stages": x.stages, "unit_key": x.unit_key, "n_selected": x.df.count(), "executed_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "panels": x.meta.get("panels"), "reps": x.meta.get("reps"), "chained": "previous_phase" in x.meta or "continued_from" in x.meta, "modified": sorted(x.marks)}
    return json.dumps(out, indent=2 if pretty else None, ensure_ascii=False)


def write_design(x, path: str, frame=None, pretty: bool = True) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(design_json(x, frame, pretty))


def read_design(source: str) -> tuple[Design, dict]:
    """A design, and all else that stood in the file, from a path or JSON text."""
    if re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://", source):
        raise ReplayError("designs are read from files or text, not from addresses")
    if source.lstrip().startswith("{"):
        text = source
    else:
        with open(source, encoding="utf-8") as file:
            text = file.read()
    x = json.loads(text)
    if x.get("format") != FORMAT:
        raise ReplayError("this is not a design file")
    if x.get("format_version") != VERSION:
        raise ReplayError(f"format version {x.get('format_version')} is not {VERSION}")
    bad = [r for r in x["design"]["requirements"] if r["role"] not in ROLES]
    if bad:
        raise ReplayError(f"unknown roles: {bad}")
    return Design(decode_plan(x["design"])), x


def replay_design(source: str, frame, on_difference: str = "error"):
    """Draw a recorded sample again. Numbers are hashed, so the same frame gives the same
    rows. A frame with another fingerprint is an ``error``; ``warn`` and ``inform`` (a log
    record) go on after telling, ``ignore`` does not look."""
    from ..operators.validate import fingerprint, fingerprint_differences

    design, x = read_design(source)
    receipt = x.get("execution")
    if receipt is None or receipt.get("seed") is None:
        raise ReplayError("this file has no receipt of an execution")
    if receipt["chained"]:
        raise ReplayError("a later phase or a continuation needs its earlier sample")
    if on_difference not in ("error", "warn", "inform", "ignore"):
        raise ReplayError(f"on_difference is error, warn, inform or ignore, not {on_difference!r}")
    if x.get("frame") and on_difference != "ignore":
        frames = frame[0] if isinstance(frame, list) else frame
        found = fingerprint_differences(x["frame"], fingerprint(frames))
        told = "the frame is not the one recorded: " + "; ".join(found)
        if found and on_difference == "error":
            raise ReplayError(told)
        if found and on_difference == "warn":
            warnings.warn(told, SamplingWarning, stacklevel=2)
        elif found:
            logging.getLogger(__name__).info(told)
    return design.execute(frame, receipt["unit_key"], stages=receipt["stages"], seed=receipt["seed"], panels=receipt["panels"], reps=receipt["reps"])
