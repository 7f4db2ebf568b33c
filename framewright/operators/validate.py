"""Checks of a frame against a plan: one aggregate for everything a stage names."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError, SamplingWarning
from ..functions.ordering import term_columns
from ..plans.design import Design

NUMERIC = (T.NumericType,)
#: Portable names of types.
TYPE_NAMES = {
    T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number", T.DoubleType: "number",
    T.DecimalType: "number", T.StringType: "string", T.DateType: "date", T.TimestampType: "date_time", T.TimestampNTZType: "date_time", T.DayTimeIntervalType: "duration",
    T.BinaryType: "binary", T.ArrayType: "composite", T.StructType: "composite", T.MapType: "composite",
}


def roles(design: Design, stage: int) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c, role, k in design.plan.requirements():
        if k == stage:
            found.setdefault(role, []).append(c)
    return found


def figures(frame: DataFrame, design: Design, stage: int) -> tuple[list[str], list[tuple[str, object, object]]]:
    """Issues known from the schema, and (issue, aggregate, test) for those that need data."""
    issues, tests = [], []
    has = roles(design, stage)
    for role, columns in has.items():
        for c in columns:
            if c not in frame.columns:
                issues.append(f"{role} column {c!r} is missing")
    present = {r: [c for c in cs if c in frame.columns] for r, cs in has.items()}
    numeric = {c for c in frame.columns if isinstance(frame.schema[c].dataType, NUMERIC)}
    for role in ("strata", "clusters", "mos", "prn", "aux", "bounds", "spread"):
        for c in present.get(role, []):
            tests.append((f"{role} column {c!r} has nulls", F.count_if(F.col(c).isNull()), lambda n: n > 0))
            if role in ("mos", "prn", "aux", "spread") and c not in numeric:
                issues.append(f"{role} column {c!r} is not numeric")
    for c in present.get("mos", []):
        if c in numeric:
            tests.append((f"mos column {c!r} has negative or infinite values", F.count_if((F.col(c) < 0) | (F.abs(F.col(c).cast("double")) == float("inf")) | F.isnan(F.col(c).cast("double"))), lambda n: n > 0))
            tests.append((f"mos column {c!r} is 0 everywhere", F.max(F.col(c).cast("double")), lambda x: x is not None and x == 0))
    for c in present.get("prn", []):
        if c in numeric:
            tests.append((f"prn column {c!r} leaves (0, 1)", F.count_if((F.col(c) <= 0) | (F.col(c) >= 1)), lambda n: n > 0))
    for c in present.get("spread", []):
        if c in numeric:
            tests.append((f"spread column {c!r} has infinite values", F.count_if((F.abs(F.col(c).cast("double")) == float("inf")) | F.isnan(F.col(c).cast("double"))), lambda n: n > 0))
    return issues, tests


def issues_of(design: Design, frame: DataFrame, stage: int, key: list[str] | None = None, notes: list[str] | None = None) -> list[str]:
    """Issues of a stage's frame; what is doubtful but no error goes to ``notes``."""
    issues, tests = figures(frame, design, stage)
    zeros = [c for c in roles(design, stage).get("mos", []) if notes is not None and c in frame.columns and isinstance(frame.schema[c].dataType, NUMERIC)]
    tests += [(f"unit key column {c!r} has nulls", F.count_if(F.col(c).isNull()), lambda n: n > 0) for c in key or ()]
    row = frame.agg(F.count("*"), *(t[1].alias(f"t{i}") for i, t in enumerate(tests)), *(F.count_if(F.col(c) == 0).alias(f"z{i}") for i, c in enumerate(zeros))).first()
    if row[0] == 0:
        return [*issues, "the frame is empty"]
    if notes is not None:
        notes += [f"mos column {c!r} is 0 in {n} of {row[0]} rows: they cannot be drawn" for c, n in zip(zeros, row[1 + len(tests) :], strict=True) if n]
    return issues + [t[0] for t, x in zip(tests, row[1 : 1 + len(tests)], strict=True) if t[2](x)]


def check_frame(design: Design, frame: DataFrame, stage: int, key: list[str]) -> None:
    """Refuse a frame that stage ``stage`` cannot be drawn from."""
    lost = [c for c in key if c not in frame.columns]
    if lost:
        raise FrameError(f"unit key columns {lost} are missing")
    clusters = [c for c in design.plan.ancestors(stage) if c not in frame.columns]
    if clusters:
        raise FrameError(f"ancestor cluster columns {clusters} are missing")
    notes: list[str] = []
    issues = issues_of(design, frame, stage, key, notes)
    if issues:
        raise FrameError(f"stage {stage}: " + "; ".join(issues), issues)
    for note in notes:
        warnings.warn(f"stage {stage}: {note}", SamplingWarning, stacklevel=5)


def validate_frame(design: Design, frame: DataFrame, stages: list[int] | None = None, unit_key=None) -> dict[int, list[str]]:
    """All issues of all stages at once: raises an error that lists them, else returns
    an empty list for each stage."""
    wanted = stages or list(range(1, len(design.stages) + 1))
    found = {k: issues_of(design, frame, k) for k in wanted}
    if unit_key is not None:
        key = [unit_key] if isinstance(unit_key, str) else list(unit_key)
        if frame.groupBy(*key).count().where("count > 1").limit(1).count():
            found[wanted[0]].append(f"the unit key {key} is not unique")
    if any(found.values()):
        listed = [f"stage {k}: {x}" for k, xs in found.items() for x in xs]
        raise FrameError("\n".join(listed), listed)
    return found


def fingerprint(frame: DataFrame, columns: list[str] | None = None) -> dict:
    """Rows, column types and an order-free hash of the content."""
    names = sorted(columns or frame.columns)
    row = frame.agg(F.count("*"), F.bit_xor(F.xxhash64(*names)), F.sum(F.pmod(F.xxhash64(F.lit(1), *names), F.lit(1 << 31)))).first()
    return {"rows": row[0], "columns": {c: TYPE_NAMES.get(type(frame.schema[c].dataType), "tool_specific") for c in names}, "hash": f"{(row[1] or 0) & (2**64 - 1):016x}{(row[2] or 0) & (2**64 - 1):016x}"}


def fingerprint_differences(old: dict, new: dict) -> list[str]:
    found = []
    if old["rows"] != new["rows"]:
        found.append(f"rows: {old['rows']} before, {new['rows']} now")
    gone, more = set(old["columns"]) - set(new["columns"]), set(new["columns"]) - set(old["columns"])
    if gone:
        found.append(f"columns gone: {', '.join(sorted(gone))}")
    if more:
        found.append(f"columns added: {', '.join(sorted(more))}")
    found += [f"{c}: {old['columns'][c]} before, {new['columns'][c]} now" for c in sorted(set(old["columns"]) & set(new["columns"])) if old["columns"][c] != new["columns"][c]]
    if not found and old["hash"] != new["hash"]:
        found.append("the content differs")
    return found


def phase_linkage(design: Design, frame: DataFrame) -> list[str]:
    """Warn when no cluster column is a unique id that links phases."""
    columns = [c for s in design.stages if s.clusters for c in s.clusters.columns if c in frame.columns]
    unique = [c for c in columns if not frame.groupBy(c).count().where("count > 1").limit(1).count()]
    return [] if unique else ["no cluster column is a unique id: phases cannot be linked"]


__all__ = ["check_frame", "fingerprint", "fingerprint_differences", "issues_of", "phase_linkage", "term_columns", "validate_frame"]
