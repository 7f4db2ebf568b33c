"""One stage of a plan: restrict to parents, collapse to clusters, draw, expand, compound."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FrameError, SamplingWarning, SelectionError
from ..functions.ordering import term_columns
from ..functions.prn import text_key
from ..plans.methods import method
from ..plans.spec import Plan
from .chances import chances
from .pools import exact
from .select import select

HELPERS = ("_pop", "_n", "_target", "_rate", "_pi", "_certain", "_x", "_cube_pool", "_xsum", "_draws", "_weight_now", "_fpc_now")


def distinct(names) -> list[str]:
    return list(dict.fromkeys(names))


def draw_columns(plan: Plan, stage: int, columns: list[str]) -> list[str]:
    """Draw columns of earlier stages that tell one hit of a parent from another."""
    return [f"_draw_{k}" for k in range(1, stage) if f"_draw_{k}" in columns]


def parent_keys(plan: Plan, stage: int, frame: DataFrame, before: DataFrame) -> list[str]:
    """Columns that tie a stage to the one before: all ancestors' clusters; else the
    strata of the stage before."""
    keys = [c for c in plan.ancestors(stage) if c in frame.columns and c in before.columns]
    if not keys:
        earlier = plan.stages[stage - 2]
        keys = [c for c in (earlier.strata.columns if earlier.strata else ()) if c in frame.columns and c in before.columns]
    if not keys:
        raise FrameError(f"stage {stage}: no cluster or strata column ties the frame to the stage before")
    return keys


def restrict(plan: Plan, stage: int, frame: DataFrame, before: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame's rows under selected parents, once for each hit of a parent, and the
    keys: a semi-join, which the planner turns into a broadcast when the parents are few."""
    keys = parent_keys(plan, stage, frame, before)
    extra = [c for c in [*draw_columns(plan, stage, before.columns), "_replicate"] if c in before.columns and c not in frame.columns]
    parents = before.select(*keys, *extra).distinct()
    if extra:
        return frame.join(parents, keys), [*keys, *extra]
    return frame.join(parents, keys, "left_semi"), [*keys, *(["_replicate"] if "_replicate" in before.columns else [])]


def collapse(frame: DataFrame, plan: Plan, stage: int, keys: list[str]) -> DataFrame:
    """A row for each cluster: what must be constant in it, and sums of the auxiliaries."""
    s = plan.stages[stage - 1]
    d = s.draw
    same = distinct([*(s.strata.columns if s.strata else ()), *([d.mos] if d.mos else []), *([d.prn] if d.prn else []), *d.bounds, *d.spread, *term_columns(d.control)])
    same = [c for c in same if c not in keys]
    sums = [c for c in d.aux if c not in keys and c not in same]
    figures = [F.min(c).alias(c) for c in same] + [F.sum(exact(frame, c)).cast("double").alias(c) for c in sums]
    figures += [(F.max(c).eqNullSafe(F.min(c)) & ((F.count(c) == F.count("*")) | (F.count(c) == 0))).alias(f"_same_{i}") for i, c in enumerate(same)]
    out = frame.groupBy(*keys).agg(*(figures or [F.count("*").alias("_size")]))
    return out


def check_clusters(units: DataFrame, plan: Plan, stage: int, keys: list[str]) -> DataFrame:
    """Refuse measures and strata that vary inside a cluster."""
    flags = [c for c in units.columns if c.startswith("_same_")]
    if flags:
        varies = units.agg(*(F.count_if(~F.col(f)).alias(f) for f in flags)).first()
        if any(varies):
            s = plan.stages[stage - 1]
            d = s.draw
            same = [c for c in distinct([*(s.strata.columns if s.strata else ()), *([d.mos] if d.mos else []), *([d.prn] if d.prn else []), *d.bounds, *d.spread, *term_columns(d.control)]) if c not in keys]
            controls = set(term_columns(d.control)) - {*(s.strata.columns if s.strata else ()), d.mos, d.prn, *d.bounds, *d.spread}
            bad = [same[int(f.rpartition("_")[2])] for f, n in zip(flags, varies, strict=True) if n and same[int(f.rpartition("_")[2])] not in controls]
            if bad:
                raise FrameError(f"stage {stage}: {', '.join(bad)} must be constant within a cluster")
    return units.drop(*flags, "_size")


def run_stage(plan: Plan, stage: int, frame: DataFrame, before: DataFrame | None, unit_key: list[str], seed: int, last: bool, reps: int | None = None) -> DataFrame:
    """Draw stage ``stage`` from ``frame`` under the units selected in ``before``.

    With ``reps`` the first stage is drawn that often: sizes and chances are those of any
    one draw, so units are multiplied after them.

    Adds ``_weight_k``, ``_fpc_k``, ``_draw_k`` for multi-hit methods and ``_certainty_k``
    for methods by size, brings the earlier stages' along, and multiplies ``_weight``.
    """
    s = plan.stages[stage - 1]
    m = method(s.draw.method)
    parents: list[str] = ["_replicate"] if "_replicate" in frame.columns else []
    if before is not None:
        frame, ties = restrict(plan, stage, frame, before)
        nested = [c for c in ties if c in (*plan.ancestors(stage), "_replicate") or c.startswith("_draw_")]
        parents = distinct([*parents, *nested])
    units, key = frame, unit_key
    if s.clusters:
        key = distinct([*(c for c in plan.ancestors(stage) if c in frame.columns), *s.clusters.columns])
        units = check_clusters(collapse(frame, plan, stage, distinct([*parents, *key])), plan, stage, [*parents, *key])
    units, pools, keys = chances(units, parents, s.strata, s.draw)
    if reps:
        # the rows to multiply are spread first: a file of few blocks is few tasks
        session = frame.sparkSession
        units = units.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
        many = F.broadcast(frame.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("_replicate")))
        units, pools = units.crossJoin(many), pools.crossJoin(many)
        keys, parents = ["_replicate", *keys], ["_replicate"]
    if m.name == "cube" and s.strata:
        units = units.withColumn("_cube_pool", text_key([F.lit("all"), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parents)]))
    drawn = select(units, pools, keys, s.draw, key, seed, stage)
    names = {"_weight_now": f"_weight_{stage}", "_fpc_now": f"_fpc_{stage}", "_draw": f"_draw_{stage}"}
    if m.family == "pps":
        names["_certain"] = f"_certainty_{stage}"
    drawn = drawn.withColumnsRenamed(names)
    if not m.multi_hit and f"_draw_{stage}" in drawn.columns:
        drawn = drawn.drop(f"_draw_{stage}")
    drawn = drawn.drop(*HELPERS)
    new = [c for c in names.values() if c in drawn.columns]
    if reps:
        parents = []
    if s.clusters:
        found = drawn.select(*(["_replicate"] if reps else []), *distinct([*parents, *key]), *new)
        # only the last stage that runs needs the clusters' rows
        drawn = frame.join(found, distinct([*parents, *key])) if last else found.join(_constant(frame, plan, stage, [*parents, *key]), distinct([*parents, *key]), "left") if s.strata else found
    if before is None:
        base = F.col("_phase_weight") if "_phase_weight" in drawn.columns else F.lit(1.0)
        return drawn.withColumn("_weight", base * F.col(f"_weight_{stage}")).drop("_phase_weight")
    carried = [c for c in before.columns if c == "_weight" or c.startswith(("_weight_", "_fpc_", "_certainty_"))]
    ties = [c for c in parent_keys(plan, stage, frame, before)] + [c for c in before.columns if c.startswith("_draw_") or c == "_replicate"]
    earlier = before.select(*distinct(ties), *(F.col(c).alias(f"_was{c}") for c in carried)).dropDuplicates(distinct(ties))
    out = drawn.join(earlier, distinct(ties))
    for c in carried:
        if c != "_weight":
            out = out.withColumn(c, F.col(f"_was{c}"))
    return out.withColumn("_weight", F.col("_was_weight") * F.col(f"_weight_{stage}")).drop(*(f"_was{c}" for c in carried))


def _constant(frame: DataFrame, plan: Plan, stage: int, keys: list[str]) -> DataFrame:
    """Strata columns of clusters, for ties of later stages."""
    s = plan.stages[stage - 1]
    extra = [c for c in s.strata.columns if c not in keys]
    return frame.groupBy(*distinct(keys)).agg(*(F.min(c).alias(c) for c in extra)) if extra else frame.select(*distinct(keys)).distinct()


def empty_pools(drawn: DataFrame, on_empty: str, stage: int, reps: int | None = None) -> None:
    """Deal with a stage that drew nothing at all, or nothing in some replicates."""
    if on_empty == "silent":
        return
    if reps:
        # a row for each replicate, as many as the user asked for
        found = {r[0] for r in drawn.select("_replicate").distinct().collect()}
        lost = [r for r in range(1, reps + 1) if r not in found]
        told = f"stage {stage} selected nothing in replicates {', '.join(map(str, lost))}" if lost else ""
    else:
        told = "" if drawn.limit(1).count() else f"stage {stage} selected nothing"
    if told and on_empty == "error":
        raise SelectionError(told)
    if told:
        warnings.warn(told, SamplingWarning, stacklevel=2)


def panels(df: DataFrame, plan: Plan, stage: int, unit_key: list[str], k: int) -> DataFrame:
    """``_panel`` 1..k in turn over the units of the first stage within its strata: over
    clusters where it has them, in control order, else over rows in key order."""
    from ..functions.ordering import ordered

    s = plan.stages[0]
    rep = ["_replicate"] if "_replicate" in df.columns else []
    strata = distinct([*rep, *(c for c in (s.strata.columns if s.strata else ()) if c in df.columns)])
    if s.clusters:
        units = df.select(*distinct([*strata, *s.clusters.columns, *(c for c in term_columns(s.draw.control) if c in df.columns)])).dropDuplicates(distinct([*strata, *s.clusters.columns]))
        control = tuple(t for t in s.draw.control if all(c in df.columns for c in term_columns((t,))))
        units, by, helpers = ordered(units, control, strata, list(s.clusters.columns))
        turn = F.row_number().over(Window.partitionBy(*(strata or [F.lit(1)])).orderBy(*by))
        units = units.withColumn("_panel", ((turn - 1) % k + 1).cast("int"))
        keys = distinct([*strata, *s.clusters.columns])
        return df.join(units.select(*keys, "_panel"), keys)
    turn = F.row_number().over(Window.partitionBy(*(strata or [F.lit(1)])).orderBy(*unit_key, *[c for c in df.columns if c.startswith("_draw_")]))
    return df.withColumn("_panel", ((turn - 1) % k + 1).cast("int"))
