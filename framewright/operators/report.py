"""Reports: what a plan would do, and what a sample did, by stage, pool and unit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DigestError
from ..plans.design import Design
from ..plans.methods import method
from .chances import chances
from .pools import as_double
from .sample import Sample
from .stages import collapse, distinct

#: Most bins of a pool's chances, and the doubt below which chances are constant.
BINS, CONSTANT = 101, 1e-12


def stage_units(design: Design, stage: int, frame: DataFrame, parents: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Units with ``_pi``, pools, pool columns and unit columns of a stage, without a draw.

    For later stages every parent of the frame is a pool's parent, selected or not.
    """
    s = design.stages[stage - 1]
    above = parents if parents is not None else [c for c in design.plan.ancestors(stage) if c in frame.columns]
    units, key = frame, []
    if s.clusters:
        key = distinct([*above, *s.clusters.columns])
        units = collapse(frame, design.plan, stage, key)
        units = units.drop(*(c for c in units.columns if c.startswith("_same_")), "_size")
    units, pools, keys = chances(units, above, s.strata, s.draw)
    return units, pools, keys, key


def stage_chances(design: Design, frame: DataFrame, stage: int = 1, unit_key: list[str] | str | None = None) -> DataFrame:
    """A row for each unit of the stage: its key, pool columns and ``chance``: expected
    hits for methods that may hit a unit more than once."""
    units, _, keys, key = stage_units(design, stage, frame)
    own = key or ([unit_key] if isinstance(unit_key, str) else list(unit_key or []))
    return units.select(*distinct([*keys, *own]), F.col("_pi").alias("chance"), F.col("_certain").alias("certainty"))


def pool_table(design: Design, frame: DataFrame, stage: int = 1) -> DataFrame:
    """A row for each pool: ``N, n_target`` (nominal, before caps), ``n_expected`` (sum of
    chances), ``chance_status`` constant or varying, and the chance where constant."""
    units, pools, keys, _ = stage_units(design, stage, frame)
    figures = [F.count("*").alias("N"), F.sum("_pi").alias("n_expected"), F.min("_pi").alias("_low"), F.max("_pi").alias("_high"), F.first("_target").alias("n_target")]
    out = units.groupBy(*keys).agg(*figures) if keys else units.agg(*figures)
    flat = F.col("_high") - F.col("_low") <= CONSTANT
    return out.withColumn("chance_status", F.when(flat, "constant").otherwise("varying")).withColumn("chance", F.when(flat, F.col("_low"))).drop("_low", "_high")


def stage_frame(sample: Sample, stage: int) -> DataFrame:
    """The frame that a stage of the sample was drawn from."""
    frame = sample.frames[min(stage, len(sample.frames)) - 1]
    return frame.df if isinstance(frame, Sample) else frame


def stage_table(design: Design, frame: DataFrame | list[DataFrame]) -> DataFrame:
    """A row for each stage of an ex-ante report; ``frame`` is one for all stages, or a
    list of one for each stage that is wanted."""
    rows = None
    many = frame if isinstance(frame, list) else [frame] * len(design.stages)
    for k, (s, listing) in enumerate(zip(design.stages, many, strict=False), 1):
        m = method(s.draw.method)
        one = pool_table(design, listing, k).agg(F.count("*").alias("n_pools"), F.sum("N").alias("N"), F.sum("n_target").alias("n_target"), F.sum("n_expected").alias("n_expected"), F.count_if(F.col("chance_status") == "varying").alias("_varying"))
        one = one.select(F.lit(k).alias("stage"), F.lit("cluster" if s.clusters else "element").alias("unit_level"), F.lit("expected_hits" if m.multi_hit else "inclusion").alias("chance_kind"), F.lit(m.probabilities).alias("probabilities"), F.when((F.col("_varying") > 0) | F.lit(bool(s.clusters)), "units").otherwise("constant").alias("storage"), "n_pools", "N", "n_target", "n_expected")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def realized(sample: Sample, stage: int = 1) -> DataFrame:
    """Hits of each pool of a stage, pools without any included, and the take rate."""
    sample.check()
    design = sample.design
    s = design.stages[stage - 1]
    frame = stage_frame(sample, stage)
    plan = pool_table(design, frame, stage)
    keys = distinct([*(c for c in design.plan.ancestors(stage) if c in frame.columns), *(s.strata.columns if s.strata else ())])
    unit = distinct([*(c for c in design.plan.ancestors(stage) if c in sample.df.columns), *(s.clusters.columns if s.clusters else sample.unit_key), *(c for c in sample.df.columns if c.startswith("_draw_") and int(c[6:]) <= stage), *(["_replicate"] if "_replicate" in sample.df.columns else [])])
    reps = ["_replicate"] if "_replicate" in sample.df.columns else []
    hits = sample.df.select(*distinct([*reps, *keys, *unit])).distinct().groupBy(*reps, *keys).agg(F.count("*").alias("n_realized"))
    if reps:
        many = sample.df.sparkSession.range(1, sample.meta["reps"] + 1).select(F.col("id").cast("int").alias("_replicate"))
        plan = plan.crossJoin(F.broadcast(many))  # a row for each pool and replicate, zeros included
    on = [*reps, *keys]
    out = plan.join(hits, on, "left") if on else plan.crossJoin(hits)
    if design.plan.ancestors(stage) and sample.stages[0] == 1 and stage > 1:
        out = out.where(F.col("n_realized").isNotNull())
    return out.withColumn("n_realized", F.coalesce("n_realized", F.lit(0).cast("long"))).withColumn("take_rate", as_double("n_realized") / as_double("N"))


def frame_summary(x: Design | Sample, frame: DataFrame | None = None, stage: int = 1, detail: str = "pool", unit_key=None) -> DataFrame:
    """``detail`` stage, pool or unit: of a design on a frame (nothing drawn), or of a
    sample (with what was realised)."""
    if detail not in ("stage", "pool", "unit"):
        raise DigestError("detail is stage, pool or unit")
    if isinstance(x, Sample):
        if detail == "pool":
            return realized(x, stage)
        if detail == "stage":
            base = stage_table(x.design, frame or [stage_frame(x, k) for k in x.stages])
            reps = ["_replicate"] if "_replicate" in x.df.columns else []
            rows = None
            for k in x.stages:
                r = realized(x, k).groupBy(*reps).agg(F.sum("n_realized").alias("n_realized")).withColumn("stage", F.lit(k))
                rows = r if rows is None else rows.unionByName(r)
            return base.join(rows, "stage").withColumn("take_rate", as_double("n_realized") / as_double("N"))
        key = x.unit_key if not x.design.stages[stage - 1].clusters else list(x.design.stages[stage - 1].clusters.columns)
        units = stage_chances(x.design, frame or x.frames[0], stage, key)
        hits = x.df.groupBy(*[k for k in key if k in x.df.columns]).agg(F.count("*").alias("_rows"))
        return units.join(hits, [k for k in key if k in x.df.columns], "left").withColumn("selected", F.col("_rows").isNotNull()).drop("_rows")
    if frame is None:
        raise DigestError("a design needs a frame to be summarised")
    if detail == "stage":
        return stage_table(x, frame)
    return pool_table(x, frame, stage) if detail == "pool" else stage_chances(x, frame, stage, unit_key)


@dataclass(frozen=True)
class Digest:
    """A sample's tables by stage and, for each stage that ran, by pool: of all its
    replicates, and of the stages before a continuation as of those after it."""

    stages: DataFrame
    pools: DataFrame

    def write(self, folder: str) -> None:
        """Keep the digest, so that it is read when the frame is gone."""
        self.stages.write.mode("overwrite").parquet(f"{folder}/stages")
        self.pools.write.mode("overwrite").parquet(f"{folder}/pools")


def frame_digest(sample: Sample) -> Digest:
    """The digest of a sample. Pools of different stages differ in their columns: ``pool``
    is a map of them by name, with values as text. Changed samples are refused."""
    sample.check()
    rows = None
    for k in sample.stages:
        r = realized(sample, k)
        figures = ["N", "n_target", "n_expected", "chance_status", "chance", "n_realized", "take_rate"]
        reps = [c for c in r.columns if c == "_replicate"]
        names = [c for c in r.columns if c not in (*figures, *reps)]
        pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
        pool = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        one = r.select(F.lit(k).alias("stage"), *reps, pool.alias("pool"), *(F.col(c).cast("double").alias(c) if c.startswith("n_t") else F.col(c) for c in figures))
        rows = one if rows is None else rows.unionByName(one)
    return Digest(frame_summary(sample, detail="stage"), rows)


def read_digest(spark, folder: str) -> Digest:
    return Digest(spark.read.parquet(f"{folder}/stages"), spark.read.parquet(f"{folder}/pools"))


def chance_bins(design: Design, frame: DataFrame, stage: int = 1, bins: int = BINS) -> DataFrame:
    """``bin, n, chance``: at most ``bins`` bins of equal counts of each pool's sorted
    chances, with their means; a pool with one chance has one bin."""
    units, _, keys, _ = stage_units(design, stage, frame)
    pool = Window.partitionBy(*(keys or [F.lit(1)]))
    df = units.select(*keys, "_pi", F.row_number().over(pool.orderBy("_pi")).alias("_i"), F.count("*").over(pool).alias("_all"), F.min("_pi").over(pool).alias("_low"), F.max("_pi").over(pool).alias("_high"))
    k = F.when(F.col("_high") - F.col("_low") <= CONSTANT, 1).otherwise(F.least(F.lit(bins), F.col("_all")))
    # rank i stands in bin j when floor(N (j - 1) / k) < i <= floor(N j / k)
    at = F.ceil(F.col("_i") * k / F.col("_all")).cast("int")
    at = F.when(F.col("_i") > F.floor(F.col("_all") * at / k), at + 1).otherwise(at)
    return df.withColumn("bin", at).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("_pi").alias("chance"))


def weight_diagnostics(sample: Sample) -> DataFrame:
    """Mean, range and spread of the weights, Kish's design effect and effective size."""
    sample.check()
    reps = ["_replicate"] if "_replicate" in sample.df.columns else []
    w = F.col("_weight")
    out = sample.df.groupBy(*reps).agg(F.count("*").alias("n"), F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), (F.stddev_samp(w) / F.avg(w)).alias("cv"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"))
    return out.withColumn("deff", F.col("n") * F.col("_ww") / (F.col("_w") * F.col("_w"))).withColumn("n_eff", F.col("_w") * F.col("_w") / F.col("_ww")).drop("_w", "_ww")


def balance_diagnostics(sample: Sample, stage: int = 1) -> DataFrame:
    """For each pool and auxiliary variable: frame total, estimate and their difference."""
    design, frame = sample.design, sample.frames[stage - 1]
    s = design.stages[stage - 1]
    units, _, keys, key = stage_units(design, stage, frame)
    own = key or sample.unit_key
    chosen = sample.df.select(*distinct([*keys, *own])).distinct().withColumn("_taken", F.lit(1))
    marked = units.join(chosen, distinct([*keys, *own]), "left")
    rows = None
    for c in s.draw.aux:
        one = marked.groupBy(*keys).agg(F.lit(c).alias("variable"), F.sum(as_double(c)).alias("total"), F.sum(F.when(F.col("_taken") == 1, as_double(c) / F.col("_pi")).otherwise(0.0)).alias("estimate"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("residual", F.col("estimate") - F.col("total"))


def bounds_diagnostics(sample: Sample, stage: int = 1) -> DataFrame:
    """For each pool and level of a bounded column: expected, bounds, realised, satisfied."""
    design, frame = sample.design, sample.frames[stage - 1]
    s = design.stages[stage - 1]
    units, _, keys, key = stage_units(design, stage, frame)
    own = key or sample.unit_key
    chosen = sample.df.select(*distinct([*keys, *own])).distinct().withColumn("_taken", F.lit(1))
    marked = units.join(chosen, distinct([*keys, *own]), "left")
    rows = None
    for c in s.draw.bounds:
        one = marked.groupBy(*keys, F.col(c).cast("string").alias("level")).agg(F.lit(c).alias("variable"), F.sum("_pi").alias("expected"), F.count("_taken").alias("realized"))
        rows = one if rows is None else rows.unionByName(one)
    slack = 1e-10 * (1 + F.abs("expected"))
    out = rows.withColumn("lower", F.floor(F.col("expected") + slack)).withColumn("upper", F.ceil(F.col("expected") - slack))
    return out.withColumn("satisfied", F.col("realized").between(F.col("lower"), F.col("upper")))


def spatial_diagnostics(frame: DataFrame, design: Design, stage: int = 1) -> DataFrame:
    """Ranges of the spread coordinates and rows that share all of them."""
    spread = list(design.stages[stage - 1].draw.spread)
    figures = [f(c).alias(f"{c}_{n}") for c in spread for n, f in (("min", F.min), ("max", F.max))]
    return frame.agg(*figures, (F.count("*") - F.count_distinct(F.struct(*spread))).alias("duplicates"))


def pool_drift(design: Design, old: DataFrame, new: DataFrame, stage: int = 1) -> DataFrame:
    """Pools whose counts differ between two frames, those on one side only included."""
    before, after = (pool_table(design, f, stage) for f in (old, new))
    keys = [c for c in before.columns if c not in ("N", "n_expected", "n_target", "chance_status", "chance")]
    a, b = (t.select(*keys, F.col("N").alias(n)) for t, n in ((before, "N_before"), (after, "N_now")))
    joined = a.join(b, keys, "full") if keys else a.crossJoin(b)
    return joined.where(~F.col("N_before").eqNullSafe(F.col("N_now")))


def chance_drift(design: Design, old: DataFrame, new: DataFrame, stage: int = 1, tolerance: float = 1e-9) -> DataFrame:
    """Pools whose sorted chances differ by more than the tolerance, and by how much;
    pools and units on one side only count with their whole chance."""

    def ranked(frame: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        units, _, keys, _ = stage_units(design, stage, frame)
        i = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_pi"))
        return units.select(*keys, i.alias("_i"), F.col("_pi").alias(name)), keys

    (a, keys), (b, _) = ranked(old, "_a"), ranked(new, "_b")
    # a chance without a counterpart differs by itself
    gap = F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("largest_change")
    joined = a.join(b, [*keys, "_i"], "full")
    return (joined.groupBy(*keys).agg(gap) if keys else joined.agg(gap)).where(F.col("largest_change") > tolerance)


def summary_text(sample: Sample) -> str:
    """The sample in a few lines: design, sizes by stage, weights."""
    lines = [repr(sample.design), f"seed {sample.seed}, stages {', '.join(map(str, sample.stages))}"]
    for r in frame_summary(sample, detail="stage").orderBy("stage").collect():  # a row for each stage
        lines.append(f"stage {r['stage']}: {r['n_realized']} of {r['N']} {r['unit_level']}s in {r['n_pools']} pools, {r['n_expected']:.6g} expected")
    for r in weight_diagnostics(sample).collect():
        lines.append(f"weights: mean {r['mean']:.6g}, {r['min']:.6g} to {r['max']:.6g}, deff {r['deff']:.4g}, effective n {r['n_eff']:.4g}")
    return "\n".join(lines)


__all__ = ["frame_summary", "replace", "stage_chances"]
