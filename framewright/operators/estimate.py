"""Inference: the variance design of a sample, estimates with standard errors, replicate
weights, design effects and variance components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExportError
from ..functions.prn import text_key, uniform_of
from ..plans.methods import method
from .sample import Sample
from .stages import distinct


@dataclass(frozen=True)
class SurveyDesign:
    """A sample's rows with ``id_k, stratum_k, fpc_k`` of each stage k and what the
    variance of each stage is by.

    ``kinds``: ``wr`` (with replacement), ``equal`` (equal chances without replacement),
    ``pps`` (unequal chances without replacement) or ``poisson``. Ids name a unit within
    its parent, strata a pool within its parent. Stages below one with replacement are
    left out: their variance is in that of the units above.
    """

    df: DataFrame
    kinds: tuple[str, ...]

    @property
    def kind(self) -> str:
        return self.kinds[0]


def stage_kind(name: str, certainty: bool = False) -> str:
    """What the variance of a stage is by; methods without an estimator are refused."""
    kind = {"srs": "equal", "brewer": "pps", "poisson": "poisson", "wr": "wr"}.get(method(name).variance)
    if kind is None:
        raise ExportError(f"{name} has no variance estimator here")
    return kind


def _named(columns: list[str]) -> Column:
    return text_key([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]) if columns else F.lit("")


def as_survey_design(sample: Sample) -> SurveyDesign:
    """Ids, strata and population sizes of every stage that ran."""
    sample.check()
    sample.check_single()
    plan = sample.design.plan
    for k in sample.stages[:-1]:
        if not plan.stages[k - 1].clusters:
            raise ExportError(f"stage {k} selects elements and is not the last")
    df, kinds, added = sample.df, [], {}
    for k in sample.stages:
        s = plan.stages[k - 1]
        m = method(s.draw.method)
        ids = [f"_draw_{k}"] if m.multi_hit else list(s.clusters.columns) if s.clusters else [*sample.unit_key]
        strata = [c for c in (s.strata.columns if s.strata else ()) if c in df.columns]
        stratum = _named(strata)
        if f"_certainty_{k}" in df.columns:
            stratum = F.when(F.col(f"_certainty_{k}"), F.concat(stratum, F.lit("|certain"))).otherwise(stratum)
        added |= {f"id_{k}": _named([*strata, *ids]), f"stratum_{k}": stratum, f"fpc_{k}": F.col(f"_fpc_{k}")}
        kinds.append(stage_kind(s.draw.method))
        if kinds[-1] == "wr":
            break
    return SurveyDesign(df.withColumns(added), tuple(kinds))


def _totals(d: SurveyDesign, z: Column, k: int = 1) -> DataFrame:
    """Expanded totals ``z`` of the units of stage k with ``stratum``, the group of the
    stage's pool; its size ``fpc``; their weight ``w`` in the stage; and ``above``, the
    weights of the stages before multiplied."""
    parents = [f"id_{j}" for j in range(1, k)]
    above = F.lit(1.0)
    for j in range(1, k):
        above = above * F.first(f"_weight_{j}")
    figures = [F.sum(F.col("_weight") * z).alias("z"), F.first(f"fpc_{k}").alias("fpc"), F.first(f"_weight_{k}").alias("w"), above.alias("above")]
    units = d.df.groupBy(*parents, f"stratum_{k}", f"id_{k}").agg(*figures)
    return units.withColumn("stratum", F.struct(*parents, f"stratum_{k}"))


def stage_variance(d: SurveyDesign, z: Column, k: int) -> DataFrame:
    """``variance``: the term of stage k, one row."""
    units = _totals(d, z, k)
    if d.kinds[k - 1] == "poisson":
        return units.agg(F.sum((1 - 1 / F.col("w")) * F.col("z") * F.col("z") / F.col("above")).alias("variance"))
    n, above = F.count("*"), F.first("above").alias("above")
    if d.kinds[k - 1] == "pps":
        q = 1 - 1 / F.col("w")
        part = Window.partitionBy("stratum")
        mean = F.sum(q * F.col("z")).over(part) / F.nullif(F.sum(q).over(part), F.lit(0.0))
        dev = units.withColumn("_d", F.coalesce(q * F.pow(F.col("z") - mean, F.lit(2.0)), F.lit(0.0)))
        by = dev.groupBy("stratum").agg(n.alias("n"), F.sum("_d").alias("s"), above)
        term = F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)) * F.col("s")
    else:
        by = units.groupBy("stratum").agg(n.alias("n"), F.var_samp("z").alias("s2"), F.first("fpc").alias("pop"), above)
        factor = F.lit(1.0) if d.kinds[k - 1] == "wr" else F.when(F.col("pop") == float("inf"), 1.0).otherwise(1 - F.col("n") / F.col("pop"))
        term = factor * F.col("n") * F.col("s2")
    return by.agg(F.sum(F.when(F.col("n") > 1, term / F.col("above")).otherwise(0.0)).alias("variance"))


def variance_of_total(d: SurveyDesign, z: Column) -> DataFrame:
    """``variance`` of the weighted total of ``z``: a term for each stage.

    Equal chances: stratified with finite population factors. With replacement:
    Hansen and Hurwitz. Poisson: sum of (1 - pi) times the squared expanded totals.
    Unequal without replacement: Brewer's approximation, n/(n-1) sum of (1 - pi)
    squared deviations from the mean weighted by (1 - pi) (Brewer and Donadio 2003).
    A later stage's term is that of its units' expanded totals within each parent, times
    the chances of all parents above: the sum over units of their own variance over
    their chance (Saerndal, Swensson and Wretman 1992, result 4.3.1). A pool of one unit
    gives 0.
    """
    terms = stage_variance(d, z, 1)
    for k in range(2, len(d.kinds) + 1):
        terms = terms.unionByName(stage_variance(d, z, k))
    return terms.agg(F.sum("variance").alias("variance"))


def svytotal(sample: Sample, y: str, domain: Column | None = None) -> DataFrame:
    """``estimate, se`` of a total; outside a domain rows count as 0, none is dropped."""
    d = as_survey_design(sample)
    z = F.col(y).cast("double") if domain is None else F.when(domain, F.col(y).cast("double")).otherwise(0.0)
    total = d.df.agg(F.sum(F.col("_weight") * z).alias("estimate"))
    return total.crossJoin(F.broadcast(variance_of_total(d, z))).select("estimate", F.sqrt("variance").alias("se"))


def svymean(sample: Sample, y: str, domain: Column | None = None) -> DataFrame:
    """``estimate, se`` of a mean, linearised; domains keep all rows."""
    d = as_survey_design(sample)
    on = F.lit(True) if domain is None else domain
    one, v = F.when(on, 1.0).otherwise(0.0), F.when(on, F.col(y).cast("double")).otherwise(0.0)
    top = d.df.agg((F.sum(F.col("_weight") * v) / F.sum(F.col("_weight") * one)).alias("_mean"), F.sum(F.col("_weight") * one).alias("_size"))
    joined = SurveyDesign(d.df.crossJoin(F.broadcast(top)), d.kinds)
    variance = variance_of_total(joined, F.when(on, (F.col(y).cast("double") - F.col("_mean")) / F.col("_size")).otherwise(0.0))
    return top.crossJoin(F.broadcast(variance)).select(F.col("_mean").alias("estimate"), F.sqrt("variance").alias("se"))


def two_phase(second: Sample) -> DataFrame:
    """Rows of the first phase with ``_phase2`` and the conditional weight of the second:
    its own weight over the first's. The unit key must be unique in the first phase."""
    first = second.meta.get("previous_phase")
    if first is None:
        raise ExportError("this sample has no earlier phase")
    if method(first.design.stages[0].draw.method).family == "pps":
        raise ExportError("a first phase by size has no two-phase estimator here")
    key = second.unit_key
    if first.df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ExportError(f"{key} does not tell the first phase's rows apart")
    mine = second.df.select(*key, F.col("_weight").alias("_weight_both"))
    out = first.df.join(mine, key, "left").withColumn("_phase2", F.col("_weight_both").isNotNull())
    return out.withColumn("_weight_conditional", F.col("_weight_both") / F.col("_weight")).drop("_weight_both")


def _phase(sample: Sample, name: str) -> tuple[str, list[str]]:
    """What the variance of a phase is by, and its strata; phases of one stage of
    elements with equal chances or by Poisson's rule have an estimator."""
    sample.check()
    sample.check_single()
    s = sample.design.stages[0]
    if len(sample.stages) > 1 or s.clusters:
        raise ExportError(f"the {name} phase has clusters or stages: no two-phase variance here")
    kind = stage_kind(s.draw.method)
    if kind not in ("equal", "poisson"):
        raise ExportError(f"the {name} phase by {s.draw.method} has no two-phase variance here")
    return kind, list(s.strata.columns) if s.strata else []


def two_phase_total(second: Sample, y: str) -> DataFrame:
    """``estimate, se`` of a total from the second of two phases.

    The variance is that of the first phase, had all of it been observed, plus that of
    the second given the first (Saerndal, Swensson and Wretman 1992, result 9.3.1). The
    first term needs the variance of ``y`` within the first phase's strata: sums of
    squares come from conditional weights, squares of totals are those of the estimated
    totals less their own conditional variance. A pool of one unit gives 0, a negative
    first term counts as 0.
    """
    first = second.meta.get("previous_phase")
    if first is None or first.meta.get("previous_phase") is not None:
        raise ExportError("a two-phase variance needs exactly two phases")
    (kind1, strata1), (kind2, strata2) = _phase(first, "first"), _phase(second, "second")
    v = F.col(y).cast("double")
    w1, w2 = F.col("_weight") / F.col("_weight_1"), F.col("_weight_1")
    rows = second.df.select(_named(strata1).alias("h"), _named(strata2).alias("g"), w1.alias("w1"), w2.alias("w2"), v.alias("y"), F.col("_fpc_1").alias("pop2"))
    z, both = F.col("w2") * F.col("y"), F.col("w1") * F.col("w2") * F.col("y")
    if kind2 == "poisson":
        given = rows.agg(F.sum((1 - 1 / F.col("w2")) * both * both).alias("v2"))
        inside = rows.groupBy("h").agg(F.sum((1 - 1 / F.col("w2")) * z * z).alias("v"))
    else:
        left = lambda n: (1 - n / F.col("pop2")) * n
        pools = rows.groupBy("g").agg(F.count("*").alias("n2"), F.first("pop2").alias("pop2"), F.var_samp(both).alias("s2"))
        given = pools.agg(F.sum(F.when(F.col("n2") > 1, left(F.col("n2")) * F.col("s2")).otherwise(0.0)).alias("v2"))
        # units of a pool outside a stratum count as 0 in its total
        cells = rows.groupBy("h", "g").agg(F.sum(z).alias("z"), F.sum(z * z).alias("zz")).join(pools.select("g", "n2", "pop2"), "g")
        s2 = (F.col("zz") - F.col("z") * F.col("z") / F.col("n2")) / F.nullif(F.col("n2") - 1, F.lit(0))
        inside = cells.groupBy("h").agg(F.sum(F.coalesce(left(F.col("n2")) * s2, F.lit(0.0))).alias("v"))
    total = rows.agg(F.sum(both).alias("estimate"))
    if kind1 == "poisson":
        before = rows.agg(F.sum(F.col("w2") * F.col("w1") * (F.col("w1") - 1) * F.col("y") * F.col("y")).alias("v1"))
    else:
        sizes = first.df.groupBy(_named(strata1).alias("h")).agg(F.count("*").alias("n"), F.first("_fpc_1").alias("pop"))
        sums = rows.groupBy("h").agg(F.sum(z).alias("t"), F.sum(z * F.col("y")).alias("q"))
        by = sizes.join(sums, "h").join(inside, "h")
        s2 = (F.col("q") - (F.col("t") * F.col("t") - F.col("v")) / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
        term = F.col("pop") * F.col("pop") * (1 - F.col("n") / F.col("pop")) / F.col("n") * s2
        before = by.agg(F.sum(F.coalesce(term, F.lit(0.0))).alias("v1"))
    parts = total.crossJoin(F.broadcast(given)).crossJoin(F.broadcast(before))
    return parts.select("estimate", F.sqrt(F.col("v2") + F.greatest("v1", F.lit(0.0))).alias("se"))


def replicate_weights(sample: Sample, kind: str = "auto", replicates: int = 50, seed: int = 1, rho: float = 0.5) -> tuple[DataFrame, float]:
    """Rows with ``_rep`` and ``_rep_weight`` for each replicate, and the scale of squared
    deviations of replicate estimates.

    ``JK1`` drops one primary unit in turn, ``JKn`` one within its stratum, ``bootstrap``
    draws n - 1 of n units of each stratum by hashed numbers (Rao and Wu), ``BRR`` and
    ``Fay`` take half of each stratum of two units by a Hadamard matrix. ``auto`` is JKn
    with strata, else JK1. For JKn each row also has ``_rep_scale``. ``subbootstrap`` is
    the bootstrap; ``mrbbootstrap``, which resamples later stages too, is refused.
    """
    if kind == "mrbbootstrap":
        raise ExportError("the multistage rescaled bootstrap is missing: bootstrap resamples primary units only")
    d = as_survey_design(sample)
    strata = sample.design.stages[0].strata
    kind = ("JKn" if strata else "JK1") if kind == "auto" else kind
    units = d.df.select("stratum_1", "id_1").distinct()
    part = Window.partitionBy("stratum_1")
    units = units.withColumn("_n", F.count("*").over(part)).withColumn("_i", F.row_number().over(part.orderBy("id_1")))
    if kind in ("JK1", "JKn"):
        # one replicate for each primary unit: the sample's, not the frame's
        total = units.count()
        dropped = units.select(F.row_number().over(Window.orderBy("stratum_1", "id_1")).alias("_rep"), F.col("stratum_1").alias("_s"), F.col("id_1").alias("_d"), F.col("_n").alias("_of"))
        rows = d.df.crossJoin(dropped)
        inside = F.lit(True) if kind == "JK1" else F.col("stratum_1") == F.col("_s")
        n = F.lit(float(total)) if kind == "JK1" else F.col("_of").cast("double")
        weight = F.when(F.col("id_1") == F.col("_d"), 0.0).when(inside, F.col("_weight") * n / (n - 1)).otherwise(F.col("_weight"))
        return rows.withColumn("_rep_weight", weight).withColumn("_rep_scale", (n - 1) / n).drop("_s", "_d", "_of"), (total - 1) / total if kind == "JK1" else 1.0
    many = d.df.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("_rep"))
    if kind in ("bootstrap", "subbootstrap"):
        draws = units.where("_i = 1").select("stratum_1", "_n").crossJoin(F.broadcast(many)).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n") - 1, F.lit(1)).cast("int"))))
        u = uniform_of(F.concat_ws(":", F.lit(f"{seed}:bootstrap"), F.col("_rep").cast("string"), F.col("stratum_1"), F.col("_draw").cast("string")))
        hits = draws.withColumn("_i", (F.floor(u * F.col("_n")) + 1).cast("int")).groupBy("stratum_1", "_rep", "_i").agg(F.count("*").alias("_hits"))
        grid = units.crossJoin(F.broadcast(many)).join(hits, ["stratum_1", "_rep", "_i"], "left")
        factor = F.when(F.col("_n") > 1, F.coalesce("_hits", F.lit(0)) * F.col("_n") / (F.col("_n") - 1)).otherwise(1.0)
        grid = grid.select("stratum_1", "id_1", "_rep", factor.alias("_factor"))
        return d.df.join(grid, ["stratum_1", "id_1"]).withColumn("_rep_weight", F.col("_weight") * F.col("_factor")).drop("_factor"), 1.0 / replicates
    if kind in ("BRR", "Fay"):
        if units.where("_n != 2").limit(1).count():
            raise ExportError(f"{kind} needs two primary units in each stratum")
        h = units.select("stratum_1").distinct().withColumn("_h", F.row_number().over(Window.orderBy("stratum_1")))
        size = 1
        while size <= h.count():
            size *= 2
        keep = 0.0 if kind == "BRR" else rho
        many = d.df.sparkSession.range(size).select((F.col("id") + 1).cast("int").alias("_rep"))
        sign = F.bit_count((F.col("_rep") - 1).bitwiseAND(F.col("_h"))) % 2
        grid = units.join(h, "stratum_1").crossJoin(F.broadcast(many)).withColumn("_factor", F.when(sign == F.col("_i") - 1, 2 - keep).otherwise(keep))
        return d.df.join(grid.select("stratum_1", "id_1", "_rep", "_factor"), ["stratum_1", "id_1"]).withColumn("_rep_weight", F.col("_weight") * F.col("_factor")).drop("_factor"), 1.0 / (size * (1 - keep) ** 2)
    raise ExportError(f"no replicate weights {kind!r}")


def jackknife_total(d: SurveyDesign, y: str, kind: str) -> DataFrame:
    """``estimate, se``: the total without a unit follows from the totals of all, of its
    stratum and of itself, so no unit's rows are copied for another's replicate."""
    units = d.df.groupBy("stratum_1", "id_1").agg(F.sum(F.col("_weight") * F.col(y)).alias("z"))
    if kind == "JK1":
        units = units.withColumn("stratum_1", F.lit(""))
    by = units.groupBy("stratum_1").agg(F.count("*").cast("double").alias("n"), F.sum("z").alias("t"), F.var_pop("z").alias("v"))
    # a replicate is off by (t - z) n / (n - 1) - t = (t - n z) / (n - 1)
    spread = F.when(F.col("n") > 1, F.pow(F.col("n"), F.lit(2.0)) / (F.col("n") - 1) * F.col("v")).otherwise(0.0)
    return by.agg(F.sum("t").alias("estimate"), F.sqrt(F.sum(spread)).alias("se"))


def replicate_total(sample: Sample, y: str, kind: str = "auto", **options) -> DataFrame:
    """``estimate, se`` of a total by replicate weights."""
    if kind == "auto":
        kind = "JKn" if sample.design.stages[0].strata else "JK1"
    if kind in ("JK1", "JKn"):
        return jackknife_total(as_survey_design(sample), y, kind)
    rows, scale = replicate_weights(sample, kind, **options)
    base = sample.df.agg(F.sum(F.col("_weight") * F.col(y)).alias("estimate"))
    reps = rows.groupBy("_rep").agg(F.sum(F.col("_rep_weight") * F.col(y)).alias("t")).crossJoin(F.broadcast(base))
    return reps.agg(F.first("estimate").alias("estimate"), F.sqrt(F.sum(F.lit(scale) * F.pow(F.col("t") - F.col("estimate"), F.lit(2.0)))).alias("se"))


def design_effect(sample: Sample, y: str | None = None, method: str = "kish", size: str | None = None, cluster: str | None = None) -> DataFrame:
    """``deff`` by weights alone (kish), by weights and outcome (spencer: with the chance
    p of a draw), or by clusters: 1 + (m - 1) rho with the intraclass correlation."""
    sample.check()
    sample.check_single()
    w = F.col("_weight")
    if method == "kish":
        return sample.df.agg((F.count("*") * F.sum(w * w) / F.pow(F.sum(w), F.lit(2.0))).alias("deff"))
    if method == "spencer":
        # deff = (1 - r^2) n sum w^2 / (sum w)^2 + (a / s)^2 (n sum w^2 / (sum w)^2 - 1),
        # a the intercept of y on p, r their correlation (Spencer 2000)
        p = 1 / (w * F.count("*").over(Window.partitionBy(F.lit(1))))
        df = sample.df.select(w.alias("w"), F.col(y).cast("double").alias("y"), p.alias("p"))
        wm = lambda c: F.sum(F.col("w") * c) / F.sum("w")
        m = df.agg(F.count("*").alias("n"), (F.count("*") * F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2.0))).alias("k"), wm(F.col("y")).alias("my"), wm(F.col("p")).alias("mp"), wm(F.col("y") * F.col("y")).alias("yy"), wm(F.col("p") * F.col("p")).alias("pp"), wm(F.col("y") * F.col("p")).alias("yp"))
        vy, vp, cov = F.col("yy") - F.col("my") * F.col("my"), F.col("pp") - F.col("mp") * F.col("mp"), F.col("yp") - F.col("my") * F.col("mp")
        slope = F.when(vp > 1e-30, cov / F.when(vp > 1e-30, vp)).otherwise(0.0)
        r2 = F.when((vp > 1e-30) & (vy > 0), cov * cov / F.when((vp > 1e-30) & (vy > 0), vp * vy)).otherwise(0.0)
        a = F.col("my") - slope * F.col("mp")
        return m.select(((1 - r2) * F.col("k") + a * a / vy * (F.col("k") - 1)).alias("deff"))
    if method == "cluster":
        groups = sample.df.groupBy(cluster or sample.design.stages[0].clusters.columns[0]).agg(F.count("*").alias("m"), F.avg(y).alias("a"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))
        t = groups.agg(F.count("*").alias("g"), F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum((F.col("m") - 1) * F.col("v")).alias("within"), F.sum(F.col("m") * F.col("a")).alias("s"), F.sum(F.col("m") * F.col("a") * F.col("a")).alias("ss"))
        m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("g") - 1)
        between = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1)
        within = F.col("within") / F.nullif(F.col("n") - F.col("g"), F.lit(0))
        rho = (between - within) / (between + (m0 - 1) * within)
        return t.select((1 + (F.col("n") / F.col("g") - 1) * rho).alias("deff"))
    raise ExportError(f"no design effect {method!r}")


def effective_n(sample: Sample) -> DataFrame:
    sample.check()
    sample.check_single()
    w = F.col("_weight")
    return sample.df.agg((F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)).alias("n_eff"))


def varcomp(sample: Sample, y: str) -> DataFrame:
    """Between and within components of the relative variance in two stages.

    Each primary unit's total is estimated by the weights of the later stages; its
    share is its chance over the sum of chances in its stratum. ``b2`` is the variance
    of totals over shares around the total, ``w2`` that inside, both relative to the
    squared total, and ``delta = b2 / (b2 + w2)``.
    """
    sample.check()
    sample.check_single()
    s = sample.design.stages[0]
    if not s.clusters or len(sample.stages) < 2:
        raise ExportError("variance components need clusters and a stage below them")
    strata = [c for c in (s.strata.columns if s.strata else ()) if c in sample.df.columns]
    inner = F.col("_weight") / F.col("_weight_1")
    v = F.col(y).cast("double")
    psu = sample.df.groupBy(*distinct([*strata, *s.clusters.columns])).agg(F.sum(inner * v).alias("t"), F.sum(inner).alias("M"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s2"), F.first("_weight_1").alias("w1"))
    share = (1 / F.col("w1")) / F.sum(1 / F.col("w1")).over(Window.partitionBy(*(strata or [F.lit(1)])))
    psu = psu.withColumn("p", share)
    by = psu.groupBy(*strata).agg(F.count("*").alias("m"), F.avg(F.col("t") / F.col("p")).alias("total"), F.var_samp(F.col("t") / F.col("p")).alias("_bs"), F.avg(F.col("M") * F.col("M") * F.col("s2") / F.col("p")).alias("_ws"))
    whole = by.agg(F.sum("total").alias("total"), F.sum("_bs").alias("b"), F.sum("_ws").alias("w"))
    sq = F.col("total") * F.col("total")
    return whole.select(F.col("b").alias("var_between"), F.col("w").alias("var_within"), (F.col("b") / sq).alias("b2"), (F.col("w") / sq).alias("w2"), (F.col("b") / (F.col("b") + F.col("w"))).alias("delta"))
