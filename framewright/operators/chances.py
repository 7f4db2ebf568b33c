"""Inclusion chances: deterministic given the sizes, never a matter of the draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SelectionError
from ..plans.methods import method
from ..plans.spec import Draw, Strata
from .pools import ONE, as_double, by_stratum, exact, pool_sizes


def join_pools(units: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a pool's figures to its units. Small pool tables are broadcast by the
    planner's own measure of their size, large ones are joined by shuffle."""
    if keys:
        # null-safe: a null may name a pool when validation was skipped
        return units.join(pools, keys)
    return units.crossJoin(F.broadcast(pools.drop(ONE)))  # one row


def largest_n(pools: DataFrame, n: str = "_n") -> int:
    return int(pools.agg(F.max(n)).first()[0] or 0)


def capped(units: DataFrame, pools: DataFrame, keys: list[str], x: str, n: str, total: str) -> DataFrame:
    """Add to ``pools`` what fixed-size chances need: ``_cap`` (sizes from here on have
    chance 1), ``_free_n`` and ``_free_X`` (draws and sum of sizes left to the others).

    In order of decreasing size with suffix sums S, unit j is capped as long as all
    before it are and (n - j + 1) x_j >= S_j. Equal sizes are capped together, and n
    units at most, so the largest n of a pool decide: their rank is bounded by a
    literal before the shuffle, and no pool is sorted as a whole.
    """
    part = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(1)]))
    by = part.orderBy(F.col(x).desc())
    bound = largest_n(pools, n)
    top = units.where(F.col(x) > 0).select(*keys, x).withColumn("_j", F.row_number().over(by)).where(F.col("_j") <= bound)
    top = join_pools(top, pools.select(*keys, F.col(n).alias("_k"), F.col(total).alias("_whole")) if keys else pools.select(F.col(n).alias("_k"), F.col(total).alias("_whole")), keys).where("_j <= _k")
    by = part.orderBy("_j")  # equal sizes keep their places
    before = F.coalesce(F.sum(x).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("_suffix", F.col("_whole") - before).withColumn("_holds", (F.col("_k") - F.col("_j") + 1) * F.col(x) >= F.col("_suffix"))
    top = top.withColumn("_all", F.min("_holds").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_all")
    caps = top.groupBy(*keys).agg(F.count("*").alias("_m"), F.sum(x).alias("_mX"), F.min(x).alias("_cap")) if keys else top.agg(F.count("*").alias("_m"), F.sum(x).alias("_mX"), F.min(x).alias("_cap"))
    out = pools.join(caps, keys, "left") if keys else pools.crossJoin(F.broadcast(caps))
    return out.withColumn("_free_n", F.col(n) - F.coalesce("_m", F.lit(0))).withColumn("_free_X", F.col(total) - F.coalesce("_mX", F.lit(0))).drop("_m", "_mX")


def capped_chance(x: str) -> Column:
    """Chance 1 from the cap on; the others share the free draws in proportion."""
    free = as_double("_free_n") * as_double(x) / F.nullif(as_double("_free_X"), F.lit(0.0))
    return F.when(F.col("_cap").isNotNull() & (F.col(x) >= F.col("_cap")), 1.0).otherwise(F.coalesce(F.least(free, F.lit(1.0)), F.lit(0.0)))


def certainty(units: DataFrame, pools: DataFrame, keys: list[str], strata: Strata | None, draw: Draw) -> tuple[DataFrame, DataFrame]:
    """Units with ``_certain``, pools with ``_n`` less the certain units and ``_xsum`` and
    ``_pop`` of the rest in ``_rest_X``, ``_rest_N``."""
    name = "certainty_size" if draw.certainty_size is not None else "certainty_prop"
    value = getattr(draw, name)
    if isinstance(value, tuple):
        pools = by_stratum(pools, strata, value, name, missing="null")
    else:
        pools = pools.withColumn(name, F.lit(value))
    units = join_pools(units, pools.select(*keys, name, F.col("_xsum").alias("_allx")), keys)
    if name == "certainty_size":
        units = units.withColumn("_certain", F.coalesce(as_double("_x") >= F.col(name), F.lit(False)))
    else:
        by = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(1)])).orderBy(F.col("_x").desc())
        before = F.coalesce(F.sum("_x").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        holds = F.coalesce((F.col("_x") > 0) & (as_double("_x") >= F.col(name) * as_double(F.col("_allx") - before)), F.lit(False))
        units = units.withColumn("_holds", holds).withColumn("_certain", F.min("_holds").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_holds")
    units = units.drop(name, "_allx")
    sums = [F.count_if("_certain").alias("_sure"), F.sum(F.when(~F.col("_certain"), F.col("_x"))).alias("_rest_X"), F.count_if(~F.col("_certain")).alias("_rest_N"), F.count_if(~F.col("_certain") & (F.col("_x") > 0)).alias("_rest_positive")]
    rest = units.groupBy(*keys).agg(*sums) if keys else units.agg(*sums)
    pools = join_pools(pools, rest, keys) if keys else pools.crossJoin(F.broadcast(rest))
    over = pools.where(F.col("_sure") > F.col("_n")).limit(1).count() if method(draw.method).fixed_size and draw.certainty_overflow == "error" else 0
    if over:
        raise SelectionError("more certain units than draws in a pool; certainty_overflow = 'allow' keeps them all")
    pools = pools.withColumn("_draws", F.greatest(F.col("_n") - F.col("_sure"), F.lit(0).cast("long")))
    return units, pools.withColumn("_draws", F.least("_draws", "_rest_positive"))


def chances(units: DataFrame, parents: list[str], strata: Strata | None, draw: Draw) -> tuple[DataFrame, DataFrame, list[str]]:
    """Units with ``_pi`` (expected hits for methods with replacement), ``_certain`` and
    ``_x``; their pools; and the columns that name a pool."""
    m = method(draw.method)
    keys = list(dict.fromkeys([*parents, *(strata.columns if strata else ())]))
    pools = pool_sizes(units, parents, strata, draw)
    has_rate = "_rate" in pools.columns
    if not draw.mos:
        figures = ["_pop", "_n", "_target", *(["_rate"] if has_rate else [])]
        units = join_pools(units, pools.select(*keys, *figures), keys)
        size = F.col("_rate") if m.name == "bernoulli" and has_rate else as_double("_n") / as_double("_pop")
        return units.withColumn("_pi", size if m.multi_hit else F.least(size, F.lit(1.0))).withColumn("_certain", F.lit(False)).withColumn("_x", F.lit(None).cast("long")), pools, keys
    units = units.withColumn("_x", exact(units, draw.mos))
    if m.multi_hit:
        units = join_pools(units, pools.select(*keys, "_pop", "_n", "_target", "_xsum"), keys)
        share = as_double("_n") * as_double("_x") / F.nullif(as_double("_xsum"), F.lit(0.0))
        return units.withColumn("_pi", F.coalesce(share, F.lit(0.0))).withColumn("_certain", F.lit(False)), pools, keys
    certain = draw.certainty_size is not None or draw.certainty_prop is not None
    if certain:
        units, pools = certainty(units, pools, keys, strata, draw)
        n, total, size = "_draws", "_rest_X", "_rest_N"
    else:
        units = units.withColumn("_certain", F.lit(False))
        n, total, size = "_n", "_xsum", "_pop"
    if m.fixed_size:
        rest = units.where(~F.col("_certain"))
        pools = capped(rest, pools, keys, "_x", n, total)
        units = join_pools(units, pools.select(*keys, "_pop", "_n", "_target", "_cap", "_free_n", "_free_X"), keys)
        pi = capped_chance("_x")
    else:
        expected = F.col("_rate") * as_double(size) if has_rate else as_double(n)
        pools = pools.withColumn("_expect", expected).withColumn("_of", F.col(total))
        units = join_pools(units, pools.select(*keys, "_pop", "_n", "_target", "_expect", "_of"), keys)
        pi = F.least(F.coalesce(F.col("_expect") * as_double("_x") / F.nullif(as_double("_of"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    units = units.withColumn("_pi", F.when(F.col("_certain"), 1.0).otherwise(pi))
    return units.drop("_cap", "_free_n", "_free_X", "_expect", "_of"), pools, keys
