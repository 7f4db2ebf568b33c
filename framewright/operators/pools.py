"""Pools: the groups of units in which independent draws are made, and their sizes."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AllocationError, AuxiliaryError, SamplingWarning
from ..plans.methods import method
from ..plans.spec import Draw, Strata

ONE = "_pool"


def exact(df: DataFrame, column: str) -> Column:
    """A column whose sums do not depend on the order of addition."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    return F.col(column).cast(kind if isinstance(kind, T.DecimalType) else "decimal(28,6)")


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rounded(size: Column, how: str) -> Column:
    """A whole size of at least 1: up, down, or to the nearest with halves to even."""
    whole = {"up": F.ceil(size), "down": F.floor(size), "nearest": F.bround(size, 0)}[how]
    return F.greatest(whole.cast("long"), F.lit(1).cast("long"))


def by_stratum(pools: DataFrame, strata: Strata, rows: tuple[dict, ...], name: str, missing: str = "error") -> DataFrame:
    """Join a table of stratum attributes; each stratum must have its row unless
    ``missing`` is ``null``. Extra rows are fine."""
    spark = pools.sparkSession
    keys = list(strata.columns)
    frame = pd.DataFrame([{**{k: r[k] for k in keys}, name: float(r[name])} for r in rows])
    table = spark.createDataFrame(frame, T.StructType([*(T.StructField(k, pools.schema[k].dataType) for k in keys), T.StructField(name, T.DoubleType())]))
    joined = pools.join(F.broadcast(table), keys, "left")  # the user's own table
    if missing == "error":
        lost = joined.where(F.col(name).isNull()).select(*keys).first()
        if lost is not None:
            raise AuxiliaryError(f"no {name} for stratum {tuple(lost)}")
    return joined


def integer_shares(pools: DataFrame, parents: list[str], keys: list[str], target: str) -> DataFrame:
    """Whole sizes that add up: floors, and one more for the largest fractional parts;
    ties go to the larger floor, then by stratum."""
    part = Window.partitionBy(*(parents or [F.lit(1)]))
    floor = F.floor(F.round(target, 9)).cast("long")
    df = pools.withColumn("_floor", floor).withColumn("_left", F.round(F.sum(target).over(part)).cast("long") - F.sum("_floor").over(part))
    rank = F.row_number().over(part.orderBy(F.round(F.col(target) - F.col("_floor"), 9).desc(), F.col("_floor").desc(), *keys))
    return df.withColumn("_n", F.col("_floor") + (rank <= F.col("_left")).cast("long")).drop("_floor", "_left")


def bounded_sizes(targets: np.ndarray, population: np.ndarray, n: int, min_n: int | None, max_n: int | None) -> np.ndarray:
    """Whole sizes near ``targets`` within bounds that add up to ``n``.

    What a stratum gains by its lower bound is taken from the others in proportion to
    what they have above theirs; what it loses by its upper bound goes to the others in
    proportion to their room. Whole sizes then start at the floors and move by one,
    furthest from the target first, the larger size first among equals.
    """
    low = np.minimum(min_n or 0, population).astype(float)
    high = np.minimum(max_n if max_n is not None else np.inf, population).astype(float)
    if low.sum() > n:
        raise AllocationError(f"min_n needs n of {int(low.sum())} at least, not {n}")
    if high.sum() < n:
        raise AllocationError(f"max_n and the strata allow n of {int(high.sum())} at most, not {n}")
    x = targets.astype(float).copy()
    for _ in range(len(x) + 1):
        moved = False
        for limit, sign in ((low, 1.0), (high, -1.0)):
            out = sign * (limit - x) > 0
            if not out.any():
                continue
            moved = True
            owed = float((sign * (limit - x))[out].sum())
            x[out] = limit[out]
            spare = np.where(out, 0.0, np.maximum(sign * (x - limit), 0.0))
            if spare.sum() > 0:
                x -= sign * np.minimum(owed * spare / spare.sum(), spare)
        if not moved:
            break
    else:
        warnings.warn("bounds did not settle; sizes may differ from their proportions", SamplingWarning, stacklevel=2)
    sizes = np.clip(np.floor(np.round(x, 9)), low, high)
    while (missing := int(n - sizes.sum())) != 0:
        step = 1 if missing > 0 else -1
        able = np.flatnonzero(sizes < high if step > 0 else sizes > low)
        if not len(able):
            break
        order = able[np.lexsort((-sizes[able], -np.round(step * (x - sizes)[able], 9)))]
        sizes[order[: abs(missing)]] += step
    return sizes.astype(int)


def with_bounds(pools: DataFrame, parents: list[str], keys: list[str], draw: Draw) -> DataFrame:
    """Bounded sizes; the strata table (a row for each stratum, no units) is dealt with
    one parent at a time."""
    n, low, high = draw.n, draw.min_n, draw.max_n
    schema = T.StructType([*pools.schema.fields, T.StructField("_n", T.LongType())])

    def sizes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys, kind="stable")
        return rows.assign(_n=bounded_sizes(rows["_target"].to_numpy(), rows["_pop"].to_numpy(), n, low, high))

    if parents:
        return pools.groupBy(*parents).applyInPandas(sizes, schema)
    found = sizes(pools.toPandas())
    return pools.sparkSession.createDataFrame(found.astype(object).where(found.notna(), None), schema)


def allocated(pools: DataFrame, parents: list[str], strata: Strata, draw: Draw) -> DataFrame:
    """Share ``n`` over the strata of each parent: ``_target`` and whole ``_n``."""
    part = Window.partitionBy(*(parents or [F.lit(1)]))
    size = as_double("_pop")
    for name in ("variance", "cost", "cv", "importance"):
        if getattr(strata, name) is not None:
            pools = by_stratum(pools, strata, getattr(strata, name), name)
    measure = {
        "equal": lambda: F.lit(1.0),
        "proportional": lambda: size,
        "neyman": lambda: size * F.sqrt("variance"),
        "optimal": lambda: size * F.sqrt("variance") / F.sqrt("cost"),
        "power": lambda: F.col("cv") * F.pow("importance", F.lit(float(strata.power))),
    }[strata.alloc]()
    pools = pools.withColumn("_measure", measure).withColumn("_target", F.lit(float(draw.n)) * F.col("_measure") / F.nullif(F.sum("_measure").over(part), F.lit(0.0)))
    if strata.alloc in ("neyman", "optimal") and pools.where(F.col("_target").isNull()).limit(1).count():
        raise AllocationError("all variances are 0: sizes are undefined")
    keys = list(strata.columns)
    if draw.min_n or draw.max_n:
        return with_bounds(pools, parents, keys, draw)
    return integer_shares(pools, parents, keys, "_target")


def pool_sizes(units: DataFrame, parents: list[str], strata: Strata | None, draw: Draw) -> DataFrame:
    """The pools of ``units`` with ``_pop``, nominal ``_target``, whole ``_n`` (capped at the
    population without replacement), ``_rate`` for random sizes given by a fraction,
    and the sum of sizes ``_xsum``."""
    m = method(draw.method)
    keys = list(dict.fromkeys([*parents, *(strata.columns if strata else ())]))
    sums = [F.count("*").alias("_pop")]
    if draw.mos:
        sums += [F.sum(exact(units, draw.mos)).alias("_xsum"), F.count_if(F.col(draw.mos) > 0).alias("_positive")]
    pools = units.groupBy(*keys).agg(*sums) if keys else units.agg(*sums).where("_pop > 0").withColumn(ONE, F.lit(1))
    parents = [p for p in parents]
    rate = None
    if draw.frac is not None:
        if isinstance(draw.frac, tuple):
            pools = by_stratum(pools, strata, draw.frac, "frac").withColumnRenamed("frac", "_rate")
        else:
            pools = pools.withColumn("_rate", F.lit(draw.frac))
        rate = F.col("_rate")
        pools = pools.withColumn("_target", rate * as_double("_pop")).withColumn("_n", rounded(F.col("_target"), draw.round))
    elif isinstance(draw.n, tuple):
        pools = by_stratum(pools, strata, draw.n, "n").withColumn("_target", F.col("n")).withColumn("_n", F.col("n").cast("long")).drop("n")
    elif strata and strata.alloc:
        pools = allocated(pools, parents, strata, draw)
    else:
        pools = pools.withColumn("_target", F.lit(float(draw.n))).withColumn("_n", F.lit(draw.n).cast("long"))
    if not m.multi_hit and m.fixed_size:
        most = F.col("_positive") if m.family == "pps" else F.col("_pop")
        pools = pools.withColumn("_n", F.least("_n", most))
    return pools
