"""Selection: which units of each pool are drawn.

Methods that are a rule on hashed numbers, ranks or running sums are expressions and
windows; the sequential ones run one pool at a time in numpy, on the few columns they
need, and their hits are joined back.
"""

from __future__ import annotations

import hashlib
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SamplingWarning, SelectionError
from ..functions.ordering import ordered
from ..functions.prn import text_key, uniform, uniform_of
from ..plans.methods import method
from ..plans.spec import Draw
from . import algorithms
from .chances import join_pools, largest_n
from .pools import as_double, exact

#: Units that a pool of a sequential method may hold: such a pool is one Python task.
POOL_LIMIT = 5_000_000
#: Units of one flight of the cube method; larger pools and levels fly in parts.
CUBE_PART = 10_000
#: Draws of a pool above which a cut of the random numbers goes before the ranks: there
#: the planner no longer prunes by rank in each task.
CUT = 1000


def pool_window(keys: list[str]):
    return Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(1)]))


def pool_text(keys: list[str]) -> Column:
    return text_key([F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")


def first_n(units: DataFrame, pools: DataFrame, keys: list[str], by: list[Column], n: str = "_n") -> DataFrame:
    """The first ``n`` of each pool. Up to the planner's threshold a literal bound on the
    rank lets each task keep that many rows of a pool only, before any shuffle; the exact
    size filters after."""
    short = F.count_if(F.col("_pop") < F.floor("_target")) if {"_pop", "_target"} <= set(pools.columns) else F.lit(0)
    bound, capped = (int(x or 0) for x in pools.agg(F.max(n), short).first())
    if capped:
        warnings.warn(f"{capped} pools have fewer units than were asked for: all of them are taken", SamplingWarning, stacklevel=2)
    ranked = units.withColumn("_rank", F.row_number().over(pool_window(keys).orderBy(*by))).where(F.col("_rank") <= bound)
    return ranked.where(F.col("_rank") <= F.col(n)).drop("_rank")


def below_cut(units: DataFrame, pools: DataFrame, keys: list[str], u: str, n: str = "_n", pop: str = "_pop") -> DataFrame:
    """The units that may be among the ``n`` smallest numbers ``u`` of their pool: those
    below (n + 8 sqrt(n) + 40) / pop, a few more than n, so that neither a shuffle nor a
    sort holds the rest. Should a pool have fewer than n there (of uniform numbers one in
    10^12 has), all units stay; one count over the frame, without a shuffle of it, says."""
    few = units.where(F.col(u) * F.col(pop) < F.col(n) + 8 * F.sqrt(F.col(n).cast("double")) + 40)
    had = few.groupBy(*keys).agg(F.count("*").alias("had")) if keys else few.agg(F.count("*").alias("had"))
    wanted = pools.select(*keys, F.least(F.col(n), F.col(pop)).alias("size"))
    tested = wanted.join(had, keys, "left") if keys else wanted.crossJoin(F.broadcast(had))
    return few if tested.where(F.coalesce("had", F.lit(0)) < F.col("size")).isEmpty() else units


def running(units: DataFrame, keys: list[str], by: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` in the order ``by`` within each pool."""
    return units.withColumn(name, F.sum(value).over(pool_window(keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))


def systematic(units: DataFrame, keys: list[str], by: list[Column], steps: Column, free: Column, seed: Column, stage: int) -> DataFrame:
    """Take a unit when the whole part of its running ``steps`` less the pool's random
    start changes. ``steps`` is the share of the draws up to and including the unit."""
    start = uniform_of(F.concat(seed.cast("string"), F.lit(f":{stage}:start:"), pool_text(keys)))
    df = units.withColumn("_at", F.floor(steps - start))
    before = F.coalesce(F.lag("_at").over(pool_window(keys).orderBy(*by)), F.lit(-1).cast("long"))
    return df.withColumn("_take", F.col("_at") > before).where(F.col("_take") | ~free).drop("_at", "_take")


def draws_of(pools: DataFrame, keys: list[str], seed_of: Column, stage: int) -> DataFrame:
    """``_draw`` 1..n and its random number for each pool."""
    drawn = pools.withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    text = F.concat(seed_of.cast("string"), F.lit(f":{stage}:draw:"), pool_text(keys), F.lit(":"), F.col("_draw").cast("string"))
    return drawn.withColumn("_v", uniform_of(text))


def seed_column(df: DataFrame, seed: int) -> Column:
    """Replicate r uses the seed ``seed + r - 1``: it is the run with that seed."""
    return F.lit(seed) + F.col("_replicate") - 1 if "_replicate" in df.columns else F.lit(seed)


def select(units: DataFrame, pools: DataFrame, keys: list[str], draw: Draw, unit_key: list[str], seed: int, stage: int) -> DataFrame:
    """The drawn units with ``_weight``, ``_fpc``, ``_certain`` and, for methods that may
    hit a unit more than once, a row for each hit with ``_draw``."""
    m = method(draw.method)
    start = seed_column(units, seed)
    key = [k for k in unit_key if k not in keys] or unit_key
    u = as_double(draw.prn) if draw.prn else uniform(start, stage, unit_key)
    units, by, helpers = ordered(units, draw.control, keys, key)
    free = (F.col("_pi") < 1) & ~F.col("_certain")
    if m.name == "srswor":
        units = units.withColumn("_u", u)
        if not draw.prn and ("_replicate" in keys or largest_n(pools) > CUT):
            units = below_cut(units, pools, keys, "_u")
        out = first_n(units, pools, keys, [F.col("_u"), *(F.col(k) for k in key)])
    elif m.name in ("bernoulli", "pps_poisson"):
        out = units.where(F.col("_certain") | (u < F.col("_pi")))
    elif m.name in ("pps_sps", "pps_pareto"):
        units = units.where(F.col("_pi") > 0).withColumn("_u", u)
        rank = F.col("_u") / F.col("_pi") if m.name == "pps_sps" else F.col("_u") * (1 - F.col("_pi")) / ((1 - F.col("_u")) * F.col("_pi"))
        units = units.withColumn("_size", F.greatest("_n", F.lit(0).cast("long"))).withColumn("_q", F.when(free, rank).otherwise(-1.0))
        out = first_n(units, pools, keys, [F.col("_q"), F.col("_u"), *(F.col(k) for k in key)]) if draw.certainty_overflow == "error" else _certain_or_first(units, pools, keys, key)
    elif m.name == "systematic":
        units = units.withColumn("_i", F.row_number().over(pool_window(keys).orderBy(*by)))
        out = systematic(units, keys, by, as_double(F.col("_i") * F.col("_n")) / as_double("_pop"), F.lit(True), start, stage).drop("_i")
    elif m.name == "pps_systematic":
        open_x = F.when(free, F.col("_x")).otherwise(F.lit(0))
        units = running(units.where(F.col("_pi") > 0), keys, by, open_x, "_upto")
        total = F.sum(open_x).over(pool_window(keys))
        count = F.sum(F.when(free, F.col("_pi")).otherwise(0.0)).over(pool_window(keys))
        units = units.withColumn("_whole", total).withColumn("_k", F.round(count).cast("long"))
        steps = F.coalesce(as_double(F.col("_upto") * F.col("_k")) / F.nullif(as_double("_whole"), F.lit(0.0)), F.lit(0.0))
        out = systematic(units, keys, by, steps, free, start, stage).drop("_upto", "_whole", "_k")
    elif m.name == "srswr":
        units = units.withColumn("_i", F.row_number().over(pool_window(keys).orderBy(*by)))
        drawn = draws_of(pools, keys, seed_column(pools, seed), stage).withColumn("_i", (F.floor(F.col("_v") * F.col("_pop")) + 1).cast("int")).select(*keys, "_draw", "_i")
        out = units.join(drawn, [*keys, "_i"]).drop("_i")
    elif m.name == "cube":
        out = in_flights(units, keys, by, draw, unit_key, start, stage)
    elif m.name == "pps_multinomial":
        out = by_intervals(units, pools, keys, by, unit_key, seed_column(pools, seed), stage)
    else:
        out = in_pools(units, keys, by, draw, unit_key, start, stage)
    out = out.withColumn("_weight_now", F.lit(1.0) / F.col("_pi"))
    fpc = F.lit(float("inf")) if m.multi_hit else as_double("_pop")
    return out.withColumn("_fpc_now", fpc).drop(*helpers, "_u", "_q", "_size")


def _certain_or_first(units: DataFrame, pools: DataFrame, keys: list[str], key: list[str]) -> DataFrame:
    most = F.when(F.col("_certain"), F.lit(0)).otherwise(F.lit(1))
    ranked = units.withColumn("_rank", F.row_number().over(pool_window(keys).orderBy(most, "_q", "_u", *key)))
    return ranked.where(F.col("_certain") | (F.col("_rank") <= F.col("_n"))).drop("_rank")


def by_intervals(units: DataFrame, pools: DataFrame, keys: list[str], by: list[Column], unit_key: list[str], seed: Column, stage: int) -> DataFrame:
    """Draws with chances by size: a draw hits the first unit whose running sum reaches
    its point. Units and draws stand in one order, and each draw looks ahead for the
    next unit, so no pair of them is formed that is not a hit. The order is from the last
    point to the first: a window that grows is one pass, one that shrinks begins anew at
    each row."""
    sized = running(units.where(F.col("_x") > 0), keys, by, F.col("_x"), "_upto")
    ends = sized.select(*keys, as_double("_upto").alias("_point"), F.struct(*unit_key).alias("_unit"), F.lit(None).cast("long").alias("_draw"))
    points = draws_of(pools, keys, seed, stage).select(*keys, (F.col("_v") * as_double("_xsum")).alias("_point"), F.lit(None).cast(ends.schema["_unit"].dataType).alias("_unit"), "_draw")
    line = ends.unionByName(points)
    ahead = pool_window(keys).orderBy(F.col("_point").desc(), F.col("_draw").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = line.withColumn("_hit", F.last("_unit", ignorenulls=True).over(ahead)).where(F.col("_draw").isNotNull() & F.col("_hit").isNotNull())
    flat = hits.select(*keys, "_draw", *(F.col(f"_hit.{k}").alias(k) for k in unit_key if k not in keys))
    return sized.drop("_upto").join(flat, list(dict.fromkeys([*keys, *unit_key])))


def told_apart(rows: pd.DataFrame, unit_key: list[str]) -> None:
    if rows[list(unit_key)].duplicated().any():
        raise SelectionError(f"the unit key {unit_key} does not tell the units of a pool apart")


def generator(rows: pd.DataFrame, keys: list[str], stage: int, what: str) -> np.random.Generator:
    values = [str(rows[k].iloc[0]) for k in keys]
    # each with its length, so that no two pools have the same text
    text = f"{int(rows['_start'].iloc[0])}:{stage}:{what}:" + (values[0] if len(values) == 1 else "".join(f"{len(v.encode())}.{v}" for v in values))
    return np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest()[:16], 16))


def in_flights(units: DataFrame, keys: list[str], by: list[Column], draw: Draw, unit_key: list[str], seed: Column, stage: int) -> DataFrame:
    """The cube method: flights in parts of strata and bounded levels, of what they leave
    open in each of these, and of what is open then in the whole, where it lands.

    A flight keeps chances and balanced sums and leaves no more units open than it has
    columns, wherever its units come from, so no task holds a pool. In a part of one
    stratum and level the columns of all these are one. Units taken go on in parts of
    their own, units left out no further.
    """
    joint = bool(keys) and "_cube_pool" in units.columns
    names = list(dict.fromkeys([*keys, *unit_key]))
    level = list(dict.fromkeys([*keys, *draw.bounds]))
    pool = ["_cube_pool"] if joint else keys
    if draw.bounds:
        units_of = units.groupBy(*level).agg(F.count("*").alias("_units"))
        df = units.join(units_of, level)
    else:
        df = units.withColumn("_units", F.col("_pop"))
    parts = F.ceil(F.col("_units") / CUBE_PART).cast("long")
    df = df.withColumn("_part", F.pmod(F.xxhash64(*unit_key), parts))
    df = df.withColumn("_order", F.row_number().over(pool_window([*level, "_part"]).orderBy(*by)))
    more = [c for c in dict.fromkeys([*draw.aux, *draw.bounds]) if c not in names]
    sent = df.select(*names, *more, *(["_cube_pool"] if joint else []), "_part", "_order", seed.cast("long").alias("_start"), "_pi", F.col("_pi").cast("double").alias("_now"))
    order, fields = [*level, "_part", "_order"], sent.columns

    def flown(group: list[str], last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            now = rows["_now"].to_numpy(float)
            if (now >= 1).all():
                return rows[fields]
            if len(rows) > POOL_LIMIT:
                raise SelectionError(f"{len(rows)} units are open in one flight, of {POOL_LIMIT} at most; bound() columns have too many levels")
            rows = rows.sort_values(order, kind="stable")
            told_apart(rows, unit_key)
            rng = generator(rows, group, stage, "pool" if last else "flight")
            now, pi = rows["_now"].to_numpy(float), rows["_pi"].to_numpy(float)
            open_ = (now > algorithms.TOL) & (now < 1 - algorithms.TOL)
            x = np.round(now)
            if open_.any():
                balance, fixed = balancing(rows[open_], draw, keys if joint else [], pi[open_])
                x[open_] = algorithms.cube(now[open_], balance, rng, fixed) if last else algorithms.part_flight(now[open_], balance, rng)
            x = np.where(x > 1 - algorithms.TOL, 1.0, x)
            return rows.assign(_now=x)[x > algorithms.TOL][fields]

        return run

    schema = sent.schema
    done = F.when(F.col("_now") >= 1, F.col("_part") + 1).otherwise(0)
    flying = sent.groupBy(*level, "_part").applyInPandas(flown([*level, "_part"], False), schema)
    if joint or draw.bounds:
        flying = flying.groupBy(*level, done.alias("_done")).applyInPandas(flown(level, False), schema)
    landed = flying.groupBy(*pool, done.alias("_done")).applyInPandas(flown(pool, True), schema)
    return units.join(landed.select(*names, *(c for c in draw.bounds if c not in names)), list(dict.fromkeys([*names, *draw.bounds])))


def in_pools(units: DataFrame, keys: list[str], by: list[Column], draw: Draw, unit_key: list[str], seed: Column, stage: int) -> DataFrame:
    """Draw with a function of one pool's rows; only the columns it needs are sent."""
    m = method(draw.method)
    columns = list(dict.fromkeys([*draw.aux, *draw.bounds, *draw.spread, *([draw.prn] if draw.prn else [])]))
    df = units.withColumn("_order", F.row_number().over(pool_window(keys).orderBy(*by))).withColumn("_start", seed.cast("long"))
    names = list(dict.fromkeys([*keys, *unit_key]))
    sent = df.select(*names, *(c for c in columns if c not in names), "_order", "_start", "_pi", "_n")
    name, registered = draw.method, m.sample

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > POOL_LIMIT:
            raise SelectionError(f"{name} draws a pool in one task and takes {POOL_LIMIT} units at most; this one has {len(rows)}; add strata")
        rows = rows.sort_values("_order", kind="stable")
        told_apart(rows, unit_key)
        rng = generator(rows, keys, stage, "pool")
        pi = rows["_pi"].to_numpy(float)
        if registered is not None:
            hits = np.asarray(registered(rows, int(rows["_n"].iloc[0]), rng), int)
        else:
            spots = rows[list(draw.spread)].to_numpy(float) if draw.spread else None
            hits = algorithms.select_pool(name, pi, rng, spots=spots)
        found = rows.loc[np.repeat(rows.index, hits)]
        return found[names].assign(_draw=np.arange(1, len(found) + 1))

    schema = T.StructType([*(sent.schema[c] for c in names), T.StructField("_draw", T.LongType())])
    grouped = sent.groupBy(*keys) if keys else sent.withColumn("_one", F.lit(1)).groupBy("_one")
    hits = grouped.applyInPandas(run, schema)
    return units.join(hits if m.multi_hit else hits.drop("_draw"), names)


def balancing(rows: pd.DataFrame, draw: Draw, strata: list[str], pi: np.ndarray) -> tuple[np.ndarray, int]:
    """Balancing columns over pi: size, strata and bounded levels first (kept to the end),
    then the auxiliary totals."""
    columns = [pi]
    for group in ([strata] if strata else []):
        columns += [pi * (rows.groupby(group, sort=True).ngroup().to_numpy() == g) for g in range(rows.groupby(group).ngroups)]
    for c in draw.bounds:
        columns += [pi * (rows[c].to_numpy() == v) for v in sorted(rows[c].unique(), key=str)]
    fixed = len(columns)
    columns += [rows[c].to_numpy(float) for c in draw.aux]
    # the flight keeps sums of column / pi * x: columns over pi
    return np.stack(columns, 1) / np.where(pi > 0, pi, 1)[:, None], fixed


__all__ = ["exact", "join_pools", "select"]
