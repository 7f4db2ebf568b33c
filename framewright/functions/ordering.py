"""Orders inside a pool: ascending, descending and serpentine terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Asc:
    column: str


@dataclass(frozen=True)
class Desc:
    column: str


@dataclass(frozen=True)
class Serp:
    """Hierarchical order that turns back at each change of a higher variable."""

    columns: tuple[str, ...]


def desc(column: str) -> Desc:
    return Desc(column)


def serp(*columns: str) -> Serp:
    return Serp(columns)


def terms(control) -> tuple:
    if control is None:
        return ()
    items = control if isinstance(control, list | tuple) else [control]
    return tuple(Asc(c) if isinstance(c, str) else c for c in items)


def term_columns(control: tuple) -> list[str]:
    return [c for t in control for c in (t.columns if isinstance(t, Serp) else (t.column,))]


def serpentine(df: DataFrame, columns: tuple[str, ...], pool: list[str], name: str) -> DataFrame:
    """Add the array ``name`` whose order is serpentine within ``pool``.

    Each variable's ranks are over its distinct values in the pool, nulls last. The
    first stays as it is; a later one is reversed where the ranks before it, as turned
    and counted from 0, add up to an odd number. Ranks come from small tables of
    distinct values, joined back, so a large pool is not sorted for them.
    """
    part = [F.col(c) for c in pool] or [F.lit(1)]
    for i, c in enumerate(columns):
        values = df.select(*pool, c).distinct()
        ranked = values.select(*(F.col(p).alias(f"_p{j}") for j, p in enumerate(pool)), F.col(c).alias("_v"), F.dense_rank().over(Window.partitionBy(*part).orderBy(F.col(c).asc_nulls_last())).alias(f"_r{i}"))
        tops = ranked.groupBy(*(f"_p{j}" for j in range(len(pool)))).agg(F.max(f"_r{i}").alias(f"_m{i}"))
        on = F.lit(True)
        for j, p in enumerate(pool):
            on = on & F.col(p).eqNullSafe(F.col(f"_p{j}"))
        df = df.join(ranked, on & F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v", *(f"_p{j}" for j in range(len(pool))))
        if i:
            df = df.join(tops, on, "left").drop(*(f"_p{j}" for j in range(len(pool)))) if pool else df.crossJoin(F.broadcast(tops))
    turned, moved = [F.col("_r0")], F.col("_r0") - 1
    for i in range(1, len(columns)):
        turned.append(F.when(moved % 2 == 0, F.col(f"_r{i}")).otherwise(F.col(f"_m{i}") + 1 - F.col(f"_r{i}")))
        moved = moved + turned[-1] - 1
    out = df.withColumn(name, F.array(*turned))
    return out.drop(*(f"_r{i}" for i in range(len(columns))), *(f"_m{i}" for i in range(1, len(columns))))


def ordered(df: DataFrame, control: tuple, pool: list[str], key: list[str]) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with what an order needs, the order's columns, and helper columns to drop.

    The unit key comes last and makes the order total.
    """
    by, helpers = [], []
    for i, t in enumerate(control):
        if isinstance(t, Serp):
            if len(t.columns) == 1:
                by.append(F.col(t.columns[0]).asc_nulls_last())
                continue
            name = f"_serp{i}"
            df = serpentine(df, t.columns, pool, name)
            helpers.append(name)
            by.append(F.col(name).asc())
        else:
            c = F.col(t.column)
            by.append(c.asc_nulls_last() if isinstance(t, Asc) else c.desc_nulls_last())
    return df, [*by, *(F.col(k).asc() for k in key)], helpers
