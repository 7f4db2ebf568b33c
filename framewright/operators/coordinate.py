"""Coordination of samples over time and surveys by permanent random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prn import rotate


def rotated(u: Column | str, chance: Column | str) -> Column:
    """The next wave's number after a wave with this chance: u - pi, around the circle."""
    u, chance = (F.col(x) if isinstance(x, str) else x for x in (u, chance))
    return rotate(u, -chance)


def shifted(u: Column | str, j: int, k: int) -> Column:
    """Survey j of k gets numbers shifted by j / k."""
    return rotate(F.col(u) if isinstance(u, str) else u, F.lit(j / k))


def overlap_bounds(a: DataFrame, b: DataFrame, key: str, chance: str = "chance") -> DataFrame:
    """Expected overlap of two samples with these chances: least, independent and most."""
    both = a.select(key, F.col(chance).alias("pa")).join(b.select(key, F.col(chance).alias("pb")), key)
    return both.agg(F.sum(F.greatest(F.col("pa") + F.col("pb") - 1, F.lit(0.0))).alias("least"), F.sum(F.col("pa") * F.col("pb")).alias("independent"), F.sum(F.least("pa", "pb")).alias("most"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``n_a, n_b, n_both`` of two samples' units."""
    sides = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return sides.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


def coverage(waves: list[DataFrame], key: str) -> DataFrame:
    """``wave, n_new, n_so_far``: units seen for the first time, and all seen by then."""
    from pyspark.sql import Window

    rows = None
    for i, w in enumerate(waves, 1):
        one = w.select(key, F.lit(i).alias("wave"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(key).agg(F.min("wave").alias("wave")).groupBy("wave").agg(F.count("*").alias("n_new"))
    spark = rows.sparkSession
    every = spark.range(1, len(waves) + 1).select(F.col("id").cast("int").alias("wave")).join(first, "wave", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    return every.withColumn("n_so_far", F.sum("n_new").over(Window.orderBy("wave")))  # a row for each wave


def births_and_deaths(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys only in the new frame (birth) or only in the old one (death)."""
    born = new.join(old, key, "left_anti").select(key, F.lit("birth").alias("event"))
    return born.unionByName(old.join(new, key, "left_anti").select(key, F.lit("death").alias("event")))
