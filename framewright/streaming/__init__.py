"""Draws from streams: Bernoulli and Poisson are a test on each unit's own number, so
they need no state and give on a stream what they give on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DesignError
from ..functions.prn import uniform


def stream_bernoulli(units: DataFrame, rate: float, unit_key: list[str], seed: int = 1, prn: str | None = None) -> DataFrame:
    """Rows taken with a fixed chance, with their weight; stream or batch."""
    if not 0 < rate <= 1:
        raise DesignError("the rate is above 0 and 1 at most")
    return _taken(units, F.lit(float(rate)), unit_key, seed, prn)


def stream_poisson(units: DataFrame, mos: str, per_unit: float, unit_key: list[str], seed: int = 1, prn: str | None = None) -> DataFrame:
    """Rows taken with chance ``mos * per_unit``, 1 at most: a Poisson draw with the rate
    fixed in advance, such as n / X of the last census."""
    return _taken(units, F.least(F.col(mos).cast("double") * per_unit, F.lit(1.0)), unit_key, seed, prn)


def _taken(units: DataFrame, chance: Column, unit_key: list[str], seed: int, prn: str | None) -> DataFrame:
    u = F.col(prn).cast("double") if prn else uniform(seed, 1, unit_key)
    return units.where(u < chance).withColumn("_weight_1", 1 / chance).withColumn("_weight", F.col("_weight_1"))
