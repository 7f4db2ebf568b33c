"""Sample sizes and precision from textbook formulas, and strata borders by the
cumulative root of frequencies."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


@dataclass(frozen=True)
class PlannedSize:
    """A size that knows what it means in a stage of a plan."""

    n: float
    per_cluster: float | None = None

    def to_draw_n(self, stage: int, clustered: bool) -> int:
        if self.per_cluster is None or (stage == 1 and clustered):
            return math.ceil(self.n)
        return math.ceil(self.per_cluster)

    def __float__(self) -> float:
        return float(self.n)


def _finite(n: float, size: float | None) -> float:
    return n if size is None else n / (1 + (n - 1) / size)


def n_prop(p: float, moe: float, confidence: float = 0.95, size: float | None = None, deff: float = 1.0, response: float = 1.0) -> PlannedSize:
    """Size for a proportion with this margin of error."""
    n = z_of(confidence) ** 2 * p * (1 - p) / moe**2
    return PlannedSize(_finite(n, size) * deff / response)


def n_mean(variance: float, moe: float, confidence: float = 0.95, size: float | None = None, deff: float = 1.0, response: float = 1.0) -> PlannedSize:
    n = z_of(confidence) ** 2 * variance / moe**2
    return PlannedSize((n if size is None else n / (1 + n / size)) * deff / response)


def n_multi(targets: list[PlannedSize]) -> PlannedSize:
    """The size that serves all targets."""
    return PlannedSize(max(t.n for t in targets))


def prec_prop(p: float, n: float, confidence: float = 0.95, size: float | None = None, deff: float = 1.0) -> dict[str, float]:
    factor = 1.0 if size is None else (size - n) / (size - 1)
    se = math.sqrt(deff * factor * p * (1 - p) / n)
    return {"se": se, "moe": z_of(confidence) * se, "cv": se / p}


def prec_mean(mean: float, variance: float, n: float, confidence: float = 0.95, size: float | None = None, deff: float = 1.0) -> dict[str, float]:
    factor = 1.0 if size is None else 1 - n / size
    se = math.sqrt(deff * factor * variance / n)
    return {"se": se, "moe": z_of(confidence) * se, "cv": se / abs(mean)}


def n_cluster(budget: float, cluster_cost: float, unit_cost: float, delta: float) -> PlannedSize:
    """Clusters and units in each for a budget: the best take is sqrt(C1/C2 (1-d)/d)."""
    take = math.sqrt(cluster_cost / unit_cost * (1 - delta) / delta)
    return PlannedSize(budget / (cluster_cost + unit_cost * take), take)


def power_prop(p1: float, p2: float, n: float | None = None, power: float | None = None, alpha: float = 0.05, deff: float = 1.0) -> float:
    """Size of each group, or power, of a two-sided test of two proportions."""
    z, gap, var = NormalDist().inv_cdf(1 - alpha / 2), abs(p1 - p2), p1 * (1 - p1) + p2 * (1 - p2)
    if n is None:
        return (z + NormalDist().inv_cdf(power)) ** 2 * var * deff / gap**2
    return NormalDist().cdf(gap / math.sqrt(var * deff / n) - z)


def power_mean(gap: float, variance: float, n: float | None = None, power: float | None = None, alpha: float = 0.05, deff: float = 1.0) -> float:
    z = NormalDist().inv_cdf(1 - alpha / 2)
    if n is None:
        return (z + NormalDist().inv_cdf(power)) ** 2 * 2 * variance * deff / gap**2
    return NormalDist().cdf(abs(gap) / math.sqrt(2 * variance * deff / n) - z)


def strata_bounds(frame: DataFrame, column: str, strata: int, bins: int = 100) -> DataFrame:
    """``stratum, upper``: borders that cut the cumulated root of the frequencies of equal
    bins into equal parts (Dalenius and Hodges). The histogram has ``bins`` rows."""
    edges = frame.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    binned = frame.crossJoin(F.broadcast(edges)).select(F.least(F.floor((F.col(column).cast("double") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi")
    hist = binned.groupBy("bin").agg(F.count("*").alias("f"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    by = Window.orderBy("bin")
    cum = hist.withColumn("_cum", F.sum(F.sqrt("f")).over(by)).withColumn("_all", F.sum(F.sqrt("f")).over(Window.partitionBy(F.lit(1))))
    at = cum.withColumn("stratum", F.least(F.ceil(F.round(F.col("_cum") * strata / F.col("_all"), 9)), F.lit(strata)).cast("int"))
    return at.groupBy("stratum").agg(F.max(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("upper"))
