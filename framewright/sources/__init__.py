"""Frames from files, and listings made from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_frame(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A frame from Parquet, ORC, CSV or JSON, by ``kind`` or the path's ending."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"no frame of kind {kind!r}")
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    return getattr(reader, kind)(path)


def write_sample(sample, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """The sample's rows; dictionaries of its design are written by ``write_design``."""
    sample.df.write.mode(mode).format(kind).save(path)


def expand_listing(df: DataFrame, count: str, index: str = "unit") -> DataFrame:
    """A row for each unit that ``count`` says there is, numbered from 1."""
    return df.where(F.col(count) > 0).withColumn(index, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
