"""A drawn sample: its rows, the design behind them, and checks that they are untouched."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SampleError
from ..plans.design import Design

INTERNAL = re.compile(r"_(weight|fpc|draw|certainty)(_\d+)?|_sample_id|_stage|_panel|_replicate|_phase_weight")


def internal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if INTERNAL.fullmatch(c)]


@dataclass(frozen=True)
class Sample:
    """Rows of a sample in ``df``, and where they come from.

    Transforming methods keep the provenance and note what was changed; analysis
    refuses a sample whose rows or protected columns were changed. ``drawn`` is the plan
    of the rows as they were drawn, which hashed numbers always give again, and
    ``vouched`` the rows known to agree with it: any others, such as those put in by
    ``dataclasses.replace``, are compared with ``drawn`` when they are analysed.
    """

    df: DataFrame
    design: Design
    stages: list[int]
    seed: int
    unit_key: list[str]
    meta: dict[str, Any] = field(default_factory=dict)
    frames: list = field(default_factory=list, repr=False)
    marks: frozenset[str] = frozenset()
    drawn: DataFrame | None = field(default=None, repr=False, compare=False)
    vouched: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def protected(self) -> list[str]:
        roles = {c for c, role, _ in self.design.plan.requirements() if role in ("strata", "clusters")}
        return sorted(c for c in self.df.columns if c in roles or INTERNAL.fullmatch(c))

    def integrity(self, columns: list[str] | None = None) -> tuple[int, int, int]:
        """Row count and order-free hashes of the protected columns: one by exclusive or,
        and a sum, for equal rows cancel out in the first."""
        h = F.xxhash64(*(columns or self.protected))
        return tuple(self.df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)) + 0, F.coalesce(F.sum(F.pmod(h, F.lit(1 << 32))), F.lit(0))).first())

    def _changed(self, df: DataFrame, mark: str) -> Sample | DataFrame:
        if "_weight" not in df.columns:
            return df  # without its weight it is a plain frame
        return replace(self, df=df, marks=self.marks | {mark})

    def _kept(self, df: DataFrame) -> Sample | DataFrame:
        if "_weight" not in df.columns:
            return df
        return replace(self, df=df, vouched=df if self.df is self.vouched else self.vouched)

    def filter(self, condition) -> Sample | DataFrame:
        return self._changed(self.df.filter(condition), "rows")

    where = filter

    def limit(self, n: int) -> Sample | DataFrame:
        return self._changed(self.df.limit(n), "rows")

    def select(self, *columns) -> Sample | DataFrame:
        df = self.df.select(*columns)
        lost = set(self.protected) - set(df.columns)
        return self._changed(df, "columns") if lost else self._kept(df)

    def withColumn(self, name: str, column) -> Sample | DataFrame:
        df = self.df.withColumn(name, column)
        return self._changed(df, "columns") if name in self.protected else self._kept(df)

    def withColumnRenamed(self, old: str, new: str) -> Sample | DataFrame:
        df = self.df.withColumnRenamed(old, new)
        return self._changed(df, "columns") if old in self.protected else self._kept(df)

    def join(self, other: DataFrame, on, how: str = "left") -> Sample | DataFrame:
        df = self.df.join(other, on, how)
        # a left join keeps the rows unless a key of the other side repeats: analysis compares
        return replace(self, df=df) if how == "left" else self._changed(df, "rows")

    def groupBy(self, *columns):
        return self.df.groupBy(*columns)

    def rewrap(self, df: DataFrame) -> Sample:
        """Give rows that went through other hands back their provenance, if unchanged."""
        again = replace(self, df=df)
        if "_weight" not in df.columns or set(self.protected) - set(df.columns) or again.integrity() != self.integrity():
            raise SampleError("these are not the rows of the sample as drawn")
        return replace(again, vouched=df)

    def check(self) -> None:
        if self.marks:
            raise SampleError(f"the sample's {' and '.join(sorted(self.marks))} were changed; analyse it as drawn, and use domains for parts of it")
        if self.drawn is not None and self.df is not self.vouched:
            origin = replace(self, df=self.drawn)
            if set(origin.protected) - set(self.df.columns) or self.integrity(origin.protected) != origin.integrity():
                raise SampleError("these are not the rows of the sample as drawn")

    def check_single(self) -> None:
        if "_replicate" in self.df.columns:
            raise SampleError("several replicates: choose one with replicate(r)")

    def replicate(self, r: int) -> Sample:
        cut = lambda df: df.where(F.col("_replicate") == r).drop("_replicate")
        df, drawn = cut(self.df), cut(self.drawn) if self.drawn is not None else None
        return replace(self, df=df, seed=self.seed + r - 1, drawn=drawn, vouched=df if self.df is self.vouched else drawn)

    def with_ids(self) -> DataFrame:
        """The rows with ``_sample_id`` 1..n in key order (one sorted task for the numbers;
        a sample's size, not the frame's)."""
        from pyspark.sql import Window

        order = [c for c in ("_replicate", *self.unit_key, *(d for d in self.df.columns if d.startswith("_draw"))) if c in self.df.columns]
        return self.df.withColumn("_sample_id", F.row_number().over(Window.orderBy(*order)))

    def execute(self, frame, **options) -> Sample:
        from .execute import continue_sample

        return continue_sample(self, frame, **options)

    def __repr__(self) -> str:
        return f"{self.design!r}\n  sample: stages {self.stages}, seed {self.seed}{', changed: ' + ', '.join(sorted(self.marks)) if self.marks else ''}"


def is_sample(x: Any) -> bool:
    return isinstance(x, Sample)


def as_sample(df: DataFrame, like: Sample) -> Sample:
    return like.rewrap(df)
