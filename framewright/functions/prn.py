"""Permanent random numbers by hashing: a function of seed, stage and key only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the hash that make a number, as hexadecimal digits.
DIGITS = 12


def text_key(columns: list[str | Column]) -> Column:
    """One text for a key: the value itself, or of several each with its length, so that
    no two different keys give the same text."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    if len(values) == 1:
        return values[0]
    return F.concat(*(F.concat(F.octet_length(v).cast("string"), F.lit("."), v) for v in values))


def uniform_of(text: Column) -> Column:
    """A number in (0, 1), never an end, from the MD5 of ``text``."""
    number = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long").cast("double")
    return (number + 0.5) / float(1 << (4 * DIGITS))


def uniform(seed: int | Column, stage: int, key: list[str | Column]) -> Column:
    """The random number of a unit: MD5 of ``seed:stage:key``."""
    start = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return uniform_of(F.concat(start, F.lit(f":{stage}:"), text_key(key)))


def uniform_sql(seed: int | str, stage: int, key: str) -> str:
    """The same number in DuckDB's SQL; ``key`` is an expression of text."""
    return f"((('0x' || substr(md5('{seed}:{stage}:' || {key}), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(1 << (4 * DIGITS))!r})"


def rotate(u: Column, by: Column | float) -> Column:
    """A random number moved on along the unit circle."""
    return F.pmod(u + by, F.lit(1.0))
