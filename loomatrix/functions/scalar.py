"""Scalar expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cantor_pairing(a: Column, b: Column) -> Column:
    """One number for an ordered pair of non-negative integers."""
    total = a.cast("long") + b.cast("long")
    return F.call_function("div", total * (total + 1), F.lit(2)) + b.cast("long")


def histogram_bucket(v: Column, last: int) -> Column:
    """Bucket of a count: 0 and 1 have their own, then nine for each power of ten; at most `last`."""
    u = (v - 1).cast("double")
    power = F.floor(F.log10(u))
    return F.when(v == 0, 0).when(v == 1, 1).otherwise(F.least((9 * power + F.floor(u / F.pow(F.lit(10.0), power)) + 1).cast("int"), F.lit(last))).cast("int")


def to_half(v: Column) -> Column:
    """v rounded to the nearest IEEE half (ties to even), as a double; too large becomes infinite."""
    a = F.abs(v.cast("double"))
    guess = F.floor(F.log2(a))
    two = lambda e: F.pow(F.lit(2.0), e)
    power = F.when(two(guess + 1) <= a, guess + 1).when(two(guess) > a, guess - 1).otherwise(guess)
    step = two(F.greatest(power, F.lit(-14)) - 10)
    near = F.rint(a / step) * step
    size = F.when(a == 0, 0.0).when(near > 65504, F.lit(float("inf"))).otherwise(near)
    return F.when(v.isNull(), None).when(F.isnan(v.cast("double")), F.lit(float("nan"))).when(v < 0, -size).otherwise(size)


def to_single(v: Column) -> Column:
    return v.cast("float").cast("double")


def split_range(length: int, pieces: int) -> list[tuple[int, int]]:
    """Near-equal [start, end) ranges, longer ones first."""
    small, more = divmod(length, pieces)
    ends = [k * small + min(k, more) for k in range(pieces + 1)]
    return list(zip(ends, ends[1:], strict=False))


def base_name(path: Column) -> Column:
    """A file's name without its folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
