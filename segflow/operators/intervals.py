"""Interval joins by video over bins of time of several widths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the shortest bins; how many times wider the bins of each next level are; seconds beyond which all is one bin.
BIN_SEC, FACTOR, FAR = 60.0, 8, 1e15


def _levels(bin_sec: float, factor: int) -> int:
    """The top level, whose one bin holds what is not finite or beyond FAR."""
    return math.ceil(math.log(2 * FAR / bin_sec, factor)) + 1


def _own_level(lo: str, hi: str, bin_sec: float, factor: int) -> Column:
    """The lowest level whose bins are no shorter than the interval, so that it touches two of them at most."""
    span = (F.col(hi) - F.col(lo)) / bin_sec
    level = F.when(span <= 1, 0).otherwise(F.ceil(F.log(span) / math.log(factor)).cast("int"))
    far = (F.abs(F.col(lo)) > FAR) | (F.abs(F.col(hi)) > FAR)
    return F.when(far, _levels(bin_sec, factor)).otherwise(level)


def _spread(d: DataFrame, lo: str, hi: str, used: Column, home_meets: bool, bin_sec: float, factor: int) -> DataFrame:
    """Rows by (level, bin, role): an interval is at home at its own level, and calls at each higher one in use (a bit of ``used``).

    Role 0 is where ``a`` is at home and meets all of ``b``, role 1 where ``a`` calls and meets
    only those of ``b`` that are at home, so that callers never meet each other.
    """
    top = _levels(bin_sec, factor)
    width = F.array(*(F.lit(float(bin_sec * factor**k)) for k in range(top)))
    at = lambda c, k: F.when(k < top, F.floor(F.col(c) / F.get(width, k))).otherwise(0)

    def bins(level: Column) -> Column:
        home = level == F.col("__own")
        roles = F.when(home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))) if home_meets else F.array(F.when(home, 0).otherwise(1))
        each = lambda role: F.transform(F.sequence(at(lo, level), at(hi, level)), lambda b: F.struct(level.alias("level"), b.alias("bin"), at(lo, level).alias("first"), role.alias("role")))
        return F.flatten(F.transform(roles, each))

    higher = F.filter(F.sequence(F.col("__own"), F.lit(top)), lambda k: F.call_function("shiftright", F.col("__used"), k).bitwiseAND(F.lit(1)) == 1)
    rows = d.withColumn("__used", used).withColumn("__at", F.explode(F.flatten(F.transform(higher, bins)))).drop("__own", "__used")
    return rows.withColumns({f"__{x}": F.col(f"__at.{x}") for x in ("role", "level", "bin", "first")}).drop("__at")


def overlapping(a: DataFrame, b: DataFrame, bin_sec: float = BIN_SEC, factor: int = FACTOR) -> DataFrame:
    """Pairs of rows of one video whose intervals share time: the columns of both, without b's video_id.

    ``a`` has a0, a1 and ``b`` has b0, b1. Bins are of several levels, each ``factor`` times as
    wide as the one before. An interval is at home at the level that fits its length, where it
    touches two bins at most, and calls at the higher levels; a pair meets at the higher home of
    the two. So an interval of any length is a few rows: two for each level that is in use,
    which a subquery over both sides finds out. Intervals that are empty, reversed, null or NaN
    at an end meet nothing; infinite ends are as good as others.
    """
    fit = lambda d, lo, hi: d.filter(~F.isnan(lo) & ~F.isnan(hi) & (F.col(hi) > F.col(lo))).withColumn("__own", _own_level(lo, hi, bin_sec, factor))
    left, right = fit(a, "a0", "a1"), fit(b, "b0", "b1")
    used = left.select("__own").unionAll(right.select("__own")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__own")))).scalar()
    left = _spread(left, "a0", "a1", used, False, bin_sec, factor)
    right = _spread(right, "b0", "b1", used, True, bin_sec, factor)
    names = {c: f"__b{c}" for c in ("video_id", "__role", "__level", "__bin", "__first")}
    right = right.withColumnsRenamed(names)
    same = [F.col(c) == F.col(names[c]) for c in ("video_id", "__level", "__bin", "__role")]
    met = left.join(right, same).filter((F.least("a1", "b1") > F.greatest("a0", "b0")) & (F.col("__bin") == F.greatest("__first", names["__first"])))
    return met.drop("__role", "__level", "__bin", "__first", *names.values())
