"""Joins of points with ranges, and of ranges with ranges, as equi-joins on dyadic intervals.

An inclusive range of integers is cut into dyadic intervals (blocks of 2**k numbers that start at
a multiple of 2**k): two of each size at most, so a range of width w becomes under 2 log w rows,
however wide it is. A point lies in one dyadic interval of each size. Intervals of one cut do
not overlap, so a point meets a range once or not at all, and nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest dyadic interval has 2**LEVELS numbers; a wider range has one row for each of those that it holds.
LEVELS = 16


def dyadic_cover(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The cut of start..end as an array of (level, node); empty for a null bound or an end before the start.

    At level k the part left over is lo..hi in blocks of 2**k, both rounded inwards; its first
    block belongs to the cut if its number is odd, and its last if the number behind it is.
    """
    first, behind = start.cast("long"), end.cast("long") + 1
    up = lambda x, k: -F.shiftright(-x, k)  # noqa: E731 - rounds up, floor of the negative

    def at(k: int) -> Column:
        a, b = up(first, k), F.shiftright(behind, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left = F.when((a < b) & odd(a), a)
        right = F.when((a < b) & odd(b), b - 1)
        return F.transform(F.filter(F.array(left, right), lambda n: n.isNotNull()), lambda n: F.struct(F.lit(k).alias("level"), n.alias("node")))

    top_a, top_b = up(first, levels), F.shiftright(behind, levels)
    none = F.array().cast("array<bigint>")
    top = F.transform(F.when(top_a < top_b, F.sequence(top_a, top_b - 1)).otherwise(none), lambda n: F.struct(F.lit(levels).alias("level"), n.alias("node")))
    cut = F.concat(*[at(k) for k in range(levels)], top)
    return F.when(first < behind, cut).otherwise(F.slice(cut, 1, 0))


def dyadic_path(point: Column, levels: int = LEVELS) -> Column:
    """The dyadic intervals that hold a point, as an array of (level, node)."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(point.cast("long"), k).alias("node")) for k in range(levels + 1)])


def points_in_ranges(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, levels: int = LEVELS) -> DataFrame:
    """The inner join of ``points`` and ``ranges`` on equal ``on`` and start <= point <= end.

    Null points, null bounds and ranges that end before they start meet nothing; repeated rows
    meet once for each. Besides ``on``, the two sides have no column in common.
    """
    if clash := (set(points.columns) & set(ranges.columns)) - set(on):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    cut = ranges.withColumn("__at", F.explode(dyadic_cover(F.col(start), F.col(end), levels)))
    path = points.where(F.col(point).isNotNull()).withColumn("__at", F.explode(dyadic_path(F.col(point), levels)))
    return path.join(cut, [*on, "__at"]).drop("__at")


def overlapping_ranges(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], levels: int = LEVELS) -> DataFrame:
    """The inner join on equal ``on`` where the ranges share a number, each pair once.

    Two ranges overlap where the later start lies in the other range: a left range that starts
    inside the right one, or a right one that starts inside the left one and not with it.
    """
    started = points_in_ranges(left.where(F.col(left_range[0]) <= F.col(left_range[1])), right, on, left_range[0], *right_range, levels)
    holds = points_in_ranges(right.where(F.col(right_range[0]) <= F.col(right_range[1])), left, on, right_range[0], *left_range, levels)
    later = holds.where(F.col(right_range[0]) > F.col(left_range[0]))
    return started.unionByName(later)
