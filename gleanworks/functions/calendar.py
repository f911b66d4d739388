"""Date rules around the 65th birthday, as expressions.

A birthday on February 29 has no date 65 years later that the rules name: everything derived
from it is null. Born on the 1st, the seven months run from four before to two after.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _month_start(day: Column, months: int = 0) -> Column:
    return F.trunc(F.add_months(day, months), "month").cast("date")


def turns_65(birth: Column) -> Column:
    """The 65th birthday; null for February 29."""
    leap = (F.month(birth) == 2) & (F.dayofmonth(birth) == 29)
    return F.when(~leap, F.make_date(F.year(birth) + 65, F.month(birth), F.when(leap, 28).otherwise(F.dayofmonth(birth))))


def first_window(birth: Column) -> Column:
    """struct(starts, ends) of the seven months around the 65th birthday."""
    day = turns_65(birth)
    early = F.dayofmonth(birth) == 1
    starts = F.when(early, _month_start(day, -4)).otherwise(_month_start(day, -3))
    ends = F.when(early, F.last_day(F.add_months(day, 2))).otherwise(F.last_day(F.add_months(day, 3)))
    return F.struct(starts.alias("starts"), ends.alias("ends"))


def months_between(earlier: Column, later: Column) -> Column:
    """Whole calendar months from one date's month to another's."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def position(birth: Column, day: Column) -> Column:
    """before, inside or after the first window."""
    window = first_window(birth)
    return F.when(day < window["starts"], "before").when(day > window["ends"], "after").when(window["ends"].isNotNull(), "inside")


def coverage_start(birth: Column, signup: Column) -> Column:
    """First day of coverage for a sign-up; null outside the window and in the one month no rule names."""
    birthday, window = turns_65(birth), first_window(birth)
    inside = (signup >= window["starts"]) & (signup <= window["ends"])
    early = F.when(F.dayofmonth(birthday) == 1, _month_start(birthday, -1)).otherwise(_month_start(birthday))
    return F.when(inside & (months_between(window["starts"], signup) < 3), early).when(inside & (months_between(birthday, signup) >= 0), _month_start(signup, 1))


def yearly_window(day: Column, starts: tuple[int, int], ends: tuple[int, int]) -> Column:
    """struct(starts, ends) of this year's window, or of next year's once it is over."""
    year = F.year(day) + F.when(day > F.make_date(F.year(day), F.lit(ends[0]), F.lit(ends[1])), 1).otherwise(0)
    return F.struct(F.make_date(year, F.lit(starts[0]), F.lit(starts[1])).alias("starts"), F.make_date(year, F.lit(ends[0]), F.lit(ends[1])).alias("ends"))


#: First and last day of the yearly windows.
GENERAL, OPEN, ADVANTAGE = ((1, 1), (3, 31)), ((10, 15), (12, 7)), ((1, 1), (3, 31))


def window_check(birth: Column, day: Column) -> Column:
    """All of it as one struct: turns_65, window, position, and the yearly windows that are open to who comes after it."""
    own, where = first_window(birth), position(birth, day)
    later = lambda window: F.when(where == "after", yearly_window(day, *window))
    return F.struct(turns_65(birth).alias("turns_65"), own.alias("window"), where.alias("position"), later(GENERAL).alias("general"), later(OPEN).alias("open"), later(ADVANTAGE).alias("advantage"))
