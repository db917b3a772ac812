"""Partial ISO dates (yyyy, yyyy-MM, yyyy-MM-dd): strings whose length is their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import col


def year(date: Column | str) -> Column:
    return F.expr(f"try_cast(substr({date}, 1, 4) AS INT)") if isinstance(date, str) else F.substring(date, 1, 4).try_cast("int")


def years_apart(a: Column | str, b: Column | str) -> Column:
    return F.abs(year(a) - year(b)).cast("long")


def dates_compatible(a: Column | str, b: Column | str) -> Column:
    """Either undated, or the same year."""
    return F.coalesce(year(a) == year(b), F.lit(True))


def precision(shortest: Column | str) -> Column:
    """NONE, YEAR, MONTH or DAY of the shortest date's length."""
    n = col(shortest)
    return F.when(n.isNull(), "NONE").when(n <= 4, "YEAR").when(n <= 7, "MONTH").otherwise("DAY")


def intervals_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column, both_events: Column) -> Column:
    """Whether two intervals overlap at their coarsest precision, at years for two events; null if one is undated."""
    a_to, b_to = F.coalesce(a_to, a_from), F.coalesce(b_to, b_from)
    cut = F.when(both_events, F.lit(4)).otherwise(F.least(*[F.length(x) for x in (a_from, a_to, b_from, b_to)]))
    head = lambda x: F.substr(x, F.lit(1), cut)
    return F.when(a_from.isNotNull() & b_from.isNotNull(), ~((head(a_to) < head(b_from)) | (head(b_to) < head(a_from))))


def gap_days(earlier_to: Column, later_from: Column) -> Column:
    """Days between two day-precise dates, else null."""
    day = lambda d: F.when(F.length(d) == 10, F.try_to_date(d, "yyyy-MM-dd"))
    return F.datediff(day(later_from), day(earlier_to)).cast("long")


def age_factor(date: Column | str, half_life: Column, as_of: str) -> Column:
    """0.5 to the power of years over half life; 1 for the undated."""
    years = F.greatest(F.lit(int(as_of[:4])) - year(date), F.lit(0))
    return F.coalesce(F.pow(F.lit(0.5), years / half_life), F.lit(1.0))


def padded(date: Column | str) -> Column:
    d = col(date)
    return F.when(F.length(d) == 4, F.concat(d, F.lit("-01-01"))).when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d)
