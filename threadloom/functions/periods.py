"""Calendar periods as strings: day 2024-05-07, month 2024-05, quarter 2024-q2, year 2024."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DAY, MONTH, QUARTER, YEAR = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-(0[1-9]|1[0-2])$", r"^\d{4}-q[1-4]$", r"^\d{4}$"


def is_day(d: Column | str) -> Column:
    return F.coalesce(col(d).rlike(DAY) & F.try_to_date(col(d), "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_period(p: Column | str) -> Column:
    p = col(p)
    return is_day(p) | p.rlike(MONTH) | p.rlike(QUARTER) | p.rlike(YEAR)


def tier(p: Column | str) -> Column:
    p = col(p)
    return F.when(is_day(p), "day").when(p.rlike(MONTH), "month").when(p.rlike(QUARTER), "quarter").when(p.rlike(YEAR), "year")


def month_of(d: Column) -> Column:
    return F.substring(d, 1, 7)


def quarter_of(d: Column) -> Column:
    return F.concat(F.substring(d, 1, 4), F.lit("-q"), F.ceil(F.substring(d, 6, 2).try_cast("int") / 3).cast("string"))


def year_of(d: Column) -> Column:
    return F.substring(d, 1, 4)


def display(p: Column | str) -> Column:
    """2025 Q3, 2025 March, and days and years as they are."""
    p = col(p)
    names = F.array(*[F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")])
    return F.when(p.rlike(QUARTER), F.concat(year_of(p), F.lit(" Q"), F.substring(p, 7, 1))).when(p.rlike(MONTH), F.concat(year_of(p), F.lit(" "), F.get(names, F.substring(p, 6, 2).cast("int") - 1))).otherwise(p)


def order_key(p: Column | str) -> Column:
    """A string that sorts periods by their start, coarser ones first."""
    p = col(p)
    q = F.lpad((F.substring(p, 7, 1).cast("int") * 3 - 2).cast("string"), 2, "0")
    return F.when(p.rlike(YEAR), F.concat(p, F.lit("-00-00"))).when(p.rlike(QUARTER), F.concat(year_of(p), F.lit("-"), q, F.lit("-00"))).when(p.rlike(MONTH), F.concat(p, F.lit("-00"))).otherwise(p)


def term(d: Column | str) -> Column:
    """Academic term: fall from August to January, spring from February to July."""
    m, y = F.substring(col(d), 6, 2).cast("int"), F.substring(col(d), 1, 4).cast("int")
    return F.when(m >= 8, F.concat(y.cast("string"), F.lit("-fall"))).when(m == 1, F.concat((y - 1).cast("string"), F.lit("-fall"))).otherwise(F.concat(y.cast("string"), F.lit("-spring")))


def days_between(a: Column | str, b: Column | str) -> Column:
    return F.datediff(col(b).cast("date"), col(a).cast("date")).cast("long")


def crossed(last: Column, now: Column, deadlines: list[str]) -> Column:
    """Dates MM-DD of every year that lie in (last, now], sorted."""
    years = F.sequence(F.substring(last, 1, 4).cast("int"), F.substring(now, 1, 4).cast("int"))
    dates = F.flatten(F.transform(years, lambda y: F.array(*[F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-" + d)) for d in sorted(deadlines)])))
    return F.filter(dates, lambda d: (d > last) & (d <= now))
