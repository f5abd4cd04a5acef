"""Dates, legislative sessions, decades and periods. Python's // floors, so floor() stands for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.vocab import LAST_PERIOD, NAMED_PERIODS, PRESIDENTS, WHITE_HOUSE


def date_to_session(date: Column) -> Column:
    """A session begins on 3 January of an odd year."""
    y = F.year(date) - F.when((F.month(date) > 1) | (F.dayofmonth(date) > 2), 0).otherwise(1)
    return (F.floor((y - 2013) / 2) + 113).cast("int")


def year_to_session(year: Column) -> Column:
    return (F.floor((year - 1873) / 2) + 43).cast("int")


def session_to_year(session: Column) -> Column:
    return ((session - 43) * 2 + 1874).cast("int")


def session_to_decade(session: Column) -> Column:
    """The middle of the decade."""
    return (F.floor((session - 47) / 5) * 10 + 1885).cast("int")


def month_number(name: Column) -> Column:
    return F.month(F.try_to_timestamp(F.concat(F.initcap(name), F.lit(" 1 2000")), F.lit("MMMM d yyyy"))).cast("int")


def trailing_year(x: Column) -> Column:
    """The last word as a year from 1701 to 2021, else null."""
    year = F.element_at(F.split(x, " "), -1).try_cast("int")
    return F.when((year > 1700) & (year < 2022), year)


def white_house_party(date: Column) -> Column:
    """The president's party on a day from 1869-03-04 to 2017-01-19, else null."""
    out = F.lit(None).cast("string")
    for until, party in reversed(WHITE_HOUSE):
        out = F.when(date < F.lit(until).cast("date"), F.lit(party)).otherwise(out)
    return out


def named_period(year: Column) -> Column:
    out = F.lit(LAST_PERIOD)
    for until, name in reversed(NAMED_PERIODS):
        out = F.when(year < until, F.lit(name)).otherwise(out)
    return F.when(year.isNotNull(), out)


def months_to_election(month: Column) -> Column:
    """Whole months of 30 days from a month's first day to the next even year's November; December counts to the one after."""
    y, m = F.year(month), F.month(month)
    year = F.when(y % 2 == 1, y + 1).when(m == 12, y + 2).otherwise(y)
    return F.floor(F.datediff(F.make_date(year, F.lit(11), F.lit(1)), month) / 30).cast("int")


def decade(year: Column) -> Column:
    """Census years: 2019 stands for 2020."""
    return (F.floor(F.when(year == 2019, 2020).otherwise(year) / 10) * 10).cast("int")


def era_of_three(year: Column) -> Column:
    return F.when(year < 1924, "early").when(year < 1965, "mid").otherwise("modern")


def year_of_int(date: Column) -> Column:
    return F.floor(date / 10_000).cast("int")


def month_of_int(date: Column) -> Column:
    return F.floor(date / 100).cast("int")


def term_label(person: Column, year: Column) -> Column:
    """The person, and the term of the one president whose two terms were apart."""
    first, second = (name for *_, name in PRESIDENTS if name.startswith("Grover Cleveland"))
    return F.when(person == "Grover Cleveland", F.when(year < 1892, first).when(year >= 1892, second).otherwise(person)).otherwise(person)
