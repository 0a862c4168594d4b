"""Calendar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_date(evaluated: Column, days: Column | int) -> Column:
    return F.date_sub(evaluated, days)


def bound_month(session: Column) -> Column:
    """The first of the month three months on; December and January give way to February."""
    third = F.add_months(F.trunc(session, "month"), 3)
    return F.when(F.month(third) == 12, F.add_months(third, 2)).when(
        F.month(third) == 1, F.add_months(third, 1),
    ).otherwise(third)


def previous_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), -1)


def bound_label(session: Column) -> Column:
    """The bound month's name, with its year if that is not the session's."""
    bound = bound_month(session)
    return F.when(F.year(bound) == F.year(session), F.date_format(bound, "MMMM")).otherwise(
        F.date_format(bound, "MMMM yyyy")
    )


def expired_session(bound: Column) -> Column:
    """The 9th of the latest month, 3 to 6 months before ``bound`` (a first of a month), whose bound month is ``bound``; null if none is."""
    tries = F.transform(F.sequence(F.lit(3), F.lit(6)), lambda k: F.date_add(F.add_months(bound, -k), 8))
    return F.try_element_at(F.filter(tries, lambda d: bound_month(d) == bound), F.lit(1))
