"""T1-T3, T7, T8 helpers: US business days and market close as Column rules.

A business day is Monday-Friday and not a US federal holiday (observed
dates included, see ``config.FIXED_DATE_HOLIDAYS`` / ``FLOATING_HOLIDAYS``).
All rules are built-in Column expressions, so they work on a column, inside
higher-order functions (``filter`` over a ``sequence`` of dates) and in
whole-stage codegen, with no calendar to ship or join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _years(y: Column, first: int, last: int | None) -> Column:
    cond = y >= F.lit(first)
    return cond if last is None else cond & (y <= F.lit(last))


def fixed_date_holiday(d: Column) -> Column:
    """The actual (not observed) date of a fixed-date holiday."""
    y, m, dd = F.year(d), F.month(d), F.dayofmonth(d)
    terms = [(m == month) & (dd == day) & _years(y, first, last)
             for _, month, day, first, last in config.FIXED_DATE_HOLIDAYS]
    return _any(terms)


def floating_holiday(d: Column) -> Column:
    """n-th (or last) given weekday of a month."""
    y, m, dd, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)
    terms = []
    for _, month, weekday, nth, first, last in config.FLOATING_HOLIDAYS:
        if nth > 0:
            which = F.floor((dd - 1) / 7) + 1 == nth
        else:  # last such weekday: a week later is another month
            which = F.month(F.date_add(d, 7)) != m
        terms.append((m == month) & (wd == weekday) & which & _years(y, first, last))
    return _any(terms)


def _any(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def is_holiday(d: Column) -> Column:
    """Holiday or observed holiday: a fixed-date holiday on Saturday is
    observed the Friday before, on Sunday the Monday after."""
    wd = F.weekday(d)
    return (fixed_date_holiday(d) | floating_holiday(d)
            | ((wd == 4) & fixed_date_holiday(F.date_add(d, 1)))
            | ((wd == 0) & fixed_date_holiday(F.date_sub(d, 1))))


def is_business_day(d: Column) -> Column:
    """T1."""
    return (F.weekday(d) < 5) & ~is_holiday(d)


def next_business_days(d: Column, n: Column | int) -> Column:
    """``array<date>`` of the next ``n`` business days strictly after ``d``.

    ``2n + 14`` calendar days always hold ``n`` business days (at most 2
    weekend days in 7, at most ~11 holidays a year).
    """
    n = F.lit(n) if isinstance(n, int) else n
    span = F.sequence(F.date_add(d, 1), F.date_add(d, n * 2 + 14))
    return F.slice(F.filter(span, is_business_day), 1, n)


def last_business_day(d: Column) -> Column:
    """Last business day strictly before ``d`` (never more than 5 days back)."""
    back = F.sequence(F.date_sub(d, 1), F.date_sub(d, 10), F.expr("INTERVAL -1 DAY"))
    return F.element_at(F.filter(back, is_business_day), 1)


def market_close_utc(day: Column) -> Column:
    """16:30 New York time on ``day`` as a UTC instant (DST-aware)."""
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day),
                                 F.lit(config.MARKET_CLOSE_HOUR), F.lit(config.MARKET_CLOSE_MINUTE),
                                 F.lit(0))
    return F.to_utc_timestamp(local.cast("timestamp"), config.MARKET_TIMEZONE)


def market_date(instant: Column) -> Column:
    """The New York calendar date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, config.MARKET_TIMEZONE))
