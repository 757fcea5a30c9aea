"""Dates as serial numbers of the 1900 system, in which serial 60 does not exist.

Serials below 60 count from 1899-12-31 and those above from 1899-12-30; 1904 books add 1462 days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import NUM, STR, E, default, num, register

EPOCH_1904 = 1462


def to_serial(c: Column) -> Column:
    """A date or time column as a serial number with its part of a day."""
    days = F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))
    ts = c.cast("timestamp_ntz")
    part = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400.0
    return (F.when(days <= 60, days - 1).otherwise(days)).cast("double") + part


def from_serial(x: Column) -> Column:
    d = F.floor(x).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(d < 60, d + 1).when(d == 60, 60).otherwise(d))


def _seconds(x: Column) -> Column:
    return F.pmod(F.rint((x - F.floor(x)) * 86400), F.lit(86400)).cast("int")


@register("DATE", "iii")
def _date(y, m, d):
    """Months and days roll over."""
    y = F.when(y < 1900, y + 1900).otherwise(y)
    return to_serial(F.date_add(F.add_months(F.call_function("make_date", y, F.lit(1), F.lit(1)), m - 1), d - 1))


register("YEAR", "n")(lambda x: F.year(from_serial(x)).cast("double"))
register("MONTH", "n")(lambda x: F.month(from_serial(x)).cast("double"))
register("DAY", "n")(lambda x: F.day(from_serial(x)).cast("double"))
register("TODAY", "")(lambda: to_serial(F.current_date()))
register("NOW", "")(lambda: to_serial(F.localtimestamp()))
register("TIME", "nnn")(lambda h, m, s: (h * 3600 + m * 60 + s) / 86400)
register("HOUR", "n")(lambda x: F.floor(_seconds(x) / 3600).cast("double"))
register("MINUTE", "n")(lambda x: F.floor(_seconds(x) % 3600 / 60).cast("double"))
register("SECOND", "n")(lambda x: (_seconds(x) % 60).cast("double"))
register("DATEVALUE", "s")(lambda s: to_serial(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))
register("EDATE", "ni")(lambda x, n: to_serial(F.add_months(from_serial(x), n)))
register("EOMONTH", "ni")(lambda x, n: to_serial(F.last_day(F.add_months(from_serial(x), n))))
register("DAYS", "nn")(lambda b, a: b - a)


@register("WEEKDAY", "n|i")
def _weekday(x, kind):
    d = from_serial(x)
    sunday = F.dayofweek(d)
    monday = F.weekday(d)
    kind = default(kind, 1)
    return F.when(kind == 1, sunday).when(kind == 2, monday + 1).when(kind == 3, monday).cast("double")


register("ISOWEEKNUM", "n")(lambda x: F.weekofyear(from_serial(x)).cast("double"))


@register("WEEKNUM", "n|i")
def _weeknum(x, kind):
    """Weeks begin on Sunday (kind 1) or Monday (2), the first holds January 1; 21 is the ISO week."""
    d, kind = from_serial(x), default(kind, 1)
    first = F.trunc(d, "year")
    shift = F.when(kind == 2, F.weekday(first)).otherwise(F.dayofweek(first) - 1)
    return F.when(kind == 21, F.weekofyear(d)).otherwise(F.floor((F.dayofyear(d) - 1 + shift) / 7) + 1).cast("double")


def _rest(kind: Column) -> Column:
    """The days off, Monday as 0, of a weekend code."""
    pairs = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5)}
    made = F.array(F.lit(5), F.lit(6))
    for code, days in pairs.items():
        made = F.when(kind == code, F.array(*map(F.lit, days))).otherwise(made)
    for code, day in zip(range(11, 18), (6, 0, 1, 2, 3, 4, 5), strict=True):
        made = F.when(kind == code, F.array(F.lit(day))).otherwise(made)
    return made


def _before(n: Column, rest: Column) -> Column:
    """Working days among the days before serial n, counted from a Monday (serial 2)."""
    n = n - 2
    weeks, left = F.floor(n / 7), F.pmod(n, F.lit(7))
    return weeks * (7 - F.size(rest)) + left - F.size(F.filter(rest, lambda d: d < left))


@register("NETWORKDAYS", "nn|e")
def _networkdays(a, b, holidays):
    return _network(a, b, F.lit(1), holidays)


@register("NETWORKDAYS.INTL", "nn|ie")
def _networkdays_intl(a, b, kind, holidays):
    return _network(a, b, default(kind, 1), holidays)


def _off(holidays: E | None, rest: Column) -> Column:
    from lattica.functions.core import numbers

    if holidays is None:
        return F.array().cast("array<double>")
    return F.array_distinct(F.filter(numbers([holidays]), lambda h: ~F.array_contains(rest, F.pmod(F.floor(h) - 2, F.lit(7)).cast("int"))))


def _network(a, b, kind, holidays):
    lo, hi, rest = F.floor(F.least(a, b)), F.floor(F.greatest(a, b)), _rest(kind)
    off = F.size(F.filter(_off(holidays, rest), lambda h: h.between(lo, hi)))
    return F.when(b < a, -1.0).otherwise(1.0) * (_before(hi + 1, rest) - _before(lo, rest) - off)


@register("WORKDAY", "ni")
def _workday(x, n):
    return _step(x, n, F.lit(1))


@register("WORKDAY.INTL", "ni|i")
def _workday_intl(x, n, kind):
    return _step(x, n, default(kind, 1))


def _step(x, n, kind):
    """Whole weeks by arithmetic, and at most two more by looking."""
    rest = _rest(kind)
    work = 7 - F.size(rest)
    x, way = F.floor(x), F.signum(n)
    weeks = F.floor((F.abs(n) - 1) / work)
    left = F.abs(n) - weeks * work
    base = x + way * weeks * 7
    days = F.filter(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: base + way * k), lambda d: ~F.array_contains(rest, F.pmod(d - 2, F.lit(7)).cast("int")))
    return F.when(n == 0, x).otherwise(F.get(days, left.cast("int") - 1))


def _thirty(a, b):
    d1, d2 = from_serial(a), from_serial(b)
    x, y = F.least(F.day(d1), F.lit(30)), F.least(F.day(d2), F.lit(30))
    return ((F.year(d2) - F.year(d1)) * 360 + (F.month(d2) - F.month(d1)) * 30 + y - x).cast("double")


register("DAYS360", "nn|b")(lambda a, b, european: _thirty(a, b))


@register("YEARFRAC", "nn|i")
def _yearfrac(a, b, basis):
    lo, hi, basis = F.least(a, b), F.greatest(a, b), default(basis, 0)
    years = F.year(from_serial(hi)) - F.year(from_serial(lo)) + 1
    span = F.datediff(F.call_function("make_date", F.year(from_serial(hi)) + 1, F.lit(1), F.lit(1)), F.trunc(from_serial(lo), "year"))
    return F.when(basis == 1, (hi - lo) / (span / years)).when(basis == 2, (hi - lo) / 360).when(basis == 3, (hi - lo) / 365).otherwise(_thirty(lo, hi) / 360)


register("DATESTRING", "n", STR)(lambda x: F.date_format(from_serial(x), "yy/MM/dd"))

__all__ = ["NUM", "from_serial", "num", "to_serial"]
