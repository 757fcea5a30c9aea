"""Annuities, depreciation, rates. Roots are found by bisection, of whole Arrow batches; in the body of a LAMBDA,
where Spark takes no Python, and for flows that are not written out cell by cell, inside the row's expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import STR, E, default, flat, in_lambda, num, numbers, register, written
from lattica.functions.mathematics import away

LOW, HIGH, HALVINGS = -0.9999, 10.0, 200


def solve(f, low: float = LOW, high: float = HIGH) -> Column:
    """The root of f between low and high by halving, or null where the ends have one sign."""
    lo, hi = F.lit(low), F.lit(high)

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        value = f(mid)
        left = F.signum(value) == F.signum(s["flo"])
        return F.struct(F.when(left, mid).otherwise(s["lo"]).alias("lo"), F.when(left, s["hi"]).otherwise(mid).alias("hi"), F.when(left, value).otherwise(s["flo"]).alias("flo"))

    start = F.struct(lo.alias("lo"), hi.alias("hi"), f(lo).alias("flo"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(F.signum(f(lo)) * F.signum(f(hi)) <= 0, root)


def halved(gap, rows: int) -> np.ndarray:
    """The roots of gap, which takes a rate for each row, between LOW and HIGH; NaN where the ends have one sign."""
    low, high = np.full(rows, LOW), np.full(rows, HIGH)
    with np.errstate(all="ignore"):
        start, end = np.sign(gap(low)), np.sign(gap(high))
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            if not ((low < mid) & (mid < high)).any():
                break
            left = np.sign(gap(mid)) == start
            low, high = np.where(left, mid, low), np.where(left, high, mid)
    return np.where(start * end <= 0, (low + high) / 2, np.nan)


def roots(gap):
    """A Pandas UDF: gap makes of a batch's columns the function that `halved` takes."""
    import pandas as pd

    @F.pandas_udf("double", F.PandasUDFType.SCALAR)
    def run(*columns):
        return pd.Series(halved(gap(*columns), len(columns[0])))

    return lambda *columns: F.nanvl(run(*columns), F.lit(None).cast("double"))


def annuity_gap(n, pay, pv, f, when):
    """What is left of an annuity at a rate, over its growth where that is above 1, so that no power overflows."""
    n, pay, pv, f, when = (np.asarray(c, dtype=float) for c in (n, pay, pv, f, when))

    def gap(r):
        grown = n * np.log1p(r)
        part, by = np.exp(-np.abs(grown)), np.expm1(-np.abs(grown))
        paid = pay * (1 + r * when) * np.where(r == 0, n, np.where(grown > 0, -by, by) / r)
        return np.where(grown > 0, pv + paid + f * part, pv * part + paid + f)

    return gap


def _packed(columns):
    """(cells, count) of each row, empty cells behind the others."""
    cells = np.column_stack([np.asarray(c, dtype=float) for c in columns])
    empty = np.isnan(cells)
    return np.take_along_axis(cells, np.argsort(empty, axis=1, kind="stable"), 1), (~empty).sum(axis=1)


def _worth(flows, times, count):
    """The flows' worth at a rate, at the first time where it is above 0 and else at the last, so that no power overflows."""
    held = np.arange(flows.shape[1]) < count[:, None]
    flows, times = np.where(held, flows, 0.0), np.where(held, times, times[:, :1])
    forth, back = times.min(axis=1, keepdims=True) - times, times.max(axis=1, keepdims=True) - times

    def gap(r):
        return (flows * np.exp(np.where(r[:, None] < 0, back, forth) * np.log1p(r)[:, None])).sum(axis=1)

    return gap


def periods_gap(*flows):
    flows, count = _packed(flows)
    return _worth(np.where(count[:, None] > 0, flows, np.nan), np.broadcast_to(np.arange(flows.shape[1], dtype=float), flows.shape), np.maximum(count, 1))


def dates_gap(*columns):
    """Flows, then as many days; as many of both must be there in a row."""
    flows, count = _packed(columns[: len(columns) // 2])
    days, there = _packed(columns[len(columns) // 2 :])
    right = (count == there) & (count > 0)
    return _worth(np.where(right[:, None], flows, np.nan), np.where(right[:, None], days, 0.0) / 365.0, np.maximum(count, 1))


def npv(rate: Column, flows: Column) -> Column:
    return F.aggregate(
        flows,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("k")),
        lambda a, x: F.struct((a["sum"] + x / F.pow(1 + rate, a["k"])).alias("sum"), (a["k"] + 1).alias("k")),
        lambda a: a["sum"],
    )


register("NPV", "nN")(npv)


def _cells(e: E) -> list[Column]:
    """The numbers of a value or of a grid that is written out, or none."""
    return [num(x) for r in written(e) or [] for x in r if x.kind != STR]


@register("IRR", "e|n")
def irr(flows, guess):
    cells = _cells(flows)
    if cells and not in_lambda():
        return roots(periods_gap)(*cells)
    flows = numbers([flows])
    return solve(lambda r: npv(r, flows))


def _growth(rate, n):
    return F.pow(1 + rate, n)


def pmt(rate, n, pv, fv, when):
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + fv) / n).otherwise(-(pv * g + fv) * rate / ((g - 1) * (1 + rate * when)))


def fv(rate, n, pay, pv, when):
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + pay * n)).otherwise(-(pv * g + pay * (1 + rate * when) * F.try_divide(g - 1, rate)))


register("PMT", "nnn|nn")(lambda r, n, pv, f, w: pmt(r, n, pv, default(f, 0.0), default(w, 0.0)))
register("FV", "nnn|nn")(lambda r, n, p, pv, w: fv(r, n, p, default(pv, 0.0), default(w, 0.0)))


@register("PV", "nnn|nn")
def pv(rate, n, pay, f, when):
    f, when, g = default(f, 0.0), default(when, 0.0), _growth(rate, n)
    return F.when(rate == 0, -(f + pay * n)).otherwise(-(f + pay * (1 + rate * when) * F.try_divide(g - 1, rate)) / g)


@register("NPER", "nnn|nn")
def nper(rate, pay, pv, f, when):
    f, when = default(f, 0.0), default(when, 0.0)
    unit = pay * (1 + rate * when)
    return F.when(rate == 0, F.try_divide(-(pv + f), pay)).otherwise(F.log(F.try_divide(unit - f * rate, unit + pv * rate)) / F.log(1 + rate))


@register("RATE", "nnn|nnn")
def rate(n, pay, pv, f, when, guess):
    f, when = default(f, 0.0), default(when, 0.0)
    if not in_lambda():
        return roots(annuity_gap)(n, pay, pv, f, when)

    def gap(r):
        return pv * _growth(r, n) + F.when(F.abs(r) < 1e-12, pay * n).otherwise(pay * (1 + r * when) * F.try_divide(_growth(r, n) - 1, r)) + f

    return solve(gap)


def _dated(rate, flows, days):
    first = F.get(days, 0)
    return F.aggregate(F.zip_with(flows, days, lambda v, d: v / F.pow(1 + rate, (d - first) / 365.0)), F.lit(0.0), lambda a, x: a + x)


register("XNPV", "nee")(lambda r, v, d: _dated(r, numbers([v]), numbers([d])))


@register("XIRR", "ee|n")
def xirr(flows, days, guess):
    cells, dated = _cells(flows), _cells(days)
    if cells and len(cells) == len(dated) and not in_lambda():
        return roots(dates_gap)(*cells, *dated)
    return solve(lambda r: _dated(r, numbers([flows]), numbers([days])))


register("SLN", "nnn")(lambda cost, salvage, life: F.try_divide(cost - salvage, life))
register("SYD", "nnnn")(lambda cost, salvage, life, k: (cost - salvage) * (life - k + 1) * 2 / (life * (life + 1)))


def _interest(rate, k, n, pv, f, when):
    pay = pmt(rate, n, pv, f, when)
    before = fv(rate, k - 1, pay, pv, when)
    plain = before * rate
    return F.when((when == 1) & (k == 1), 0.0).when(when == 1, plain / (1 + rate)).otherwise(plain)


@register("IPMT", "nnnn|nn")
def ipmt(rate, k, n, pv, f, when):
    return _interest(rate, k, n, pv, default(f, 0.0), default(when, 0.0))


@register("PPMT", "nnnn|nn")
def ppmt(rate, k, n, pv, f, when):
    f, when = default(f, 0.0), default(when, 0.0)
    return pmt(rate, n, pv, f, when) - _interest(rate, k, n, pv, f, when)


def _cumulated(of_interest: bool):
    def f(rate, n, pv, first, last, when):
        first, last = (F.floor(k).cast("double") for k in (first, last))
        pay = pmt(rate, n, pv, F.lit(0.0), when)

        def owed(k):
            return F.when(k == 0, pv).when(k == n, 0.0).otherwise(-fv(rate, k, pay, pv, when) / (1 + rate * when))

        principal = owed(last) - owed(first - 1)
        return F.when((first >= 1) & (last >= first), (last - first + 1) * pay - principal if of_interest else principal)

    return f


register("CUMIPMT", "nnnnnn")(_cumulated(True))
register("CUMPRINC", "nnnnnn")(_cumulated(False))
register("EFFECT", "nn")(lambda r, n: F.pow(1 + r / F.floor(n), F.floor(n)) - 1)
register("NOMINAL", "nn")(lambda r, n: F.floor(n) * (F.pow(1 + r, 1 / F.floor(n)) - 1))


@register("DDB", "nnnn|n")
def ddb(cost, salvage, life, period, factor):
    share = F.least(default(factor, 2.0) / life, F.lit(1.0))
    start = F.struct(cost.alias("book"), F.lit(0.0).alias("part"))

    def year(s, _):
        part = F.greatest(F.least(s["book"] * share, s["book"] - salvage), F.lit(0.0))
        return F.struct((s["book"] - part).alias("book"), part.alias("part"))

    return F.aggregate(F.sequence(F.lit(1), period.cast("int")), start, year, lambda s: s["part"])


@register("DB", "nnnn|n")
def db(cost, salvage, life, period, months):
    months = default(months, 12.0)
    share = away((1 - F.pow(salvage / cost, 1 / life)) * 1000) / 1000
    start = F.struct(cost.alias("book"), F.lit(0.0).alias("part"))

    def year(s, k):
        part = F.when(k == 1, cost * share * months / 12).when(k == life + 1, s["book"] * share * (12 - months) / 12).otherwise(s["book"] * share)
        return F.struct((s["book"] - part).alias("book"), part.alias("part"))

    return F.aggregate(F.sequence(F.lit(1), period.cast("int")), start, year, lambda s: s["part"])


register("FVSCHEDULE", "ne")(lambda p, rates: F.aggregate(numbers([rates]), p, lambda a, r: a * (1 + r)))
_whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
_scale = lambda n: F.pow(F.lit(10.0), F.ceil(F.log10(F.floor(n))))
register("DOLLARDE", "nn")(lambda x, n: _whole(x) + (x - _whole(x)) * _scale(n) / F.floor(n))
register("DOLLARFR", "nn")(lambda x, n: _whole(x) + (x - _whole(x)) * F.floor(n) / _scale(n))
register("PDURATION", "nnn")(lambda r, pv, f: (F.log(f) - F.log(pv)) / F.log(1 + r))
register("RRI", "nnn")(lambda n, pv, f: F.pow(f / pv, 1 / n) - 1)

__all__ = ["E", "flat", "num"]
