"""Typed expressions and the function registry.

An expression is a Column with a static kind: number (double), string, boolean, or a grid (array of
rows) of one of those. Spreadsheet errors and empty cells are null; each function says what a null
argument gives by what Spark's functions do with it. Everything stays a JVM expression, but for the
distributions and the roots of RATE, IRR and XIRR, which are vectorised Python over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, STR, BOOL, GRID = "n", "s", "b", "g"
SQL = {NUM: "double", STR: "string", BOOL: "boolean"}


@dataclass
class E:
    col: Column
    kind: str
    elem: str = NUM  # of a grid's cells
    cells: list[list[E]] | None = None  # of a grid that is written out: its cells, each with a kind of its own

    @property
    def base(self) -> str:
        return self.elem if self.kind == GRID else self.kind


@dataclass
class Fun:
    """A LAMBDA: called with expressions."""

    params: int
    call: Callable[..., E]


#: How many bodies of LAMBDAs are being lowered.
_bodies = 0


@contextmanager
def lambda_body():
    global _bodies
    _bodies += 1
    try:
        yield
    finally:
        _bodies -= 1


def in_lambda() -> bool:
    """Is the body of a LAMBDA being lowered, whose variables Spark gives to no Python function?"""
    return _bodies > 0


def lit(value) -> E:
    if value is None:
        return E(F.lit(None).cast("double"), NUM)
    if isinstance(value, bool):
        return E(F.lit(value), BOOL)
    if isinstance(value, str):
        return E(F.lit(value), STR)
    return E(F.lit(float(value)), NUM)


def grid(rows: list[list[E]]) -> E:
    kinds = {x.kind for r in rows for x in r}
    elem = kinds.pop() if len(kinds) == 1 else STR if STR in kinds else NUM
    to = {NUM: num, STR: txt, BOOL: boolean}[elem]
    return E(F.array(*(F.array(*(to(x) for x in r)) for r in rows)), GRID, elem, rows)


def written(e: E) -> list[list[E]] | None:
    """The cells of a value or of a grid that is written out, else None."""
    return [[e]] if e.kind != GRID else e.cells


def column_grid(array: Column, elem: str = NUM) -> E:
    """A one-column grid of an array."""
    return E(F.transform(array, lambda x: F.array(x)), GRID, elem)


# ---------------------------------------------------------------- coercions


def _num(col: Column, kind: str) -> Column:
    if kind == NUM:
        return col
    return col.cast("double") if kind == BOOL else F.btrim(col).try_cast("double")


def shown(col: Column) -> Column:
    """A number as text: whole ones without a point."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("long").cast("string")).otherwise(col.cast("string"))


def _txt(col: Column, kind: str) -> Column:
    return col if kind == STR else shown(col) if kind == NUM else F.upper(col.cast("string"))


def _boolean(col: Column, kind: str) -> Column:
    if kind == BOOL:
        return col
    return col != 0 if kind == NUM else F.when(F.upper(col) == "TRUE", True).when(F.upper(col) == "FALSE", False)


def _scalar(e: E) -> tuple[Column, str]:
    """A grid stands for its first cell where one value is wanted."""
    return (F.get(F.get(e.col, 0), 0), e.elem) if e.kind == GRID else (e.col, e.kind)


def num(e: E) -> Column:
    return _num(*_scalar(e))


def txt(e: E) -> Column:
    return _txt(*_scalar(e))


def boolean(e: E) -> Column:
    return _boolean(*_scalar(e))


def whole(e: E) -> Column:
    return num(e).cast("int")


def flat(e: E) -> Column:
    return F.flatten(e.col) if e.kind == GRID else F.array(e.col)


def as_grid(e: E) -> E:
    return e if e.kind == GRID else E(F.array(F.array(e.col)), GRID, e.kind)


def numbers(args: list[E]) -> Column:
    """All numbers of the arguments, in order, as one array without nulls; text in a grid is skipped."""
    parts = []
    for a in args:
        if a.kind == GRID and a.cells is not None:
            if some := [num(x) for r in a.cells for x in r if x.kind != STR]:
                parts.append(F.array(*some))
            continue
        if a.base == STR and a.kind == GRID:
            continue
        parts.append(F.transform(flat(a), lambda x: _num(x, a.base)) if a.base != NUM else flat(a))
    if not parts:
        return F.array().cast("array<double>")
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def values(args: list[E], to=_txt) -> Column:
    """All values of the arguments as one array of text (or another kind); nulls stay."""

    def convert(a: E):
        return F.transform(flat(a), lambda x: to(x, a.base))

    return F.concat(*map(convert, args))


def total(array: Column, f=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))


def times(array: Column) -> Column:
    return F.aggregate(array, F.lit(1.0), lambda a, x: a * x)


def count(array: Column) -> Column:
    return F.size(array).cast("double")


def mean(array: Column) -> Column:
    return F.try_divide(total(array), count(array))


def compare(a: E, op: str, b: E) -> Column:
    """Numbers by size; where one side is text, by display text without case."""
    (x, xk), (y, yk) = _scalar(a), _scalar(b)
    if STR not in (xk, yk):
        x, y = _num(x, xk), _num(y, yk)
    else:
        x, y = F.upper(F.coalesce(_txt(x, xk), F.lit(""))), F.upper(F.coalesce(_txt(y, yk), F.lit("")))
    return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


# ---------------------------------------------------------------- registry

REGISTRY: dict[str, Callable[..., E]] = {}


def register(names: str, sig: str | None = None, out: str = NUM):
    """Registers a function under one or more names.

    sig has a letter for each argument: n number, i whole number, s text, b boolean, e expression as
    it is; N, S or B (last) all further arguments as one array of numbers, texts or booleans; after |
    come optional ones, missing as None. Without sig the function is given the expressions.
    """

    def wrap(f):
        def call(*args: E) -> E:
            if sig is None:
                made = f(*args)
                return made if isinstance(made, (E, Fun)) else E(made, out)
            needed = sig.split("|")[0]
            letters = sig.replace("|", "")
            given, rest = [], list(args)
            for k, c in enumerate(letters):
                if c in "NSB":
                    given.append({"N": numbers, "S": values, "B": lambda a: values(a, _boolean)}[c](rest))
                    rest = []
                elif rest:
                    a = rest.pop(0)
                    given.append({"n": num, "i": whole, "s": txt, "b": boolean, "e": lambda x: x}[c](a))
                elif k < len(needed):
                    raise TypeError(f"{names.split()[0]} needs {len(needed)} arguments")
                else:
                    given.append(None)
            if rest:
                raise TypeError(f"{names.split()[0]} takes at most {len(letters)} arguments")
            made = f(*given)
            return made if isinstance(made, E) else E(made, out)

        for name in names.split():
            REGISTRY[name] = call
        return f

    return wrap


def default(col: Column | None, value) -> Column:
    return F.lit(value) if col is None else col
