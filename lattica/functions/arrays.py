"""Dynamic arrays and higher-order functions, on grids that are array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import BOOL, GRID, NUM, STR, E, Fun, _boolean, _num, _txt, as_grid, column_grid, default, grid, lit, num, register, total, txt, written


def _size(g: Column) -> tuple[Column, Column]:
    return F.size(g), F.coalesce(F.size(F.get(g, 0)), F.lit(0))


def transpose(g: Column) -> Column:
    rows, cols = _size(g)
    indexes = F.filter(F.sequence(F.lit(0), F.greatest(cols - 1, F.lit(0))), lambda i: i < cols)
    return F.transform(indexes, lambda c: F.transform(g, lambda r: F.get(r, c)))


def _index(n: Column) -> Column:
    """0 .. n - 1 as whole numbers."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: i < n)


register("TRANSPOSE")(lambda g: grid([list(c) for c in zip(*written(g), strict=True)]) if written(g) else E(transpose(as_grid(g).col), GRID, g.base))


@register("SEQUENCE", "n|nnn")
def _sequence(rows, cols, start, step):
    cols, start, step = default(cols, 1.0), default(start, 1.0), default(step, 1.0)
    return E(F.transform(_index(rows), lambda r: F.transform(_index(cols), lambda c: start + (r * cols + c) * step)), GRID)


register("MUNIT", "n")(lambda n: E(F.transform(_index(n), lambda r: F.transform(_index(n), lambda c: (r == c).cast("double"))), GRID))


def _numeric(g: E) -> Column:
    g = as_grid(g)
    return F.transform(g.col, lambda r: F.transform(r, lambda x: _num(x, g.elem)))


@register("MMULT")
def _mmult(a: E, b: E):
    columns = transpose(_numeric(b))
    made = F.transform(_numeric(a), lambda r: F.transform(columns, lambda c: total(F.zip_with(r, c, lambda x, y: x * y))))
    return E(F.when(_size(as_grid(a).col)[1] == _size(as_grid(b).col)[0], made), GRID)


def _linear(kind: str):
    import numpy as np

    def one(rows):
        m = np.array([list(r) for r in rows], float)
        if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isfinite(m).all():
            return None
        if kind == "det":
            return float(np.linalg.det(m))
        return None if abs(np.linalg.det(m)) < 1e-300 else np.linalg.inv(m).tolist()

    @F.pandas_udf("double" if kind == "det" else "array<array<double>>", F.PandasUDFType.SCALAR)
    def run(column):
        return column.map(lambda rows: None if rows is None else one(rows))

    return run


register("MDETERM")(lambda g: E(_linear("det")(_numeric(g)), NUM))
register("MINVERSE")(lambda g: E(_linear("inv")(_numeric(g)), GRID))


def _common(args) -> tuple[list[Column], str]:
    kinds = {a.base for a in args}
    kind = kinds.pop() if len(kinds) == 1 else STR if STR in kinds else NUM
    to = {NUM: _num, STR: _txt, BOOL: _boolean}[kind]
    grids = [as_grid(a) for a in args]
    return [F.transform(g.col, lambda r: F.transform(r, lambda x: to(x, g.elem))) for g in grids], kind


def _padded(row: Column, width: Column) -> Column:
    return F.transform(_index(width), lambda i: F.get(row, i))


@register("VSTACK")
def _vstack(*args: E):
    given = [written(a) for a in args]
    if all(g is not None for g in given):
        width = max(len(r) for g in given for r in g)
        return grid([r + [lit(None)] * (width - len(r)) for g in given for r in g])
    grids, kind = _common(args)
    width = F.greatest(*(_size(g)[1] for g in grids), F.lit(0))
    return E(F.concat(*(F.transform(g, lambda r: _padded(r, width)) for g in grids)), GRID, kind)


@register("HSTACK")
def _hstack(*args: E):
    given = [written(a) for a in args]
    if all(g is not None for g in given):
        height = max(len(g) for g in given)
        return grid([[x for g in given for x in (g[i] if i < len(g) else [lit(None)] * len(g[0]))] for i in range(height)])
    grids, kind = _common(args)
    height = F.greatest(*(_size(g)[0] for g in grids), F.lit(0))
    return E(F.transform(_index(height), lambda i: F.concat(*(_padded(F.get(g, i), _size(g)[1]) for g in grids))), GRID, kind)


def _take(array: Column, n: Column) -> Column:
    return F.when(n >= 0, F.slice(array, F.lit(1), n)).otherwise(F.slice(array, F.greatest(F.size(array) + n, F.lit(0)) + 1, F.least(-n, F.size(array))))


def _drop(array: Column, n: Column) -> Column:
    keep = F.greatest(F.size(array) - F.abs(n), F.lit(0))
    return F.when(n >= 0, F.slice(array, n + 1, keep)).otherwise(F.slice(array, F.lit(1), keep))


def _cut(f):
    def run(g: E, rows: E, cols: E | None = None):
        cells = f(as_grid(g).col, num(rows).cast("int"))
        if cols is not None:
            cells = F.transform(cells, lambda r: f(r, num(cols).cast("int")))
        return E(cells, GRID, g.base)

    return run


register("TAKE")(_cut(_take))
register("DROP")(_cut(_drop))


@register("FILTER")
def _filter(g: E, mask: E, other: E | None = None):
    cells, keep = as_grid(g).col, as_grid(mask)
    across = (F.size(keep.col) == 1) & (F.size(cells) > 1)
    by_row = F.transform(keep.col, lambda r: F.exists(r, lambda x: F.coalesce(_boolean(x, keep.elem), F.lit(False))))
    by_col = F.transform(F.get(keep.col, 0), lambda x: F.coalesce(_boolean(x, keep.elem), F.lit(False)))
    rows = F.filter(cells, lambda r, i: F.coalesce(F.get(by_row, i), F.lit(False)))
    made = F.when(across, F.transform(cells, lambda r: F.filter(r, lambda x, i: F.coalesce(F.get(by_col, i), F.lit(False))))).otherwise(rows)
    made = F.when(F.size(F.flatten(made)) > 0, made)
    if other is not None:
        (made, alone), kind = _common([E(made, GRID, g.base), other])
        return E(F.coalesce(made, alone), GRID, kind)
    return E(made, GRID, g.base)


@register("UNIQUE")
def _unique(g: E, by_col: E | None = None, once: E | None = None):
    """Distinct rows by display text without case, the first of each."""
    cells = as_grid(g).col
    keys = F.transform(cells, lambda r: F.array_join(F.transform(r, lambda x: F.concat(F.length(F.coalesce(_txt(x, g.base), F.lit(""))).cast("string"), F.lit(":"), F.upper(F.coalesce(_txt(x, g.base), F.lit(""))))), "|"))
    first = F.filter(cells, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    if once is not None:
        single = F.filter(cells, lambda r, i: F.size(F.filter(keys, lambda k: k == F.get(keys, i))) == 1)
        return E(F.when(_boolean(once.col, once.kind), single).otherwise(first), GRID, g.base)
    return E(first, GRID, g.base)


def _sorted(cells: Column, key: Column, down: Column) -> Column:
    """Rows by an array of keys, stably."""
    order = F.transform(key, lambda k, i: F.struct(k.isNull().alias("empty"), k.alias("k"), i.alias("i")))
    up = F.transform(F.array_sort(order), lambda s: s["i"])
    tagged = F.transform(key, lambda k, i: F.struct(k.isNotNull().alias("held"), k.alias("k"), (-i).alias("i")))
    falling = F.transform(F.sort_array(tagged, False), lambda s: -s["i"])
    return F.transform(F.when(down, falling).otherwise(up), lambda i: F.get(cells, i))


@register("SORT")
def _sort(g: E, index: E | None = None, order: E | None = None):
    cells = as_grid(g).col
    at = F.lit(0) if index is None else num(index).cast("int") - 1
    down = F.lit(False) if order is None else num(order) < 0
    return E(_sorted(cells, F.transform(cells, lambda r: F.get(r, at)), down), GRID, g.base)


@register("SORTBY")
def _sortby(g: E, by: E, order: E | None = None):
    down = F.lit(False) if order is None else num(order) < 0
    return E(_sorted(as_grid(g).col, F.flatten(as_grid(by).col), down), GRID, g.base)


def _picked(array: Column, wanted: list[E]) -> Column:
    """Places from 1, from the end where negative; those outside are left out."""
    places = F.array(*(num(w).cast("int") for w in wanted))
    places = F.transform(places, lambda p: F.when(p < 0, F.size(array) + p).otherwise(p - 1))
    return F.transform(F.filter(places, lambda p: (p >= 0) & (p < F.size(array))), lambda p: F.get(array, p))


register("CHOOSEROWS")(lambda g, *wanted: E(_picked(as_grid(g).col, wanted), GRID, g.base))
register("CHOOSECOLS")(lambda g, *wanted: E(F.transform(as_grid(g).col, lambda r: _picked(r, wanted)), GRID, g.base))
register("TOCOL")(lambda g: column_grid(F.flatten(as_grid(g).col), g.base))
register("TOROW")(lambda g: E(F.array(F.flatten(as_grid(g).col)), GRID, g.base))

# ---------------------------------------------------------------- lambdas


def _with_kind(f):
    """Calls f with a list that takes the kind of what its lambda gives."""
    kind: list[str] = []
    made = f(kind)
    return made, kind[0]


def _said(kind: list[str], e: E) -> Column:
    kind.append(e.base)
    return e.col if e.kind != GRID else F.get(F.get(e.col, 0), 0)


@register("MAP")
def _map(*args):
    *grids, f = args
    if len(grids) == 1:
        g = as_grid(grids[0])
        cells, kind = _with_kind(lambda k: F.transform(g.col, lambda r: F.transform(r, lambda x: _said(k, f.call(E(x, g.elem))))))
        return E(cells, GRID, kind)
    a, b = as_grid(grids[0]), as_grid(grids[1])
    if len(grids) > 2:
        raise TypeError("MAP takes at most two arrays")
    cells, kind = _with_kind(lambda k: F.zip_with(a.col, b.col, lambda r, s: F.zip_with(r, s, lambda x, y: _said(k, f.call(E(x, a.elem), E(y, b.elem))))))
    return E(cells, GRID, kind)


@register("REDUCE")
def _reduce(start: E, g: E, f: Fun):
    made = F.aggregate(F.flatten(as_grid(g).col), start.col, lambda a, x: f.call(E(a, start.kind), E(x, g.base)).col)
    return E(made, start.kind)


@register("SCAN")
def _scan(start: E, g: E, f: Fun):
    kind = {NUM: "double", STR: "string", BOOL: "boolean"}[start.kind]
    begin = F.struct(start.col.alias("now"), F.array().cast(f"array<{kind}>").alias("all"))

    def step(a, x):
        now = f.call(E(a["now"], start.kind), E(x, g.base)).col
        return F.struct(now.alias("now"), F.concat(a["all"], F.array(now)).alias("all"))

    cells = as_grid(g).col
    made = F.aggregate(F.flatten(cells), begin, step, lambda a: a["all"])
    width = _size(cells)[1]
    return E(F.transform(cells, lambda r, i: F.slice(made, i * width + 1, width)), GRID, start.kind)


@register("BYROW")
def _byrow(g: E, f: Fun):
    cells, kind = _with_kind(lambda k: F.transform(as_grid(g).col, lambda r: F.array(_said(k, f.call(E(F.array(r), GRID, g.base))))))
    return E(cells, GRID, kind)


@register("BYCOL")
def _bycol(g: E, f: Fun):
    cells, kind = _with_kind(lambda k: F.transform(transpose(as_grid(g).col), lambda c: _said(k, f.call(E(F.transform(c, lambda x: F.array(x)), GRID, g.base)))))
    return E(F.array(cells), GRID, kind)


@register("MAKEARRAY")
def _makearray(rows: E, cols: E, f: Fun):
    cells, kind = _with_kind(
        lambda k: F.transform(_index(num(rows)), lambda r: F.transform(_index(num(cols)), lambda c: _said(k, f.call(E((r + 1).cast("double"), NUM), E((c + 1).cast("double"), NUM)))))
    )
    return E(cells, GRID, kind)


__all__ = ["transpose", "txt"]
