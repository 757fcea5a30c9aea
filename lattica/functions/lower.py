"""Syntax trees to Columns. A formula that is filled down a table becomes one Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.core import BOOL, GRID, NUM, REGISTRY, STR, E, Fun, as_grid, boolean, compare, grid, lambda_body, lit, num, txt
from lattica.functions.parser import Call, Const, FormulaError, Name, Op, Percent, Range, Ref, Sign, column_letters, parse

MAX_ROW, MAX_COL = 1_048_576, 16_384


class Scope:
    """Where names and references come from. Subclasses say what a cell and a range are."""

    row = 1
    col = 1

    def __init__(self, names: dict[str, E | Fun] | None = None):
        self.names = {k.lower(): v for k, v in (names or {}).items()}

    def cell(self, ref: Ref) -> E:
        raise FormulaError("there are no cells here")

    def range(self, r: Range) -> E:
        rows = [[self.cell(Ref(c, w, r.first.sheet)) for c in range(r.first.col, r.last.col + 1)] for w in range(r.first.row, r.last.row + 1)]
        return grid(rows)

    def with_names(self, more: dict) -> Scope:
        import copy

        inner = copy.copy(self)
        inner.names = {**self.names, **{k.lower(): v for k, v in more.items()}}
        return inner


class Cells(Scope):
    """Cells from a dictionary of A1 names to Python values or expressions."""

    def __init__(self, cells: dict[str, object], names=None):
        super().__init__(names)
        self.cells = {k.upper(): v if isinstance(v, E) else lit(v) for k, v in cells.items()}

    def cell(self, ref: Ref) -> E:
        return self.cells.get(f"{column_letters(ref.col)}{ref.row}", lit(None))


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STR
    if isinstance(t, T.BooleanType):
        return BOOL
    return NUM if isinstance(t, T.NumericType) else None


def column_expression(df: DataFrame, name: str) -> E:
    from lattica.functions.dates import to_serial

    t, c = df.schema[name].dataType, F.col(f"`{name}`")
    if kind := kind_of(t):
        return E(c.cast("double") if kind == NUM else c, kind)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return E(to_serial(c), NUM)
    if isinstance(t, T.ArrayType) and (kind := kind_of(t.elementType)):
        cells = c.cast("array<double>") if kind == NUM else c
        return E(F.transform(cells, lambda x: F.array(x)), GRID, kind)
    raise FormulaError(f"column {name} has no formula kind: {t.simpleString()}")


class TableRow(Scope):
    """A row of a DataFrame: letters are its columns in order, names are their names; the row number is the anchor's."""

    def __init__(self, df: DataFrame, names=None):
        super().__init__(names)
        self.df = df

    def cell(self, ref: Ref) -> E:
        if ref.col > len(self.df.columns):
            return lit(None)
        return column_expression(self.df, self.df.columns[ref.col - 1])

    def named(self, name: str) -> E | None:
        found = [c for c in self.df.columns if c.lower() == name.lower()]
        return column_expression(self.df, found[0]) if found else None


def _op(op: str, a: E, b: E) -> E:
    if GRID in (a.kind, b.kind):  # cell by cell; a single value meets every cell
        kind = []

        def one(x, y):
            made = _op(op, E(x, a.base), E(y, b.base))
            kind.append(made.kind)
            return made.col

        if a.kind != GRID:
            cells = F.transform(b.col, lambda r: F.transform(r, lambda y: one(a.col, y)))
        elif b.kind != GRID:
            cells = F.transform(a.col, lambda r: F.transform(r, lambda x: one(x, b.col)))
        else:
            cells = F.zip_with(a.col, b.col, lambda r, s: F.zip_with(r, s, one))
        return E(cells, GRID, kind[0])
    if op == "&":
        return E(F.concat(F.coalesce(txt(a), F.lit("")), F.coalesce(txt(b), F.lit(""))), STR)
    if op in ("=", "<>", "<", ">", "<=", ">="):
        return E(compare(a, op, b), BOOL)
    x, y = num(a), num(b)
    return E({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "^": lambda: F.pow(x, y)}[op](), NUM)


def lower(tree, scope: Scope) -> E:
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Const):
        return lit(tree.value)
    if isinstance(tree, Ref):
        return scope.cell(tree)
    if isinstance(tree, Range):
        return scope.range(tree)
    if isinstance(tree, Name):
        found = scope.names.get(tree.name.lower())
        if found is None and isinstance(scope, TableRow):
            found = scope.named(tree.name)
        if found is None:
            raise FormulaError(f"#NAME? {tree.name}")
        return found
    if isinstance(tree, Sign):
        value = lower(tree.value, scope)
        return _op("-", lit(0), value) if tree.minus else value
    if isinstance(tree, Percent):
        return _op("/", lower(tree.value, scope), lit(100))
    if isinstance(tree, Op):
        return _op(tree.op, lower(tree.left, scope), lower(tree.right, scope))
    if isinstance(tree, Call):
        if tree.name in SPECIAL:
            return SPECIAL[tree.name](tree.args, scope)
        own = scope.names.get(tree.name.lower())
        if isinstance(own, Fun):
            return own.call(*(lower(a, scope) for a in tree.args))
        if tree.name not in REGISTRY:
            raise FormulaError(f"#NAME? {tree.name}")
        return REGISTRY[tree.name](*(lower(a, scope) for a in tree.args))
    raise FormulaError(f"cannot lower {tree!r}")


# ---------------------------------------------------------------- special forms


def _let(args, scope):
    if len(args) < 3 or len(args) % 2 == 0:
        raise FormulaError("LET takes pairs of name and value, and a result")
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        scope = scope.with_names({_name(name): lower(value, scope)})
    return lower(args[-1], scope)


def _name(tree) -> str:
    if isinstance(tree, Name):
        return tree.name
    if isinstance(tree, Ref):  # a name such as x1 reads as a reference
        return f"{column_letters(tree.col)}{tree.row}"
    raise FormulaError("a name is expected")


def _lambda(args, scope):
    params = [_name(a) for a in args[:-1]]

    def call(*given: E) -> E:
        bound = {p: given[k] if k < len(given) else lit(None) for k, p in enumerate(params)}
        with lambda_body():
            return lower(args[-1], scope.with_names(bound))

    return Fun(len(params), call)


def _span(tree) -> Range | None:
    return tree if isinstance(tree, Range) else Range(tree, tree) if isinstance(tree, Ref) else None


def _measure(pick, size):
    def form(args, scope):
        if not args:
            return lit(pick(scope))
        span = _span(args[0])
        if span is not None:
            return lit(size(span))
        return None

    return form


def _rows(args, scope):
    span = _span(args[0])
    return lit(span.last.row - span.first.row + 1) if span else E(F.size(as_grid(lower(args[0], scope)).col).cast("double"), NUM)


def _columns(args, scope):
    span = _span(args[0])
    return lit(span.last.col - span.first.col + 1) if span else E(F.size(F.get(as_grid(lower(args[0], scope)).col, 0)).cast("double"), NUM)


def _constant(tree, what: str) -> float:
    if isinstance(tree, Sign) and isinstance(tree.value, Const):
        return -float(tree.value.value) if tree.minus else float(tree.value.value)
    if isinstance(tree, Const) and not isinstance(tree.value, str):
        return float(tree.value)
    raise FormulaError(f"{what} must be a constant here")


def _offset(args, scope):
    span = _span(args[0])
    if span is None:
        raise FormulaError("OFFSET starts from a reference")
    down, right = (int(_constant(a, "a distance")) for a in args[1:3])
    height = int(_constant(args[3], "the height")) if len(args) > 3 else span.last.row - span.first.row + 1
    width = int(_constant(args[4], "the width")) if len(args) > 4 else span.last.col - span.first.col + 1
    row, col = span.first.row + down, span.first.col + right
    if row < 1 or col < 1 or row + height - 1 > MAX_ROW or col + width - 1 > MAX_COL:
        return lit(None)
    if height == width == 1:
        return scope.cell(Ref(col, row, span.first.sheet))
    return scope.range(Range(Ref(col, row, span.first.sheet), Ref(col + width - 1, row + height - 1)))


def _indirect(args, scope):
    if not (isinstance(args[0], Const) and isinstance(args[0].value, str)):
        raise FormulaError("INDIRECT resolves a literal reference")
    return lower(parse(args[0].value), scope)


def _is_ref(args, scope):
    return lit(_span(args[0]) is not None)


def _array(args, scope):
    return grid([[lower(x, scope) for x in row] for row in args])


SPECIAL = {
    "LET": _let,
    "LAMBDA": _lambda,
    "ROW": _measure(lambda s: s.row, lambda r: r.first.row),
    "COLUMN": _measure(lambda s: s.col, lambda r: r.first.col),
    "ROWS": _rows,
    "COLUMNS": _columns,
    "AREAS": lambda args, scope: lit(1),
    "ISREF": _is_ref,
    "INDIRECT": _indirect,
    "OFFSET": _offset,
    "{}": _array,
}


# ---------------------------------------------------------------- entry points


def row_formula(df: DataFrame, text: str, names: dict[str, E] | None = None) -> Column:
    """The Column of a formula that is filled down df; a grid comes as an array of rows."""
    made = lower(parse(text), TableRow(df, names))
    if isinstance(made, Fun):
        raise FormulaError("a LAMBDA is not a value")
    return made.col


def constant_formula(text: str, cells: dict[str, object] | None = None) -> Column:
    """The Column of a formula over literal cells."""
    return lower(parse(text), Cells(cells or {})).col


__all__ = ["Cells", "Scope", "TableRow", "boolean", "constant_formula", "lower", "row_formula"]
