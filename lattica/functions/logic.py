"""Logic, information and lookup functions over grids that fit in a row.

Lookups between tables are joins: see lattica.operators.lookup.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import BOOL, GRID, NUM, STR, E, Fun, _boolean, _num, _txt, as_grid, boolean, compare, flat, lit, num, register, txt, values


def _same_kind(*es: E) -> list[E]:
    kinds = {e.base for e in es}
    kind = kinds.pop() if len(kinds) == 1 else STR if STR in kinds else NUM
    if any(e.kind == GRID for e in es):
        to = {NUM: _num, STR: _txt, BOOL: _boolean}[kind]
        return [E(F.transform(as_grid(e).col, lambda r: F.transform(r, lambda x: to(x, e.base))), GRID, kind) for e in es]
    return [E({NUM: num, STR: txt, BOOL: boolean}[kind](e), kind) for e in es]


def _like(e: E, col: Column) -> E:
    return E(col, e.kind, e.elem)


@register("IF")
def _if(test: E, yes: E | None = None, no: E | None = None):
    yes, no = _same_kind(yes or lit(True), no or lit(False))
    return _like(yes, F.when(boolean(test), yes.col).otherwise(no.col))


@register("IFS")
def _ifs(*args: E):
    results = _same_kind(*args[1::2])
    made = F.lit(None)
    for test, value in list(zip(args[::2], results, strict=True))[::-1]:
        made = F.when(boolean(test), value.col).otherwise(made)
    return _like(results[0], made)


@register("SWITCH")
def _switch(e: E, *args: E):
    cases = args[: len(args) // 2 * 2]
    results = _same_kind(*cases[1::2], *args[len(cases) :])
    made = results[-1].col if len(args) % 2 else F.lit(None)
    for case, value in list(zip(cases[::2], results, strict=False))[::-1]:
        made = F.when(compare(e, "=", case), value.col).otherwise(made)
    return _like(results[0], made)


@register("CHOOSE")
def _choose(index: E, *args: E):
    results = _same_kind(*args)
    made = F.lit(None)
    for k, value in reversed(list(enumerate(results, 1))):
        made = F.when(F.floor(num(index)) == k, value.col).otherwise(made)
    return _like(results[0], made)


@register("IFERROR IFNA")
def _iferror(value: E, other: E):
    value, other = _same_kind(value, other)
    return _like(value, F.coalesce(value.col, other.col))


register("AND", "B", BOOL)(lambda xs: F.forall(F.filter(xs, lambda x: x.isNotNull()), lambda x: x))
register("OR", "B", BOOL)(lambda xs: F.exists(F.filter(xs, lambda x: x.isNotNull()), lambda x: x))
register("XOR", "B", BOOL)(lambda xs: F.size(F.filter(xs, lambda x: x)) % 2 == 1)
register("NOT", "b", BOOL)(lambda x: ~x)
register("TRUE", "", BOOL)(lambda: F.lit(True))
register("FALSE", "", BOOL)(lambda: F.lit(False))
register("NA", "")(lambda: F.lit(None).cast("double"))
register("ISBLANK ISERROR ISERR ISNA ISOMITTED", None, BOOL)(lambda e: txt(e).isNull())
register("ISNUMBER", None, BOOL)(lambda e: F.lit(e.base == NUM) & txt(e).isNotNull())
register("ISTEXT", None, BOOL)(lambda e: F.lit(e.base == STR) & txt(e).isNotNull())
register("ISLOGICAL", None, BOOL)(lambda e: F.lit(e.base == BOOL) & txt(e).isNotNull())
register("ISEVEN", "n", BOOL)(lambda x: F.floor(x) % 2 == 0)
register("ISODD", "n", BOOL)(lambda x: F.floor(x) % 2 != 0)
register("N")(lambda e: E(F.coalesce(num(e), F.lit(0.0)) if e.base != STR else F.lit(0.0), NUM))


@register("TYPE")
def _type(e):
    if isinstance(e, Fun):
        return lit(128)
    return lit({GRID: 64, STR: 2, BOOL: 4, NUM: 1}[e.kind])


#: The errors in the order of their numbers.
ERRORS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"]


@register("ERROR.TYPE", "s")
def _error_type(s):
    at = F.array_position(F.array(*map(F.lit, ERRORS)), s)
    return F.when(at > 0, at.cast("double"))


@register("ADDRESS", "ii|isn", STR)
def _address(row, col, kind, style, sheet):
    kind = F.lit(1) if kind is None else kind
    letters = F.aggregate(
        F.sequence(F.lit(1), F.lit(3)),
        F.struct(col.alias("n"), F.lit("").alias("s")),
        lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("int").alias("n"), F.concat(F.call_function("char", 65 + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a),
        lambda a: a["s"],
    )
    return F.concat(F.when(kind.isin(1, 3), "$").otherwise(""), letters, F.when(kind.isin(1, 2), "$").otherwise(""), row.cast("string"))


# ---------------------------------------------------------------- lookup in a row's own grids


def _where(key: E, array: Column, elem: str) -> Column:
    """1-based place of the first cell that equals the key, else null."""
    hits = F.transform(array, lambda x: F.coalesce(compare(E(x, elem), "=", key), F.lit(False)))
    return F.nullif(F.array_position(hits, True), F.lit(0))


def _approximate(key: E, array: Column, elem: str) -> Column:
    """1-based place of the largest cell at most the key, the first of equals."""
    pairs = F.transform(array, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    best = F.array_max(F.filter(pairs, lambda p: compare(E(p["x"], elem), "<=", key)))
    return 1 - best["i"]


@register("MATCH XMATCH")
def _match(key: E, array: E, kind: E | None = None):
    exact = _where(key, flat(array), array.base)
    if kind is None:
        return exact.cast("double")
    return F.when(num(kind) == 0, exact).otherwise(_approximate(key, flat(array), array.base)).cast("double")


@register("INDEX")
def _index(array: E, row: E, col: E | None = None):
    cells = as_grid(array).col
    line = F.size(cells) == 1
    r = F.floor(num(row)).cast("int")
    if col is None:
        got = F.when(line, F.get(F.get(cells, 0), r - 1)).otherwise(F.get(F.get(cells, r - 1), 0))
    else:
        got = F.get(F.get(cells, r - 1), F.floor(num(col)).cast("int") - 1)
    return E(got, array.base)


@register("VLOOKUP")
def _vlookup(key: E, table: E, index: E, near: E | None = None):
    cells = as_grid(table).col
    first = F.transform(cells, lambda r: F.get(r, 0))
    place = _where(key, first, table.base)
    if near is not None:
        place = F.when(boolean(near), _approximate(key, first, table.base)).otherwise(place)
    return E(F.get(F.get(cells, place.cast("int") - 1), F.floor(num(index)).cast("int") - 1), table.base)


@register("HLOOKUP")
def _hlookup(key: E, table: E, index: E, near: E | None = None):
    cells = as_grid(table).col
    place = _where(key, F.get(cells, 0), table.base)
    return E(F.get(F.get(cells, F.floor(num(index)).cast("int") - 1), place.cast("int") - 1), table.base)


@register("XLOOKUP")
def _xlookup(key: E, look: E, give: E, other: E | None = None, mode: E | None = None):
    place = _where(key, flat(look), look.base)
    if mode is not None:
        place = F.when(num(mode) == -1, _approximate(key, flat(look), look.base)).otherwise(place)
    found = E(F.get(flat(give), place.cast("int") - 1), give.base)
    if other is None:
        return found
    found, other = _same_kind(found, other)
    return _like(found, F.when(place.isNull(), other.col).otherwise(found.col))


@register("LOOKUP")
def _lookup(key: E, look: E, give: E | None = None):
    give = give or look
    return E(F.get(flat(give), _approximate(key, flat(look), look.base).cast("int") - 1), give.base)


__all__ = ["values"]
