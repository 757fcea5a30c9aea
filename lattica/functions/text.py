"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import BOOL, GRID, NUM, STR, E, boolean, default, flat, num, register, shown, txt, values
from lattica.functions.core import _txt as to_text


def _joined(array: Column, by: Column | str = "") -> Column:
    return F.array_join(F.transform(array, lambda x: F.coalesce(x, F.lit(""))), by) if isinstance(by, str) else F.call_function("array_join", F.transform(array, lambda x: F.coalesce(x, F.lit(""))), by)


register("CONCAT CONCATENATE", "S", STR)(lambda xs: _joined(xs))
register("LEN", "s")(lambda s: F.length(s).cast("double"))
register("UPPER", "s", STR)(F.upper)
register("LOWER", "s", STR)(F.lower)
register("TRIM", "s", STR)(lambda s: F.regexp_replace(F.btrim(s, F.lit(" \t\n\r")), " {2,}", " "))
register("PROPER", "s", STR)(F.initcap)
register("LEFT", "s|i", STR)(lambda s, n: F.left(s, default(n, 1)))
register("RIGHT", "s|i", STR)(lambda s, n: F.right(s, default(n, 1)))
register("MID", "sii", STR)(lambda s, a, n: F.call_function("substring", s, F.greatest(a, F.lit(1)), n))
register("EXACT", "ss", BOOL)(lambda a, b: a == b)
register("REPT", "si", STR)(lambda s, n: F.call_function("repeat", s, n))
register("CLEAN", "s", STR)(lambda s: F.regexp_replace(s, r"\p{Cntrl}", ""))
register("REPLACE", "siis", STR)(lambda s, a, n, new: F.concat(F.call_function("substring", s, F.lit(1), a - 1), new, F.call_function("substring", s, a + n, F.length(s))))
register("UNICODE CODE", "s")(lambda s: F.when(s != "", F.ascii(s).cast("double")))
#: A code point as text, by its UTF-32 bytes.
register("UNICHAR CHAR", "i", STR)(lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def _find(needle, s, start):
    at = F.call_function("locate", needle, s, F.lit(1) if start is None else start)
    return F.when(at > 0, at.cast("double"))


register("FIND", "ss|i")(_find)


@register("SEARCH", "ss|i")
def _search(needle, s, start):
    """Without case; ? and * are wild, ~ quotes them."""
    pattern = F.regexp_replace(F.lower(needle), r"([.\\+\[\]^$(){}|])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(pattern, r"(?<!~)\*", ".*?"), r"(?<!~)\?", ".")
    pattern = F.regexp_replace(pattern, r"~([*?])", r"\\$1")
    begin = F.lit(1) if start is None else start
    rest = F.lower(F.call_function("substring", s, begin, F.length(s)))
    before = F.call_function("regexp_replace", rest, F.concat(F.lit("(?s)^(.*?)(?:"), pattern, F.lit(").*$")), F.lit("$1"))
    return F.when(F.call_function("regexp_like", rest, F.concat(F.lit("(?s)"), pattern)), (F.length(before) + begin).cast("double"))


@register("SUBSTITUTE", "sss|i", STR)
def _substitute(s, old, new, which):
    if which is None:
        return F.when(old == "", s).otherwise(F.call_function("replace", s, old, new))
    head = F.call_function("substring_index", s, old, which)
    tail = F.call_function("substring", s, F.length(head) + F.length(old) + 1, F.length(s))
    return F.when((old == "") | (F.length(head) >= F.length(s)), s).otherwise(F.concat(head, new, tail))


@register("TEXTJOIN", None, STR)
def _textjoin(by: E, skip: E, *args: E):
    array = values(list(args))
    kept = F.filter(array, lambda x: ~boolean(skip) | (F.coalesce(x, F.lit("")) != ""))
    return _joined(kept, txt(by))


register("TEXTBEFORE", "ss", STR)(lambda s, by: F.when(by == "", "").otherwise(F.call_function("substring_index", s, by, F.lit(1))))


@register("TEXTAFTER", "ss", STR)
def _textafter(s, by):
    at = F.call_function("locate", by, s)
    return F.when(at > 0, F.call_function("substring", s, at + F.length(by), F.length(s))).otherwise("")


@register("TEXTSPLIT", "ss")
def _textsplit(s, by):
    from lattica.functions.core import column_grid

    return column_grid(F.call_function("split", s, F.concat(F.lit(r"\Q"), by, F.lit(r"\E"))), STR)


register("VALUE", "s")(lambda s: F.btrim(F.translate(s, ",$", "")).try_cast("double"))


@register("NUMBERVALUE", "s|ss")
def _numbervalue(s, point, group):
    point = default(point, ".")
    kept = F.call_function("regexp_replace", s, F.concat(F.lit(r"[^0-9\-\Q"), point, F.lit(r"\E]")), F.lit(""))
    return F.call_function("replace", kept, point, F.lit(".")).try_cast("double")


def fixed(x: Column, d) -> Column:
    """Fixed decimals, halves away from zero on the binary product."""
    d = F.lit(2) if d is None else d
    made = F.signum(x) * F.floor(F.abs(x) * F.pow(F.lit(10.0), d) + 0.5) / F.pow(F.lit(10.0), d)
    return F.call_function("format_number", made, d)


register("DOLLAR", "n|i", STR)(lambda x, d: F.concat(F.lit("$"), F.translate(fixed(x, d), ",", "")))
register("FIXED", "n|ib", STR)(lambda x, d, bare: fixed(x, d) if bare is None else F.when(bare, F.translate(fixed(x, d), ",", "")).otherwise(fixed(x, d)))


@register("TEXT", None, STR)
def _text(value: E, pattern: E):
    """Percent, fixed decimals and thousands groups."""
    x, p = num(value), txt(pattern)
    percent = p.contains("%")
    x = F.when(percent, x * 100).otherwise(x)
    decimals = F.length(F.regexp_extract(p, r"\.([0#]+)", 1))
    made = fixed(x, decimals)
    made = F.when(p.contains(","), made).otherwise(F.translate(made, ",", ""))
    return F.when(p.rlike("[0#]"), F.concat(made, F.when(percent, "%").otherwise(""))).otherwise(txt(value))


register("VALUETOTEXT FORMULATOTEXT", "s|n", STR)(lambda s, how: s)
register("T", None, STR)(lambda e: txt(e) if e.base == STR else F.lit(""))

__all__ = ["GRID", "NUM", "flat", "shown", "to_text"]
