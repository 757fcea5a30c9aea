"""Spreadsheet criteria compiled to predicates that reach the scan.

">=10", "<>x", "b*", 5: an operator and a value. A value that reads as a number compares as one on a
numeric column, so the filter is pushed down; text compares without case, * and ? are wild and ~
quotes them. An empty value after = means blank cells, after <> cells that are not blank.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = re.compile(r"(>=|<=|<>|>|<|=)?(.*)", re.S)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def like_pattern(text: str) -> str | None:
    """A SQL LIKE pattern of a criterion with wild cards, else None."""
    if not re.search(r"(?<!~)[*?]", text):
        return None
    out = re.sub(r"([%_\\])", r"\\\1", text)
    out = re.sub(r"(?<!~)\*", "%", out)
    return re.sub(r"~([*?~])", r"\1", re.sub(r"(?<!~)\?", "_", out))


def criterion(df: DataFrame, column: str, crit) -> Column:
    """The predicate of one criterion on one column of df; a null cell meets none but blank ones."""
    t, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(crit, bool):
        return F.coalesce(c == F.lit(crit), F.lit(False))
    op, text = _OPS.fullmatch(crit if isinstance(crit, str) else repr(crit)).groups()
    op = op or "="
    if text == "":
        blank = c.isNull() if not isinstance(t, T.StringType) else c.isNull() | (c == "")
        return blank if op == "=" else ~blank if op == "<>" else F.lit(False)
    number = _number(text)
    if isinstance(t, T.NumericType):
        if number is None:
            return c.isNotNull() if op == "<>" else F.lit(False)
        value = F.lit(number)
    elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.lit(text).cast(t)
    elif isinstance(t, T.BooleanType):
        value = F.lit(text.upper() == "TRUE")
    else:
        pattern = like_pattern(text)
        if pattern is not None and op in ("=", "<>"):
            hit = F.upper(c).like(pattern.upper())
            return F.coalesce(hit, F.lit(False)) if op == "=" else ~F.coalesce(hit, F.lit(False))
        c, value = F.upper(c), F.lit(re.sub(r"~([*?~])", r"\1", text).upper())
    if op == "<>":
        return ~c.eqNullSafe(value)
    made = {">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "=": c == value}[op]
    return F.coalesce(made, F.lit(False)) if not isinstance(t, T.NumericType) else made


def criteria(df: DataFrame, wanted: dict) -> Column:
    """All criteria of {column: criterion or list of criteria}."""
    each = [criterion(df, c, x) for c, xs in wanted.items() for x in (xs if isinstance(xs, list) else [xs])]
    return reduce(lambda a, b: a & b, each, F.lit(True))
