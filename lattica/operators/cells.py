"""Sheets as cells: wide tables to (sheet, row, col) cells and back, A1 names, ranges, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.parser import parse_ref

CELLS = "sheet string, row int, col int, kind string, num double, str string, bool boolean, formula string"


def letters(col: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column number from 1, with as many letters as it takes."""
    n, before, parts = col.cast("long"), 0, []
    for k in range(14):  # what a long needs; `before` columns have fewer letters than k + 1
        digit = F.call_function("div", n - 1 - before, F.lit(26**k).cast("long")) % 26
        letter = F.call_function("char", (65 + digit).cast("int"))
        parts.insert(0, F.when(n > before, letter).otherwise("") if k else letter)
        before += 26 ** (k + 1)
    return F.concat(*parts)


def column_number(name: Column) -> Column:
    return F.aggregate(F.split(F.upper(name), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def a1(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def split_a1(ref: Column) -> tuple[Column, Column]:
    """(row, col) of an A1 name, $ allowed."""
    plain = F.translate(ref, "$", "")
    return F.regexp_extract(plain, r"([0-9]+)$", 1).cast("int"), column_number(F.regexp_extract(plain, r"^([A-Za-z]+)", 1))


def typed(text: Column) -> list[Column]:
    """kind, num, str, bool of a text cell: a number, true or false, else text; blank stays empty text."""
    trimmed = F.btrim(text)
    number = F.when(trimmed.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))
    logical = F.when(F.lower(trimmed) == "true", True).when(F.lower(trimmed) == "false", False)
    kind = F.when(text.isNull(), "empty").when(number.isNotNull(), "number").when(logical.isNotNull(), "bool").otherwise("string")
    return [kind.alias("kind"), number.alias("num"), F.when(kind == "string", text).alias("str"), logical.alias("bool")]


def to_cells(df: DataFrame, sheet: str, row: str, header: bool = True) -> DataFrame:
    """CELLS of a table whose integer column `row` numbers it from 1; with a header the data starts in row 2."""
    data = [c for c in df.columns if c != row]
    parts = []
    for k, c in enumerate(data, 1):
        t = df.schema[c].dataType
        col = F.col(f"`{c}`")
        number, logical = isinstance(t, T.NumericType), isinstance(t, T.BooleanType)
        kind = F.when(col.isNull(), "empty").otherwise("number" if number else "bool" if logical else "string")
        parts.append(F.struct(F.lit(k).alias("col"), kind.alias("kind"), (col.cast("double") if number else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if number or logical else col.cast("string")).alias("str"), (col if logical else F.lit(None).cast("boolean")).alias("bool")))
    body = df.select((F.col(row) + int(header)).cast("int").alias("row"), F.explode(F.array(*parts)).alias("c"))
    body = body.where(F.col("c.kind") != "empty").select(F.lit(sheet).alias("sheet"), "row", "c.*", F.lit(None).cast("string").alias("formula"))
    if not header:
        return body
    names = df.sparkSession.createDataFrame([(sheet, 1, k, "string", None, c, None, None) for k, c in enumerate(data, 1)], CELLS)
    return names.unionByName(body)


def shown(num="num", str_="str", bool_="bool") -> Column:
    """A cell's display text."""
    n = F.col(num)
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.coalesce(F.col(str_), F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string")), F.upper(F.col(bool_).cast("string")))


def used_range(cells: DataFrame) -> DataFrame:
    """The bounding box of each sheet's non-empty cells."""
    held = cells.where(F.col("kind") != "empty")
    return held.groupBy("sheet").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))


def from_cells(cells: DataFrame, sheet: str, columns: int | None = None) -> DataFrame:
    """The table in a sheet's used range: its first row names the columns (blank: ColumnN), the rest is data.

    Column types widen to what all cells are: number, boolean, or else text. `_row` is the sheet's row.
    """
    mine = cells.where((F.lower(F.col("sheet")) == sheet.lower()) & (F.col("kind") != "empty"))
    box = used_range(mine).first()
    if box is None:
        return cells.sparkSession.createDataFrame([], "_row int")
    head = {r["col"]: r["t"] for r in mine.where(F.col("row") == box["r1"]).select("col", shown().alias("t")).collect()}  # one row
    kinds: dict[int, set] = {}
    for r in mine.where(F.col("row") > box["r1"]).groupBy("col", "kind").count().collect():  # a few for each column
        kinds.setdefault(r["col"], set()).add(r["kind"])
    made, seen = [], {}
    for c in range(box["c1"], box["c2"] + 1):
        name = head.get(c) or f"Column{c - box['c1'] + 1}"
        seen[name] = seen.get(name, 0) + 1
        name += f"_{seen[name]}" if seen[name] > 1 else ""
        value = F.col("num") if kinds.get(c) == {"number"} else F.col("bool") if kinds.get(c) == {"bool"} else shown()
        made.append(F.max(F.when(F.col("col") == c, value)).alias(name))
    return mine.where(F.col("row") > box["r1"]).groupBy(F.col("row").alias("_row")).agg(*made)


def window(cells: DataFrame, span: str, sheet: str | None = None) -> DataFrame:
    """Cells of a range such as B2:D9."""
    first, _, last = span.partition(":")
    a, b = parse_ref(first), parse_ref(last or first)
    inside = F.col("row").between(min(a.row, b.row), max(a.row, b.row)) & F.col("col").between(min(a.col, b.col), max(a.col, b.col))
    return cells.where(inside if sheet is None else inside & (F.lower("sheet") == sheet.lower()))


def sheet_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg(F.count_distinct("row").alias("rows"), F.count("*").alias("cells"))


def empty_sheets(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    return sheets.join(cells.where(F.col("kind") != "empty"), "sheet", "left_anti")


def contains(cells: DataFrame, needle: str) -> DataFrame:
    """Cells whose text (or, without a value, formula) holds the needle, case counts; an empty one finds nothing."""
    return cells.where(F.coalesce(shown(), F.col("formula")).contains(needle) & F.lit(needle != ""))


def header_rows(cells: DataFrame, styled: str, most: int = 5) -> DataFrame:
    """The first row up to `most` of each sheet of whose cells at least half are styled."""
    share = cells.where(F.col("row") <= most).groupBy("sheet", "row").agg(F.count_if(styled).alias("s"), F.count("*").alias("n"))
    return share.where(F.col("s") * 2 >= F.col("n")).groupBy("sheet").agg(F.min("row").alias("header_row"))


def value_mode(mode: str) -> Column:
    """What a view shows of a cell: its formula, its cached value, or both; a missing cache is said."""
    formula = F.concat(F.lit("="), F.regexp_replace("formula", "^=", ""))
    cached = F.coalesce(shown(), F.when(F.col("formula").isNotNull(), F.lit("(not calculated)")))
    return {"formula": F.coalesce(formula, shown()), "cached": cached, "both": F.when(F.col("formula").isNotNull(), F.concat(formula, F.lit(" -> "), cached)).otherwise(cached)}[mode]
