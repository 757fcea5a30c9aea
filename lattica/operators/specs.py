"""Declarative specifications, executed: conditional formats, data validations, charts, sparklines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {
    "equal": lambda c, a: c == a,
    "notEqual": lambda c, a: c != a,
    "greaterThan": lambda c, a: c > a,
    "lessThan": lambda c, a: c < a,
    "greaterThanOrEqual": lambda c, a: c >= a,
    "lessThanOrEqual": lambda c, a: c <= a,
}


def cell_is(c: Column, operator: str, first, second=None) -> Column:
    if operator in ("between", "notBetween"):
        inside = c.between(min(first, second), max(first, second))
        return inside if operator == "between" else ~inside
    return _COMPARE[operator](c, F.lit(first))


def text_rule(c: Column, rule: str, text: str) -> Column:
    low, needle = F.lower(c.cast("string")), text.lower()
    hit = {"containsText": low.contains, "notContainsText": low.contains, "beginsWith": low.startswith, "endsWith": low.endswith}[rule](needle)
    return ~F.coalesce(hit, F.lit(False)) if rule.startswith("not") else F.coalesce(hit, F.lit(False))


#: A sort of so many rows is one task's work at any size of the table.
SHORT = 10_000


def top_rule(df: DataFrame, column: str, order: str, n: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Adds `hit`: among the n (or n percent) largest or smallest; equal values share their rank.

    The edge is one exact order statistic: by a bounded sort for a fixed n of at most SHORT, and else by places
    that are counted over range partitions, so no task sorts the table.
    """
    from lattica.operators.lookup import with_places

    values = df.where(F.col(column).isNotNull()).select(column)
    if percent or n > SHORT:
        total = values.count()
        n = max(1, total * n // 100) if percent else n
        place = n if bottom else total - n + 1
        edge = with_places(values, column).where(F.col("place") == min(max(1, place), max(1, total))).agg(F.max(column).alias("_edge"))
    else:
        edge = values.orderBy(F.asc(column) if bottom else F.desc(column)).limit(n).agg((F.max if bottom else F.min)(column).alias("_edge"))
    hit = F.col(column) <= F.col("_edge") if bottom else F.col(column) >= F.col("_edge")
    return df.crossJoin(F.broadcast(edge)).withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_edge")  # one row


def multiplicity(df: DataFrame, column: str, duplicate: bool = True) -> DataFrame:
    """Adds `hit`: the value occurs more than once (or, not duplicate, just once)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    joined = df.join(counted, F.col(column) == F.col("_v"), "left")
    return joined.withColumn("hit", F.coalesce(F.col("_n") > 1 if duplicate else F.col("_n") == 1, F.lit(False))).drop("_v", "_n")


def about_average(df: DataFrame, column: str, above: bool = True, equal: bool = False, deviations: float = 0.0) -> DataFrame:
    """Adds `hit`: beyond the mean, or the mean and so many standard deviations."""
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    edge = F.col("_m") + (1 if above else -1) * deviations * F.col("_s")
    c = F.col(column)
    hit = (c >= edge if equal else c > edge) if above else (c <= edge if equal else c < edge)
    return df.crossJoin(F.broadcast(stats)).withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_m", "_s")  # one row


def time_period(c: Column, period: str, today: Column) -> Column:
    """today is a parameter, so that a query gives the same result on any day."""
    d = c.cast("date")
    week = lambda x: F.date_trunc("week", x.cast("timestamp_ntz"))
    month = lambda x: F.trunc(x, "month")
    return {
        "today": d == today,
        "yesterday": d == F.date_sub(today, 1),
        "tomorrow": d == F.date_add(today, 1),
        "last7Days": d.between(F.date_sub(today, 6), today),
        "thisWeek": week(d) == week(today),
        "lastWeek": week(d) == week(F.date_sub(today, 7)),
        "nextWeek": week(d) == week(F.date_add(today, 7)),
        "thisMonth": month(d) == month(today),
        "lastMonth": month(d) == month(F.add_months(today, -1)),
        "nextMonth": month(d) == month(F.add_months(today, 1)),
    }[period]


def blanks(c: Column, wanted: bool = True) -> Column:
    blank = c.isNull() | (F.btrim(c.cast("string")) == "")
    return blank if wanted else ~blank


def violations(df: DataFrame, column: str, kind: str, operator: str = "between", first=None, second=None, values: list | None = None, allow_blank: bool = True) -> DataFrame:
    """Rows that break a data validation of type whole, decimal, list, date, textLength."""
    c = F.col(column)
    if kind == "list":
        good = c.cast("string").isin(*map(str, values))
    else:
        x = F.length(c.cast("string")) if kind == "textLength" else c.cast("date") if kind == "date" else c.cast("double")
        good = cell_is(x, operator, F.lit(first).cast("date") if kind == "date" else first, F.lit(second).cast("date") if kind == "date" else second) if kind != "date" else _dates(x, operator, first, second)
        if kind == "whole":
            good = good & (x == F.floor(x))
    good = F.coalesce(good, F.lit(False))
    return df.where(~(good | blanks(c)) if allow_blank else ~good)


def _dates(x: Column, operator: str, first, second) -> Column:
    a, b = F.lit(first).cast("date"), F.lit(second).cast("date")
    if operator in ("between", "notBetween"):
        inside = x.between(a, b)
        return inside if operator == "between" else ~inside
    return _COMPARE[operator](x, a)


def sparkline(df: DataFrame, by: list[str], order: str, value: str, most: int) -> DataFrame:
    """The last `most` values of each group in order, as an array; a window keeps only those rows."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    last = df.select(*by, order, value, F.row_number().over(w).alias("_r")).where(F.col("_r") <= most)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return last.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias("points"))


def chart_series(df: DataFrame, label: str, order: str, columns: list[str]) -> DataFrame:
    """(series, nr, label, value) of a wide table; a missing value is 0."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in columns]))
    return df.select(F.col(order).alias("nr"), F.col(label).alias("label"), cells.alias("c")).select("c.series", "nr", "label", "c.value")
