"""Aggregates over a table's rows: conditional ones, subtotals, totals rows, pivots, histograms, modes.

All are Spark aggregates with map-side partials; groups are never collected, but by the exact order
statistics, which Spark's percentile keeps as counts of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.criteria import criteria


def sumifs(df: DataFrame, target: str, wanted: dict) -> Column:
    return F.coalesce(F.sum(F.when(criteria(df, wanted), F.col(target))), F.lit(0.0))


def countifs(df: DataFrame, wanted: dict) -> Column:
    return F.count_if(criteria(df, wanted))


def averageifs(df: DataFrame, target: str, wanted: dict) -> Column:
    return F.avg(F.when(criteria(df, wanted), F.col(target)))


def maxifs(df: DataFrame, target: str, wanted: dict) -> Column:
    return F.max(F.when(criteria(df, wanted), F.col(target)))


def minifs(df: DataFrame, target: str, wanted: dict) -> Column:
    return F.min(F.when(criteria(df, wanted), F.col(target)))


def product(c: Column) -> Column:
    """The product; null, as the spreadsheet's error, where no double holds it."""
    made = F.coalesce(F.product(c), F.lit(1.0))
    return F.when(F.abs(made) < float("inf"), made)


def log_product(c: Column) -> Column:
    """The logarithm of the product of positive numbers, also where no double holds the product; null where one is not positive."""
    return F.when(F.min(c) > 0, F.sum(F.log(c)))


def geomean(c: Column) -> Column:
    return F.when(F.min(c) > 0, F.exp(F.avg(F.log(c))))


def harmean(c: Column) -> Column:
    return F.when(F.min(c) > 0, F.count(c) / F.sum(1 / c))


def devsq(c: Column) -> Column:
    return F.var_pop(c) * F.count(c)


#: Spreadsheet names of plain aggregates.
AGGREGATES = {
    "SUM": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "AVERAGE": F.avg,
    "COUNT": F.count,
    "COUNTA": F.count,
    "COUNTBLANK": lambda c: F.count_if(c.isNull()),
    "MAX": F.max,
    "MIN": F.min,
    "PRODUCT": product,
    "STDEV.S": F.stddev_samp,
    "STDEV.P": F.stddev_pop,
    "VAR.S": F.var_samp,
    "VAR.P": F.var_pop,
    "MEDIAN": lambda c: F.percentile(c, 0.5),
    "GEOMEAN": geomean,
    "HARMEAN": harmean,
    "DEVSQ": devsq,
    "SUMSQ": lambda c: F.sum(c * c),
}

#: What SUBTOTAL's codes stand for; 101 to 111 are the same without hidden rows.
SUBTOTAL = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P"}


def subtotal(code: int, c: Column, hidden: Column | None = None) -> Column:
    if (code - 1) % 100 + 1 not in SUBTOTAL or code > 111:
        raise ValueError(f"SUBTOTAL has no code {code}")
    if code > 100 and hidden is not None:
        c = F.when(~F.coalesce(hidden, F.lit(False)), c)
    return AGGREGATES[SUBTOTAL[(code - 1) % 100 + 1]](c)


def totals_row(df: DataFrame, label: str, functions: dict[str, str]) -> DataFrame:
    """df and below it a row of totals: {column: aggregate}; the first other column holds the label.

    `_total` tells the rows apart (0 data, 1 totals).
    """
    free = next((c for c in df.columns if c not in functions), None)
    made = [AGGREGATES[functions[c]](F.col(c)).alias(c) if c in functions else F.lit(label if c == free else None).alias(c) for c in df.columns]
    return df.withColumn("_total", F.lit(0)).unionByName(df.agg(F.lit(1).alias("_total"), *made))


def pivot(df: DataFrame, rows: list[str], column: str, value: str, function: str = "SUM", values: list | None = None, grand: bool = True) -> DataFrame:
    """A pivot table with row and column grand totals.

    values: the wanted column keys; without them the distinct keys are read first, which Spark bounds
    by spark.sql.pivotMaxValues. Totals come from one rollup over partial aggregates, not a second scan:
    the row of grand totals has null row fields and `_total` 1; `total` is each row's own.
    """
    agg = AGGREGATES[function]
    if values is None:
        values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]  # the header of the result
    cells = [agg(F.when(F.col(column).eqNullSafe(F.lit(v)), F.col(value))).alias(str(v)) for v in values]
    total = agg(F.col(value)).alias("total")
    if not grand:
        return df.groupBy(*rows).agg(*cells)
    if not rows:
        return df.agg(*cells, total)
    sets = df.groupingSets([[F.col(r) for r in rows], []], *[F.col(r) for r in rows]).agg(F.grouping_id().alias("_g"), *cells, total)
    return sets.withColumn("_total", (F.col("_g") > 0).cast("int")).drop("_g")


def distinct_items(df: DataFrame, column: str, order: str) -> DataFrame:
    """A slicer's items: distinct values in the order they first come, blanks left out."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("item")).agg(F.min(order).alias("first"))
    return first


def frequency(df: DataFrame, column: str, bins: list[float]) -> DataFrame:
    """Counts of x <= bin above the bin before, and of those beyond the last (bin null)."""
    bins = sorted(bins)
    place = reduce(lambda made, k: F.when(F.col(column) <= bins[k], F.lit(k)).otherwise(made), reversed(range(len(bins))), F.lit(len(bins)))
    counted = df.where(F.col(column).isNotNull()).groupBy(place.alias("nr")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(k, float(b)) for k, b in enumerate(bins)] + [(len(bins), None)], "nr int, bin double")
    return every.join(counted, "nr", "left").select("nr", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def mode(df: DataFrame, column: str, by: list[str], order: Column, least: int = 1) -> DataFrame:
    """The most frequent value of each group; ties go to the first by `order` (an aggregate of the value's rows)."""
    tally = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"), order.alias("o"))
    best = tally.where(F.col("n") >= least).groupBy(*by).agg(F.max_by(F.struct(column, "n"), F.struct("n", (-F.col("o")).alias("o"))).alias("b"))
    return best.select(*by, F.col(f"b.{column}").alias("mode"), F.col("b.n").alias("n"))


def _ranked(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    from lattica.operators.lookup import placed_in_groups

    return placed_in_groups(df.where(F.col(column).isNotNull()).select(*by, column), by, column)


def upper_median(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The value at place n / 2 of each group in order: the upper of the two in the middle."""
    return _ranked(df, column, by).where(F.col("place") == F.floor(F.col("size") / 2) + 1).select(*by, F.col(column).alias("upper_median"))


def trim_mean(df: DataFrame, column: str, by: list[str], share: float) -> DataFrame:
    cut = F.floor(F.col("size") * share / 2)
    return _ranked(df, column, by).where((F.col("place") > cut) & (F.col("place") <= F.col("size") - cut)).groupBy(*by).agg(F.avg(column).alias("trim_mean"))


def quantiles(df: DataFrame, column: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """PERCENTILE, QUARTILE and MEDIAN of each group: {new column: share}, linear between the two ranks beside.

    The ranks are counted over range partitions, so no group's values gather in one buffer.
    """
    ranked = _ranked(df, column, by)
    made = []
    for name, share in wanted.items():
        at = (F.col("size") - 1) * F.lit(float(share)) + 1
        low = F.max(F.when(F.col("place") == F.floor(at), F.col(column)))
        high = F.max(F.when(F.col("place") == F.ceil(at), F.col(column)))
        made.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(*by).agg(*made)


def ave_dev(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Two passes of partial aggregates; the means join back by group."""
    means = df.groupBy(*by).agg(F.avg(column).alias("_m"))
    return df.join(means, by).groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("_m"))).alias("ave_dev"))


def top_census(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties in their own order."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(n)


def cut_bands(df: DataFrame, column: str, by: list[str], edges: tuple[float, float] = (0.34, 0.67)) -> DataFrame:
    """Adds `ratio`, the place between the group's extremes (0.5 where flat), and `band` 0, 1 or 2.

    The extremes are an aggregate that joins back, so no group's rows gather in one task.
    """
    ends = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")) if by else df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    ratio = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    banded = joined.withColumn("ratio", F.when(F.col(column).isNotNull(), ratio))
    return banded.withColumn("band", F.when(F.col("ratio") >= edges[1], 2).when(F.col("ratio") >= edges[0], 1).when(F.col("ratio").isNotNull(), 0)).drop("_lo", "_hi")
