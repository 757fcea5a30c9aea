"""Ranks, running folds, lags, sessions and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, column: str, by: list[str], descending: bool = True) -> DataFrame:
    """Adds rank_eq, rank_avg and percent_rank of a column within its group; a null ranks last when descending, else first.

    Places are counted over range partitions; ties are an aggregate by value that joins back.
    """
    from lattica.operators.lookup import placed_in_groups

    keys = [F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    values = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_ties"))
    placed = placed_in_groups(df.select(*keys, F.col(column).alias("_v")), names, "_v")
    first = placed.groupBy(*names, "_v").agg(F.min("place").alias("_below"), F.max("size").alias("_size"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    first = first.select(*[F.col(n).alias(f"{n}f") for n in names], F.col("_v").alias("_vf"), "_below", "_size")
    on = same("_v", "_vf")
    for n in names:
        on = on & same(n, f"{n}f")
    known = values.join(first, on).select(*names, "_v", "_ties", "_below", "_size")
    on = same(column, "_v")
    for b, n in zip(by, names, strict=True):
        on = on & same(b, n)
    joined = df.join(known, on)
    eq = (F.col("_size") - F.col("_below") - F.col("_ties") + 2 if descending else F.col("_below")).cast("int")
    up = F.when(F.col("_size") > 1, (F.col("_below") - 1) / (F.col("_size") - 1)).otherwise(0.0)
    return joined.select(*df.columns, eq.alias("rank_eq"), (eq + (F.col("_ties") - 1) / 2).alias("rank_avg"), up.alias("percent_rank"))


def kth(df: DataFrame, column: str, by: list[str], k: int, largest: bool = True) -> DataFrame:
    """LARGE / SMALL of each group: Spark keeps only the first k rows of each window."""
    w = Window.partitionBy(*by).orderBy(F.desc(column) if largest else F.asc(column))
    ranked = df.where(F.col(column).isNotNull()).select(*by, column, F.row_number().over(w).alias("_r")).where(F.col("_r") <= k)
    return ranked.where(F.col("_r") == k).select(*by, F.col(column).alias("value"))


def running(df: DataFrame, by: list[str], order: list[str], **folds: Column) -> DataFrame:
    """SCAN: each fold is an aggregate over the rows of the group so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[f.over(w).alias(name) for name, f in folds.items()])


def level_jumps(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """Rows whose level is more than one deeper than the row before (the first row starts from level 0)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(level, 1, 0).over(w)
    return df.withColumn("previous", before).where(F.col(level) > F.col("previous") + 1)


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of a group; `breaks` (an expression over `w`'s lag columns) starts a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_break", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_break")


def previous(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def sessions(df: DataFrame, by: list[str], ts: str, gap_seconds: int, order: list[str] | None = None) -> DataFrame:
    """Adds `session`: a new one after more than gap_seconds without a row."""
    order = order or [ts]
    gap = F.timestamp_diff("SECOND", previous(ts, by, order), F.col(ts))
    return islands(df, by, order, F.coalesce(gap > gap_seconds, F.lit(True)), "session")


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
