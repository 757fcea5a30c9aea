"""Filters, sorts, limits, set operations and stacks of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.criteria import criterion
from lattica.operators.lookup import with_places


def auto_filter(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """{column: {"values": [...]} or {"criteria": [c1, c2], "both": bool}}; columns are AND-ed."""
    made: list[Column] = []
    for name, spec in columns.items():
        if "values" in spec:
            shown = F.col(name).cast("string") if not isinstance(spec["values"][0], (int, float)) else F.col(name)
            made.append(shown.isin(*spec["values"]))
        else:
            each = [criterion(df, name, c) for c in spec["criteria"]]
            made.append(reduce((lambda a, b: a & b) if spec.get("both", True) else (lambda a, b: a | b), each))
    return df.where(reduce(lambda a, b: a & b, made, F.lit(True)))


def sort_state(df: DataFrame, conditions: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Sorts by (column, descending) conditions, blanks last, ties by row order."""
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in conditions]
    return df.orderBy(*order, tie)


#: So many rows are taken by a bounded sort; more by places that are counted over range partitions.
SHORT = 10_000


def take(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order, the last where n < 0."""
    if abs(n) <= SHORT:
        return df.orderBy(F.asc(order) if n >= 0 else F.desc(order)).limit(abs(n))
    placed = with_places(df, order)
    return placed.where(F.col("place") <= n if n >= 0 else F.col("place") > df.count() + n).drop("place")


def drop(df: DataFrame, order: str, n: int) -> DataFrame:
    """All but the first n rows by order (the last where n < 0)."""
    placed = with_places(df, order)
    return placed.where(F.col("place") > n if n >= 0 else F.col("place") <= df.count() + n).drop("place")


def unique(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Distinct rows by text without case, the first of each, with its place."""
    keys = [F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r"), F.min(order).alias(order)).select("_r.*", order)


def vstack(*frames: DataFrame) -> DataFrame:
    """Tables below each other by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hstack(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Tables beside each other by place; the shorter is padded with nulls."""
    a, b = with_places(left, order_left), with_places(right, order_right).withColumnRenamed("place", "_place")
    joined = a.join(b, F.col("place") == F.col("_place"), "full")
    return joined.withColumn("place", F.coalesce("place", "_place")).drop("_place")


def choose_rows(df: DataFrame, order: str, places: list[int]) -> DataFrame:
    """Rows by 1-based place, negative from the end; `nr` is the wanted order, those outside are left out."""
    placed = with_places(df, order)
    n = placed.agg(F.max("place")).first()[0] or 0
    wanted = [(k, p if p > 0 else n + p + 1) for k, p in enumerate(places, 1)]
    return placed.join(F.broadcast(df.sparkSession.createDataFrame(wanted, "nr int, place long")), "place")


def page_spec(text: str) -> Column:
    """The predicate of "1,3,5-8" on a column `page`."""
    made = F.lit(False)
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        if not low.isdigit() or (high and not high.isdigit()) or (high and int(high) < int(low)):
            raise ValueError(f"not a page range: {part!r}")
        made = made | F.col("page").between(int(low), int(high or low))
    return made
