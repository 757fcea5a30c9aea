"""Lookups between tables as joins: first match, default, as-of, bins, membership, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_matches(table: DataFrame, key: str, order: str, give: list[str]) -> DataFrame:
    """One row a key, the first by order: a max_by with partials, not a window over each key's rows."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*give), F.col(order)).alias("_got"), F.min(order).alias("_place"))


def vlookup(df: DataFrame, on: str, table: DataFrame, key: str, give: dict[str, str], order: str, default: dict | None = None, exact_case: bool = True) -> DataFrame:
    """Adds {new column: table's column} of the first row whose key equals; a miss gives the default or null.

    Spark broadcasts the table's side where its measured size allows, and else shuffles both by key.
    """
    k = (lambda c: c) if exact_case else F.upper
    found = first_matches(table.withColumn("_k", k(F.col(key))), "_k", order, list(dict.fromkeys(give.values())))
    joined = df.join(found, k(df[on]) == found["_key"], "left")
    default = default or {}
    made = [F.when(F.col("_key").isNull(), F.lit(default.get(new))).otherwise(F.col(f"_got.{old}")).alias(new) if new in default else F.col(f"_got.{old}").alias(new) for new, old in give.items()]
    return joined.select(*[df[c] for c in df.columns], *made)


def match_position(df: DataFrame, on: str, table: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `position`, the 1-based place in the table's order of the first row whose key equals.

    Places are counted by ranges of the order, so no single task numbers the table.
    """
    placed = with_places(table.select(key, order), order)
    found = placed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("position"))
    return df.join(found, df[on] == found["_key"], "left").drop("_key")


def with_places(table: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Adds `place`, 1, 2, ... by order, without one global window.

    Rows are range-partitioned, numbered within their part, and moved by the counts of the parts
    before (one number a part). The parts are written down first, so that both passes see the same.
    """
    from lattica.plans.materialise import Table

    spark = table.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Table(table.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "places").df
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())  # a number for each part
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    moved = spark.createDataFrame([(p, b) for p, b in before.items()], "_part int, _before long")
    numbered = ranged.withColumn("_nr", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(F.broadcast(moved), "_part").withColumn("place", F.col("_nr") + F.col("_before")).drop("_part", "_nr", "_before")


def placed_in_groups(table: DataFrame, by: list[str], order: str, parts: int | None = None) -> DataFrame:
    """Adds `place`, 1, 2, ... by order within each group, and `size`, the group's rows. A group may span many tasks.

    Rows are range-partitioned by group and order and numbered within their part; a row for each group and part
    (as many as there are groups, and one more a part) says how many of the group stand in the parts before.
    """
    from lattica.plans.materialise import Table

    parts = parts or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = Table(table.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()), "places").df
    keys = [F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]
    names = [f"_g{k}" for k in range(len(by))]
    counted = ranged.groupBy(*keys, F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.select(*names, "_p", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*names)).alias("size"))
    numbered = ranged.withColumn("_nr", F.row_number().over(Window.partitionBy("_part", *by).orderBy(order)))
    same = F.col("_part") == F.col("_p")
    for b, n in zip(by, names, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(n))
    joined = numbered.join(counted, same).withColumn("place", F.col("_nr") + F.col("_before"))
    return joined.drop("_part", "_p", "_nr", "_before", *names)


def asof(df: DataFrame, at: str, table: DataFrame, key: str, give: list[str], by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """For each row the table's row with the greatest key <= at (in its group `by`); of equal keys the first by order.

    Both tables are range-partitioned together by group and key, and each part is scanned once; what a part's
    first group had found by then is carried over from the parts before, of which there is one row each. So neither
    a table without groups nor a group that holds most rows is one task's work.
    """
    from lattica.plans.materialise import Table

    by = by or []
    order = order or key
    groups = [f"_b{k}" for k in range(len(by))]
    left = df.select(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"))
    firsts = table.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min_by(F.struct(*give), F.col(order)).alias("_got"))
    right = firsts.select(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], F.col(key).alias("_at"), F.lit(0).alias("_side"), "_got")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right, allowMissingColumns=True).repartitionByRange(parts, *groups, "_at", "_side")
    both = Table(both.withColumn("_part", F.spark_partition_id()), "asof").df
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("_b"))
    there = F.col("_got").isNotNull()
    latest = F.max_by(F.when(there, F.struct(group.alias("group"), F.col("_got").alias("got"))), F.when(there, F.struct(group, F.col("_at"))))
    ends = both.groupBy("_part").agg(F.min(group).alias("_first"), latest.alias("_latest"))  # a row for each part
    before = F.last("_latest", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_before", before).where(F.col("_before.group").eqNullSafe(F.col("_first"))).select("_part", "_first", F.col("_before.got").alias("_carried"))
    w = Window.partitionBy("_part", *groups).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_got", ignorenulls=True).over(w)).where(F.col("_side") == 1).join(F.broadcast(carried), "_part", "left")
    hit = F.coalesce(F.col("_hit"), F.when(group.eqNullSafe(F.col("_first")), F.col("_carried")))
    found = found.withColumn("_hit", F.when(F.col("_at").isNotNull(), hit))
    return found.select("_row.*", *[F.col(f"_hit.{g}").alias(f"{g}_asof") for g in give])


def bin_of(df: DataFrame, value: str, bins: DataFrame, low: str, high: str, give: list[str]) -> DataFrame:
    """The bin [low, high) of each value, for bins that do not overlap: an as-of join on the lower bounds."""
    found = asof(df, value, bins, low, [high, *give])
    inside = F.col(value) < F.col(f"{high}_asof")
    return found.select(*df.columns, *[F.when(inside, F.col(f"{g}_asof")).alias(g) for g in give])


def members(df: DataFrame, on: str, table: DataFrame, key: str, wanted: bool = True) -> DataFrame:
    """Rows whose key is in the table (or, not wanted, is not)."""
    return df.join(table.select(F.col(key).alias("_k")).distinct(), F.col(on) == F.col("_k"), "left_semi" if wanted else "left_anti")


def missing_references(df: DataFrame, on: str, table: DataFrame, key: str, what: str) -> DataFrame:
    """(path, severity, message) for each distinct reference that the table lacks."""
    lost = members(df.where(F.col(on).isNotNull()).select(on).distinct(), on, table, key, wanted=False)
    return lost.select(F.concat(F.lit(f"/{what}["), F.col(on).cast("string"), F.lit("]")).alias("path"), F.lit("warning").alias("severity"), F.concat(F.lit(f"missing {what} "), F.col(on).cast("string")).alias("message"))


def inherit(chain: DataFrame, id: str, parent: str, fields: list[str], depth: int = 20) -> DataFrame:
    """Each node's fields, the nearest that is not null up its chain of parents, at most `depth` steps.

    Tables of 1, 2, 4, ... nodes are made by joining each with itself, and those in the binary form of
    depth + 1 are joined, so twenty steps take six joins and not one more is taken.
    """
    def onto(low: DataFrame, high: DataFrame) -> DataFrame:
        up = high.select(F.col("_id").alias("_p"), F.col("_up").alias("_upper"), *[F.col(f).alias(f"_{f}") for f in fields])
        joined = low.join(up, F.col("_up") == F.col("_p"), "left")
        return joined.select("_id", F.col("_upper").alias("_up"), *[F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) for f in fields])

    power, made, left = chain.select(F.col(id).alias("_id"), F.col(parent).alias("_up"), *fields), None, depth + 1
    while left:
        if left & 1:
            made = power if made is None else onto(made, power)
        left >>= 1
        if left:
            power = onto(power, power)
    return made.select(F.col("_id").alias(id), *fields)


def placeholder_inherit(slide: DataFrame, layout: DataFrame, master: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A slide's fields, or its layout's, or its master's."""
    named = lambda t, p: t.select(*keys, *[F.col(f).alias(f"{p}_{f}") for f in fields])
    joined = slide.join(named(layout, "l"), keys, "left").join(named(master, "m"), keys, "left")
    return joined.select(*[c for c in slide.columns if c not in fields], *[F.coalesce(F.col(f), F.col(f"l_{f}"), F.col(f"m_{f}")).alias(f) for f in fields])


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices given as (row, col, value)."""
    x = a.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("value").alias("y"))
    return x.join(y, "k").groupBy(F.col("i").alias("row"), F.col("j").alias("col")).agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def fill_template(df: DataFrame, template: str, data: str) -> tuple[Column, Column]:
    """(text, hits) of a template column whose {{a.b}} are looked up in a JSON column; unknown ones stay.

    Text comes as it is, null as nothing and other values as JSON. The pieces between placeholders and
    the placeholders alternate, so the row is split once and joined once.
    """
    t, d = F.col(template), F.col(data)
    marks = F.regexp_extract_all(t, F.lit(r"\{\{(.*?)\}\}"), F.lit(0))
    gaps = F.split(t, r"\{\{.*?\}\}", -1)

    def value(mark):
        key = F.btrim(F.regexp_extract(mark, r"^\{\{(.*?)\}\}$", 1))
        path = F.concat(F.lit("$['"), F.regexp_replace(key, r"\.", "']['"), F.lit("']"))
        parent = F.when(key.contains("."), F.call_function("get_json_object", d, F.regexp_replace(path, r"\['[^']*'\]$", ""))).otherwise(d)
        last = F.regexp_extract(key, r"([^.]*)$", 1)
        known = F.array_contains(F.call_function("json_object_keys", parent), last)
        return F.when(known, F.coalesce(F.call_function("get_json_object", d, path), F.lit("")))

    pairs = F.transform(marks, lambda m: F.struct(m.alias("mark"), value(m).alias("value")))
    filled = F.zip_with(gaps, pairs, lambda g, p: F.concat(g, F.coalesce(p["value"], p["mark"], F.lit(""))))
    return F.array_join(filled, ""), F.size(F.filter(pairs, lambda p: p["value"].isNotNull()))
