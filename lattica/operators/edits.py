"""Change logs: dump a table to steps, apply steps, replay them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = "idx long, op string, path string, props map<string,string>"


def dump(df: DataFrame, path: str, fields: list[str], order: str) -> DataFrame:
    """An `add` step a row, with its non-null fields."""
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f), F.col(f).cast("string")) for f in fields]), lambda e: e["col2"].isNotNull()))
    return df.select(F.col(order).cast("long").alias("idx"), F.lit("add").alias("op"), F.col(path).cast("string").alias("path"), pairs.alias("props"))


def apply_steps(state: DataFrame, path: str, fields: list[str], steps: DataFrame) -> DataFrame:
    """The table after all steps, in the order of idx: add makes a path (again: nothing), set writes its
    properties, remove takes it away, and a later add begins anew.

    A path's steps are folded where they meet, field by field, as the last write after the last
    remove; only the log is shuffled by path, the state joins it.
    """
    removed = steps.where("op = 'remove'").groupBy(F.col("path").alias("_p")).agg(F.max("idx").alias("_gone"))
    live = steps.join(removed, F.col("path") == F.col("_p"), "left").where("_gone is null or idx > _gone").drop("_p")
    writes = live.groupBy("path").agg(F.bool_or(F.col("op") == "add").alias("_added"), *[F.max_by(F.col("props")[f], F.when(F.array_contains(F.map_keys("props"), f), F.col("idx"))).alias(f"_{f}") for f in fields])
    known = state.select(F.col(path).cast("string").alias("_path"), *[F.col(f).cast("string").alias(f) for f in fields])
    joined = known.join(removed, F.col("_path") == F.col("_p"), "full").join(writes, F.coalesce("_path", "_p") == F.col("path"), "full")
    old = F.col("_path").isNotNull() & F.col("_gone").isNull()
    kept = joined.where(old | F.coalesce("_added", F.lit(False)))
    return kept.select(F.coalesce("path", "_path").alias(path), *[F.coalesce(F.col(f"_{f}"), F.when(F.col("_gone").isNull(), F.col(f))).alias(f) for f in fields])


def replay_report(state: DataFrame, path: str, steps: DataFrame, force: bool = False) -> DataFrame:
    """(idx, op, path, ok, message): set and remove need a path that is there then; without force all after the first failure is skipped."""
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    there = state.select(F.col(path).cast("string").alias("_k"), F.lit(True).alias("_there")).distinct()
    made = F.last(F.when(F.col("op") == "add", True).when(F.col("op") == "remove", False), ignorenulls=True).over(before)
    tried = steps.join(there, F.col("path") == F.col("_k"), "left").withColumn("exists", F.coalesce(made, F.col("_there"), F.lit(False)))
    known = F.col("op").isin("add", "set", "remove")
    tried = tried.withColumn("ok", known & ((F.col("op") == "add") | F.col("exists")))
    message = F.when(~known, F.concat(F.lit("unknown op "), "op")).when(~F.col("ok"), F.concat(F.lit("no such path "), "path"))
    if force:
        return tried.select("idx", "op", "path", "ok", message.alias("message"))
    first = tried.where("not ok").agg(F.min("idx").alias("_first"))
    joined = tried.crossJoin(F.broadcast(first))  # one row
    skipped = F.coalesce(F.col("idx") > F.col("_first"), F.lit(False))
    return joined.select("idx", "op", "path", (F.col("ok") & ~skipped).alias("ok"), F.when(skipped, "skipped").otherwise(message).alias("message"))
