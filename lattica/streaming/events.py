"""Event-time windows, sessions, deduplication and running state over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, size: str, by: list[str], value: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than `late` are dropped from a stream."""
    held = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide or size)
    made = held.groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def session_windows(events: DataFrame, ts: str, gap: str, by: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    held = events.withWatermark(ts, late) if events.isStreaming else events
    made = held.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "total")


def deduplicated(events: DataFrame, id: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each id once; a stream remembers ids as long as `late`."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(id) if events.isStreaming else events.dropDuplicates(id)


def running_state(events: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The running count and total of each key, as custom state: (key, order, n, total) a row.

    A batch of a key's rows is folded in order onto the key's state.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    out = f"{by} long, {order} timestamp, n long, total double"

    def fold(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            frame = frame.sort_values(order, kind="stable")
            count = n + pd.Series(range(1, len(frame) + 1))
            running = total + frame[value].fillna(0.0).cumsum().reset_index(drop=True)
            n, total = int(count.iloc[-1]), float(running.iloc[-1])
            yield pd.DataFrame({by: key[0], order: frame[order].reset_index(drop=True), "n": count, "total": running})
        state.update((n, total))

    rows = events.select(F.col(by).cast("long").alias(by), F.col(order).cast("timestamp").alias(order), F.col(value).cast("double").alias(value))
    return rows.groupBy(by).applyInPandasWithState(fold, out, "n long, total double", "append", GroupStateTimeout.NoTimeout)


def replay(steps: DataFrame, state_path: str, path: str, fields: list[str], checkpoint: str):
    """Applies a stream of change steps to a table under state_path, batch by batch.

    Each batch writes the next version of the table; the version is the batch's number, so a batch
    that runs twice writes the same version.
    """
    from lattica.operators.edits import apply_steps

    spark = steps.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = f"{state_path}/version={number - 1}"
        schema = ", ".join(f"{c} string" for c in [path, *fields])
        state = spark.read.schema(schema).parquet(before) if number else spark.createDataFrame([], schema)
        apply_steps(state, path, fields, batch).write.mode("overwrite").parquet(f"{state_path}/version={number}")

    return steps.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
