"""Product directories (JSON manifest and shards), Markdown and manifest sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.cells import split_a1

SHEET = T.StructType().add("name", "string").add(
    "rows",
    T.ArrayType(T.StructType().add("index", "integer").add("cells", T.ArrayType(T.StructType().add("ref", "string").add("value", "string").add("formula", "string").add("type", "string")))),
)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Cells of sheet shards, one JSON document a file: the shard is the unit of parallelism.

    Rows without an index and cells without a reference take the place after the one before.
    """
    from lattica.operators.cells import typed

    shards = spark.read.schema(SHEET).option("multiLine", True).json(path)
    after = lambda said, k, by: k + F.coalesce(F.last(said - k, ignorenulls=True).over(Window.partitionBy(*by).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    rows = shards.select(F.col("name").alias("sheet"), F.posexplode("rows").alias("r", "line"))
    rows = rows.withColumn("row", after(F.col("line.index"), F.col("r"), ["sheet"]))
    cells = rows.select("sheet", "row", F.posexplode("line.cells").alias("k", "cell"))
    r, c = split_a1(F.col("cell.ref"))
    held = F.col("cell.ref").isNotNull()
    placed = cells.withColumn("col", after(F.when(held, c), F.col("k"), ["sheet", "row"]))
    placed = placed.select("sheet", F.when(held, r).otherwise(F.col("row")).alias("row"), "col", F.col("cell.type").alias("said"), "cell.value", "cell.formula")
    kind, num, text, logical = typed(F.col("value"))
    as_text = F.col("said") == "string"
    return placed.select("sheet", "row", "col", F.when(as_text, "string").otherwise(kind).alias("kind"), F.when(as_text, None).otherwise(num).alias("num"), F.when(as_text, F.col("value")).otherwise(text).alias("str"), F.when(as_text, None).otherwise(logical).alias("bool"), "formula")


def write_sheets(cells: DataFrame, path: str) -> None:
    """One folder a sheet of JSON lines, a row a line, in order within each file."""
    from lattica.operators.cells import a1, shown

    cell = F.struct(a1(F.col("row"), F.col("col")).alias("ref"), shown().alias("value"), F.col("formula"), F.col("kind").alias("type"))
    rows = cells.groupBy("sheet", F.col("row").alias("index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    rows.repartition("sheet").sortWithinPartitions("sheet", "index").write.partitionBy("sheet").json(path)


def inline(cells: DataFrame) -> DataFrame:
    """Each sheet as one JSON text: (sheet, json)."""
    from lattica.operators.cells import a1, shown

    cell = F.struct(a1(F.col("row"), F.col("col")).alias("ref"), shown().alias("value"))
    rows = cells.groupBy("sheet", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    whole = rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("index"), "cells"))).alias("rows"))
    return whole.select("sheet", F.to_json(F.struct(F.col("sheet").alias("name"), "rows")).alias("json"))


def manifest(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Payloads once each: (sha256, size, mime, path, sources), equal content named by its first path."""
    #: File endings and media types, fixed values.
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "xml": "application/xml", "json": "application/json", "html": "text/html", "txt": "text/plain", "csv": "text/csv"}
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[x for kv in types.items() for x in map(F.lit, kv)]), ending), F.lit("application/octet-stream"))
    rows = files.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(F.col(content).cast("binary")).cast("long").alias("size"), mime.alias("mime"), F.col(path).cast("string").alias("path"))
    return rows.groupBy("sha256", "size").agg(F.min_by("mime", "path").alias("mime"), F.min("path").alias("path"), F.array_sort(F.collect_set("path")).alias("sources"))


def write_markdown(df: DataFrame, path: str, by: str, text: str = "text") -> None:
    """One folder of Markdown lines a document."""
    df.select(F.col(by).cast("string").alias(by), F.col(text).alias("value")).write.partitionBy(by).text(path)
