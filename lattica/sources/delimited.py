"""CSV and TSV as tables or typed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.cells import typed

DELIMITERS = [",", "\t", ";", "|"]


def detect_delimiter(line: str) -> str:
    """The most frequent of the delimiters on the first line; of equals the later, a line with none is comma-separated."""
    counts = [(line.count(d), k) for k, d in enumerate(DELIMITERS)]
    best = max(counts)
    return DELIMITERS[best[1]] if best[0] else ","


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text, quotes doubled within quotes, line breaks allowed in them; nothing is inferred in a first pass.

    Only the first line is read to the driver, and only to find the delimiter.
    """
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = detect_delimiter(first[0][0] if first else "")
    reader = spark.read.option("header", header).option("sep", delimiter).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.option("inferSchema", False).csv(path)


def read_cells(spark: SparkSession, path: str, sheet: str = "Sheet1", delimiter: str | None = None) -> DataFrame:
    """Typed cells of a delimited file, the first line as row 1; rows are placed by their order in the file."""
    from lattica.operators.lookup import with_places

    table = read_text_table(spark, path, delimiter, header=False)
    ordered = table.withColumn("_at", F.monotonically_increasing_id())
    placed = with_places(ordered, "_at")
    cells = F.posexplode(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in table.columns])).alias("col", "t")
    rows = placed.select(F.lit(sheet).alias("sheet"), F.col("place").cast("int").alias("row"), cells)
    return rows.select("sheet", "row", (F.col("col") + 1).alias("col"), *typed(F.col("t")), F.lit(None).cast("string").alias("formula"))


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): the longest text of each column between 8 and 60, CJK counting two."""
    from lattica.operators.text import CJK

    wide = lambda c: F.length(c) + F.regexp_count(c, F.lit(f"[{CJK}]"))
    sizes = df.agg(*[F.max(wide(F.col(c).cast("string"))).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))).alias("n")) for c in df.columns])).alias("c")
    return sizes.select(cells).select("c.column", F.least(F.greatest(F.col("c.n") + 2, F.lit(8)), F.lit(60)).alias("width"))
