"""Validators. Each gives (path, severity, message) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(path: Column, severity: str, message: Column | str) -> list[Column]:
    return [path.alias("path"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message")]


def rules(df: DataFrame, path: Column, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One pass over df for any number of row rules: {message: (severity, broken)}."""
    each = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for message, (severity, broken) in checks.items()]
    return df.select(path.alias("path"), F.explode(F.array_compact(F.array(*each))).alias("f")).select("path", "f.*")


def duplicates(df: DataFrame, by: list[str], name: str, path: Column, severity: str = "error") -> DataFrame:
    """Names that occur more than once in their group."""
    twice = df.where(F.col(name).isNotNull()).groupBy(*by, F.lower(name).alias("name")).agg(F.count("*").alias("n"), F.min(path).alias("path")).where("n > 1")
    return twice.select("path", F.lit(severity).alias("severity"), F.concat(F.lit("duplicate name "), "name").alias("message"))


def all_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def workbook(sheets: DataFrame, cells: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Nine rules of a workbook: sheets (sheet, freeze, filter_range), cells (sheet, row, col, ref, formula, style)."""
    path = F.concat(F.lit("/sheet["), F.col("sheet"), F.lit("]"))
    a1 = r"^\$?[A-Za-z]{1,3}\$?[0-9]+$"
    span = r"^\$?[A-Za-z]{1,3}\$?[0-9]+(:\$?[A-Za-z]{1,3}\$?[0-9]+)?$"
    sheet_rules = rules(
        sheets,
        path,
        {
            "empty sheet name": ("error", F.btrim("sheet") == ""),
            "sheet name longer than 31": ("error", F.length("sheet") > 31),
            "freeze is not a cell": ("error", F.col("freeze").isNotNull() & ~F.col("freeze").rlike(a1)),
            "filter is not a range": ("error", F.col("filter_range").isNotNull() & ~F.col("filter_range").rlike(span)),
        },
    )
    cell_rules = rules(
        cells,
        F.concat(path, F.lit("/cell["), F.coalesce("ref", F.lit("")), F.lit("]")),
        {
            "row index below 1": ("error", F.col("row") < 1),
            "bad cell reference": ("error", F.col("ref").isNotNull() & ~F.col("ref").rlike(a1)),
            "formula begins with =": ("warning", F.col("formula").startswith("=")),
        },
    )
    found = [sheet_rules, cell_rules, duplicates(sheets, [], "sheet", path)]
    if styles is not None:
        lost = cells.where("style is not null").join(styles.select(F.col("style").alias("_s")).distinct(), F.col("style") == F.col("_s"), "left_anti")
        found.append(lost.select(*finding(F.concat(path, F.lit("/cell["), F.coalesce("ref", F.lit("")), F.lit("]")), "error", F.concat(F.lit("unknown style "), "style"))))
    return all_findings(*found)


def elements(table: DataFrame, width: float, height: float) -> DataFrame:
    """Elements (page, path, type, name, x, y, w, h) outside their page, of no size, or of one name."""
    x, y, w, h = map(F.col, "xywh")
    placed = rules(
        table,
        F.col("path"),
        {
            "outside the page": ("warning", (x < 0) | (y < 0) | (x + w > width) | (y + h > height)),
            "no size": ("error", (w <= 0) | (h <= 0)),
        },
    )
    return all_findings(placed, duplicates(table, ["page"], "name", F.col("path"), "warning"))


def page_findings(pages: DataFrame, tolerance: float = 2.0, symmetry: float = 0.05) -> DataFrame:
    """Pages (page, chars, images, x1, y1, x2, y2, width, height): blank, overflowing or lopsided ones."""
    left, right = F.col("x1"), F.col("width") - F.col("x2")
    return rules(
        pages,
        F.concat(F.lit("/page["), F.col("page").cast("string"), F.lit("]")),
        {
            "blank page": ("error", (F.col("chars") == 0) & (F.col("images") == 0)),
            "content overflows": ("error", (F.col("x1") < -tolerance) | (F.col("y1") < -tolerance) | (F.col("x2") > F.col("width") + tolerance) | (F.col("y2") > F.col("height") + tolerance)),
            "margins differ": ("warning", (F.abs(left - right) > F.col("width") * symmetry) & (left > 5) & (right > 5)),
        },
    )


def content_warnings(blocks: DataFrame, headings_for_toc: int = 3) -> DataFrame:
    """Blocks (doc_id, pos, type, level, text): empty paragraphs, placeholders, images without text, heading jumps, no contents."""
    from lattica.operators.windows import level_jumps

    path = F.concat(F.lit("/doc["), F.col("doc_id").cast("string"), F.lit("]/block["), F.col("pos").cast("string"), F.lit("]"))
    rows = rules(
        blocks,
        path,
        {
            "empty paragraph": ("info", (F.col("type") == "paragraph") & (F.btrim(F.coalesce("text", F.lit(""))) == "")),
            "placeholder text": ("warning", F.col("text").rlike(r"\{\{.*?\}\}|(?i:lorem ipsum|\bTODO\b|\bTBD\b)")),
            "image without a description": ("warning", (F.col("type") == "image") & (F.btrim(F.coalesce("text", F.lit(""))) == "")),
        },
    )
    heads = blocks.where("type = 'heading'")
    jumps = level_jumps(heads, ["doc_id"], "pos", "level").select(*finding(path, "warning", F.concat(F.lit("heading jumps to level "), F.col("level").cast("string"))))
    docs = blocks.groupBy("doc_id").agg(F.count_if(F.col("type") == "heading").alias("heads"), F.count_if(F.col("type") == "toc").alias("toc"))
    bare = docs.where((F.col("heads") >= headings_for_toc) & (F.col("toc") == 0))
    bare = bare.select(*finding(F.concat(F.lit("/doc["), F.col("doc_id").cast("string"), F.lit("]")), "info", "no table of contents"))
    return all_findings(rows, jumps, bare)
