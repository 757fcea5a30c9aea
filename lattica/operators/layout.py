"""Page layout from text items (doc_id, page, item, x, end_x, y, size, text).

Lines, cells and tables are gaps-and-islands windows within a page; the recursive X-Y cut is a
grouped map, of which a group is one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.windows import previous

PAGE = ["doc_id", "page"]


def lines(items: DataFrame) -> DataFrame:
    """Adds `line`: items of a page from top to bottom, a new one where y falls by 0.6 of the size or more."""
    order = [F.desc("y"), F.asc("x"), F.asc("item")]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    drop = F.lag("y").over(w) - F.col("y")
    fresh = F.coalesce((drop >= F.col("size") * 0.6).cast("int"), F.lit(1))
    return items.withColumn("_new", fresh).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def line_cells(lined: DataFrame, em: float = 2.0, word: float = 0.2) -> DataFrame:
    """(doc_id, page, line, cell, x, end_x, y, size, text): a gap over 2 em begins a cell, one over 0.2 em is a space."""
    by = [*PAGE, "line"]
    gap = F.col("x") - previous("end_x", by, ["x", "item"])
    split = lined.withColumn("_gap", gap).withColumn("_new", F.coalesce((F.col("_gap") > F.col("size") * em).cast("int"), F.lit(0)))
    w = Window.partitionBy(*by).orderBy("x", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = split.withColumn("cell", F.sum("_new").over(w))
    piece = F.concat(F.when((F.col("_gap") > F.col("size") * word) & (F.col("_new") == 0), " ").otherwise(""), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("x", "item", piece.alias("t"))))
    return split.groupBy(*by, "cell").agg(F.min("x").alias("x"), F.max("end_x").alias("end_x"), F.max("y").alias("y"), F.max("size").alias("size"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def line_text(cells: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("cell", "text")))
    return cells.groupBy(*PAGE, "line").agg(F.max("y").alias("y"), F.max("size").alias("size"), F.min("x").alias("x"), F.max("end_x").alias("end_x"), F.count("*").alias("cells"), F.transform(parts, lambda p: p["text"]).alias("row"))


def tables(cells: DataFrame) -> DataFrame:
    """Runs of lines with two cells or more, without the leading lines that do not have the last one's count.

    (doc_id, page, table, first, last, columns, rows); a table has two lines at least.
    """
    rows = line_text(cells)
    w = Window.partitionBy(*PAGE).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("_run", F.sum((F.col("cells") < 2).cast("int")).over(upto)).where("cells >= 2")
    in_run = Window.partitionBy(*PAGE, "_run").orderBy("line")
    change = F.coalesce((F.col("cells") != F.lag("cells").over(in_run)).cast("int"), F.lit(0))
    runs = runs.withColumn("_new", change).withColumn("_part", F.sum("_new").over(in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("_last", F.max("_part").over(Window.partitionBy(*PAGE, "_run"))).where("_part = _last")
    grid = F.array_sort(F.collect_list(F.struct("line", "row")))
    found = runs.groupBy(*PAGE, "_run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.first("cells").alias("columns"), F.transform(grid, lambda r: r["row"]).alias("rows"))
    found = found.where(F.size("rows") >= 2)
    return found.withColumn("table", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first"))).drop("_run")


def blocks(rows: DataFrame, factor: float = 1.4) -> DataFrame:
    """Adds `block`: a new one where the step down is over 1.4 of the page's upper median line height."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    stepped = rows.withColumn("_step", F.lag("y").over(w) - F.col("y"))
    ranked = stepped.where(F.col("_step") > 0).withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_step"))).withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE)))
    median = ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*PAGE, F.col("_step").alias("_m"))
    joined = stepped.join(median, PAGE, "left").withColumn("_new", F.coalesce((F.col("_step") > factor * F.col("_m")).cast("int"), F.lit(0)))
    return joined.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new", "_step", "_m")


def paragraphs(rows: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Lines of like size that follow each other, as one text: (doc_id, page, paragraph, size, text)."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    fresh = F.coalesce(F.abs(F.col("size") - F.lag("size").over(w)) > F.col("size") * tolerance, F.lit(True))
    marked = rows.withColumn("_new", fresh.cast("int")).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct("line", F.array_join("row", " ").alias("t"))))
    return marked.groupBy(*PAGE, "paragraph").agg(F.max("size").alias("size"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def body_size(items: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent size in half points, weighted by characters; ties take the smaller."""
    half = F.round(F.col("size") * 2) / 2
    tally = items.groupBy(*by, half.alias("s")).agg(F.sum(F.length("text")).alias("n"))
    return tally.groupBy(*by).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))


def overlaps(items: DataFrame, bucket: float = 20.0, share: float = 0.7) -> DataFrame:
    """Items without those that repeat an earlier item's text over at least `share` of their box.

    Candidates share a grid bucket: an item stands in each bucket that its box touches.
    """
    box = items.withColumn("_y1", F.col("y") - F.col("size"))
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket).cast("int"), F.floor(hi / bucket).cast("int")))
    filed = box.withColumn("_bx", spread(F.col("x"), F.col("end_x"))).withColumn("_by", spread(F.col("_y1"), F.col("y")))
    a = filed.select(*PAGE, "_bx", "_by", "text", F.col("item").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("x", "end_x", "_y1", "y")])
    b = filed.select(*PAGE, "_bx", "_by", "text", F.col("item").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("x", "end_x", "_y1", "y")])
    met = a.join(b, [*PAGE, "_bx", "_by", "text"]).where("i < j")
    wide = F.greatest(F.least("a_end_x", "b_end_x") - F.greatest("a_x", "b_x"), F.lit(0.0))
    tall = F.greatest(F.least("a_y", "b_y") - F.greatest("a__y1", "b__y1"), F.lit(0.0))
    area = (F.col("b_end_x") - F.col("b_x")) * (F.col("b_y") - F.col("b__y1"))
    gone = met.where(wide * tall >= area * share).select(*PAGE, F.col("j").alias("item")).distinct()
    return items.join(gone, [*PAGE, "item"], "left_anti")


def xy_cut(rows: DataFrame, width: float = 612.0, valley: float = 8.0, bucket: float = 2.0, least: int = 4, deep: int = 8) -> DataFrame:
    """Adds `region` to lines (doc_id, page, line, x, end_x, y, size): columns and bands in reading order.

    Cuts take turns, down between columns first. A cut down is at the widest run of buckets (the first of equals,
    the left margin among them) in which fewer than a tenth of the median of the occupied ones lie, of at least
    `valley` points; lines that end before it are the left column. A cut across is at every step down of more than
    1.4 of the page's line height. A region that its turn's cut leaves whole, that has fewer than `least` lines, or
    that lies deeper than `deep`, is not cut further.
    """

    def cut(pdf):
        import numpy as np

        x0, x1, y, size = (pdf[c].to_numpy(float) for c in ("x", "end_x", "y", "size"))
        count = max(1, int(np.ceil(width / bucket)))
        height = max(float(np.sort(size)[len(size) // 2]) * 1.25, 8.0)
        region = np.zeros(len(pdf), int)
        number = 0

        def columns(index):
            first = np.clip((x0[index] / bucket).astype(int), 0, count - 1)
            past = np.clip((x1[index] / bucket).astype(int) + 1, 0, count)
            held = past > first
            edges = np.bincount(first[held], minlength=count + 1) - np.bincount(past[held], minlength=count + 1)
            density = np.cumsum(edges)[:count]
            occupied = np.sort(density[density > 0])
            if len(occupied) < 2:
                return None
            empty = density < max(occupied[len(occupied) // 2] * 0.1, 0.5)
            turns = np.flatnonzero(np.diff(np.concatenate([[0], empty.astype(int), [0]])))
            runs = [(b - a, -a) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b < count]  # the right margin has no end
            if not runs or max(runs)[0] * bucket < valley:
                return None
            left = x1[index] <= -max(runs)[1] * bucket
            return [index[left], index[~left]] if left.any() and not left.all() else None

        def bands(index):
            order = index[np.argsort(-y[index], kind="stable")]
            steps = np.flatnonzero(-np.diff(y[order]) > height * 1.4) + 1
            return np.split(order, steps) if len(steps) else None

        def split(index, down, depth):
            nonlocal number
            parts = None if len(index) < least or depth > deep else (columns if down else bands)(index)
            if parts:
                for part in parts:
                    split(part, not down, depth + 1)
            else:
                region[index] = number
                number += 1

        split(np.argsort(pdf["line"].to_numpy(), kind="stable"), True, 0)
        return pdf.assign(region=region)

    schema = T.StructType([*rows.schema.fields, T.StructField("region", T.LongType())])
    return rows.groupBy(*PAGE).applyInPandas(cut, schema)


def projected(cells: DataFrame, em: float = 0.5) -> DataFrame:
    """Each line as text whose spaces keep the cells' places: (doc_id, page, line, text)."""
    w = Window.partitionBy(*PAGE, "line").orderBy("cell")
    column = F.round(F.col("x") / (F.col("size") * em)).cast("int")
    placed = cells.withColumn("_c", column).withColumn("_end", F.col("_c") + F.length("text")).withColumn("_pad", F.greatest(F.col("_c") - F.coalesce(F.lag("_end").over(w), F.lit(0)), F.when(F.col("cell") == 0, 0).otherwise(1)))
    parts = F.array_sort(F.collect_list(F.struct("cell", F.concat(F.repeat(F.lit(" "), F.col("_pad")), F.col("text")).alias("t"))))
    return placed.groupBy(*PAGE, "line").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def to_blocks(items: DataFrame) -> DataFrame:
    """Pages rebuilt as blocks (doc_id, page, pos, type, level, text, rows): headings by size against the body, list items, tables, paragraphs."""
    from lattica.operators.text import list_item

    cells = line_cells(lines(items))
    rows = line_text(cells).join(body_size(items, ["doc_id"]), "doc_id")
    found = tables(cells).select(*PAGE, F.col("first").alias("line"), F.col("last"), F.col("rows"))
    inside = rows.join(found.select(*PAGE, F.col("line").alias("_a"), F.col("last").alias("_b")), PAGE).where(F.col("line").between(F.col("_a"), F.col("_b"))).select(*PAGE, "line")
    plain = rows.join(inside, [*PAGE, "line"], "left_anti").withColumn("t", F.array_join("row", " "))
    ratio, item = F.col("size") / F.col("body_size"), list_item(F.col("t"))
    level = F.when(ratio >= 1.9, 1).when(ratio >= 1.35, 2)
    kind = F.when(level.isNotNull(), "heading").when(item.isNotNull(), "list").otherwise("paragraph")
    text = F.when(kind == "list", item).otherwise(F.col("t"))
    none = F.lit(None).cast("array<array<string>>")
    made = plain.select(*PAGE, F.col("line").alias("pos"), kind.alias("type"), level.alias("level"), text.alias("text"), none.alias("rows"))
    return made.unionByName(found.select(*PAGE, F.col("line").alias("pos"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), "rows"))


def table_cells(found: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, kind, num, str) of detected tables; a cell with digits and no space is a number without its commas."""
    spots = found.select(F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_table"), F.col("table").cast("string")).alias("sheet"), "doc_id", F.posexplode("rows").alias("r", "line"))
    cells = spots.select("doc_id", "sheet", (F.col("r") + 1).alias("row"), F.posexplode("line").alias("c", "t"))
    number = F.when(F.col("t").rlike(r"^[+-]?[0-9]\S*$"), F.replace("t", F.lit(","), F.lit("")).try_cast("double"))
    return cells.select("doc_id", "sheet", "row", (F.col("c") + 1).alias("col"), F.when(number.isNotNull(), "number").otherwise("string").alias("kind"), number.alias("num"), F.when(number.isNull(), F.col("t")).alias("str"))
