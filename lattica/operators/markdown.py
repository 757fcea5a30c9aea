"""Structure to Markdown: one expression a kind of block, and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(rows: DataFrame, by: list[str], order: list[str], text: Column, separator: str = "\n\n") -> DataFrame:
    """The rows' texts of a group in order, null and empty ones left out: (by, text)."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return rows.where(text.isNotNull() & (text != "")).groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), separator).alias("text"))


def escape(cell: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")


def table(rows: Column) -> Column:
    """A pipe table of array<array<string>>, the first row as its head; short rows are padded."""
    width = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, escape), " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))))
    rule = F.concat(F.lit("|"), F.call_function("repeat", F.lit(" --- |"), width))
    body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(padded, 0)), rule), body), "\n"))


def block(kind="type", text="text", level="level", rows: str | None = None) -> Column:
    """A block's Markdown by its type."""
    k, t = F.col(kind), F.coalesce(F.col(text), F.lit(""))
    n = F.least(F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)), F.lit(6))
    made = (
        F.when(k == "heading", F.concat(F.call_function("repeat", F.lit("#"), n), F.lit(" "), t))
        .when(k == "code", F.concat(F.lit("```\n"), t, F.lit("\n```")))
        .when(k == "quote", F.regexp_replace(t, r"(?m)^", "> "))
        .when(k == "formula", F.when(t.contains("\n"), F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), t, F.lit("$"))))
        .when(k == "list", F.concat(F.call_function("repeat", F.lit("  "), n - 1), F.lit("- "), t))
        .when(k == "attachment", F.concat(F.lit("["), t, F.lit("]("), t, F.lit(")")))
        .when(k == "image", F.concat(F.lit("!["), t, F.lit("]()")))
        .when(k == "page_break", F.lit("---"))
        .when(k == "column_break", F.lit(""))
    )
    if rows:
        made = made.when(k == "table", table(F.col(rows)))
    return made.otherwise(t)


def document(blocks: DataFrame, by: list[str], order: list[str], rows: str | None = None) -> DataFrame:
    return ordered_text(blocks, by, order, block(rows=rows))


def revised(text: Column, kind: Column, mode: str) -> Column:
    """A run of tracked changes: final drops deletions, original insertions, markup tags both."""
    if mode == "markup":
        return F.when(kind == "del", F.concat(F.lit("<del>"), text, F.lit("</del>"))).when(kind == "ins", F.concat(F.lit("<ins>"), text, F.lit("</ins>"))).otherwise(text)
    return F.when(kind == {"final": "del", "original": "ins"}[mode], "").otherwise(text)


def numbered(items: DataFrame, by: list[str], order: str, text: str, start: int = 1) -> DataFrame:
    from lattica.operators.windows import ordinals

    made = ordinals(items, by, [order])
    return made.withColumn("markdown", F.concat((F.col("ordinal") + start - 1).cast("string"), F.lit(". "), F.col(text)))


def conversation(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    return ordered_text(turns, [id], [turn], F.concat(F.lit("**"), F.col(role), F.lit(":** "), F.coalesce(F.col(text), F.lit(""))))


def long_chart(points: DataFrame, by: list[str], category: str, order: str, series: list[str], value: str, name: str) -> DataFrame:
    """A chart's points as category by series, with a dash for a missing value, as one pipe table a chart."""
    cells = points.groupBy(*by, category).agg(F.min(order).alias("_o"), *[F.coalesce(F.max(F.when(F.col(name) == s, F.col(value).cast("string"))), F.lit("—")).alias(f"_{i}") for i, s in enumerate(series)])
    rows = F.array_sort(F.collect_list(F.struct("_o", F.array(category, *[f"_{i}" for i in range(len(series))]).alias("r"))))
    head = F.array(F.array(F.lit(""), *map(F.lit, series)))
    return cells.groupBy(*by).agg(table(F.concat(head, F.transform(rows, lambda x: x["r"]))).alias("text"))


def sheet(cells: DataFrame, most: int = 20_000) -> DataFrame:
    """(sheet, text): a pipe grid of the used range, or a list of cells where a sheet has more than `most`."""
    from lattica.operators.cells import a1, shown

    held = cells.where("kind <> 'empty'")
    size = held.groupBy("sheet").agg(F.count("*").alias("_n"), F.min("col").alias("_c1"), F.max("col").alias("_c2"), F.min("row").alias("_r1"), F.max("row").alias("_r2"))
    joined = held.join(size, "sheet").withColumn("_t", shown())
    dense = joined.where(F.col("_n") <= most)
    row = F.map_from_entries(F.collect_list(F.struct("col", "_t")))
    filled = dense.groupBy("sheet", "row", "_c1", "_c2", "_r1", "_r2").agg(row.alias("m"))
    filled = filled.withColumn("_line", F.transform(F.sequence("_c1", "_c2"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))))
    by_row = filled.groupBy("sheet", "_r1", "_r2").agg(F.map_from_entries(F.collect_list(F.struct("row", "_line"))).alias("rows"))
    grid = F.transform(F.sequence("_r1", "_r2"), lambda r: F.coalesce(F.try_element_at("rows", r), F.array(F.lit(""))))
    dense_text = by_row.select("sheet", table(grid).alias("text"))
    sparse = joined.where(F.col("_n") > most)
    return dense_text.unionByName(ordered_text(sparse, ["sheet"], ["row", "col"], F.concat(a1(F.col("row"), F.col("col")), F.lit(": "), F.col("_t")), "\n"))


def page(lines: DataFrame, by: list[str], order: str, text: str, size: str, body: str) -> DataFrame:
    """Lines with sizes against the body size: # from 1.9 times, ## from 1.35, list items, else text."""
    from lattica.operators.text import list_item

    ratio = F.col(size) / F.col(body)
    item = list_item(F.col(text))
    made = F.when(ratio >= 1.9, F.concat(F.lit("# "), F.col(text))).when(ratio >= 1.35, F.concat(F.lit("## "), F.col(text))).when(item.isNotNull(), F.concat(F.lit("- "), item)).otherwise(F.col(text))
    return ordered_text(lines, by, [order], made, "\n")


#: A deck's components, by type: what their value and label columns become.
def component(kind: Column, label: Column, value: Column, most: Column, delta: Column) -> Column:
    n = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return (
        F.when(kind == "progress", F.concat(label, F.lit(": "), n(F.round(value * 100 / most)), F.lit("%")))
        .when(kind == "kpi", F.concat(F.lit("**"), label, F.lit("**: "), n(value), F.when(delta.isNotNull(), F.concat(F.lit(" ("), F.when(delta >= 0, "+").otherwise(""), n(delta), F.lit(")"))).otherwise("")))
        .when(kind == "rating", F.concat(label, F.lit(": "), n(value), F.lit("/"), n(most)))
        .when(kind == "timeline", F.concat(F.lit("- "), label))
        .when(kind == "flow", F.concat(n(value), F.lit(". "), label))
        .otherwise(label)
    )
