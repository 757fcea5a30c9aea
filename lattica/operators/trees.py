"""Trees of document elements as tables (by, id, up, place, type, name, text): paths, selectors, fields, pages, paragraphs.

A node's path is made by doubling pointers, so a tree of depth d takes about log2(d) joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.materialise import Table


def _climbed(nodes: DataFrame, by: list[str], join: str) -> DataFrame:
    """(by, id, said) from (by, id, up, said): what each node says behind what its ancestors say. A lost or circular parent ends the climb."""
    now = Table(nodes.select(*by, "id", "up", "said"), "nodes")
    reach = 1
    while now.df.where("up is not null").limit(1).count() and reach < 1 << 20:
        above = now.df.select(*by, F.col("id").alias("up"), F.col("up").alias("further"), F.col("said").alias("before"))
        joined = now.df.join(above, [*by, "up"], "left")
        now = Table(joined.select(*by, "id", F.col("further").alias("up"), F.concat(F.coalesce(F.concat("before", F.lit(join)), F.lit("")), "said").alias("said")), "nodes")
        reach *= 2
    return now.df.select(*by, "id", "said")


def walk(elements: DataFrame, by: list[str], root: Column) -> DataFrame:
    """Adds `path`, such as /slide[2]/group[1]/text[3]: types are numbered among the children of one parent, by place.

    root: the path of a tree's root as a Column. Children of groups are found at any depth.
    """
    number = F.row_number().over(Window.partitionBy(*by, "up", "type").orderBy("place", "id"))
    steps = elements.select(*by, "id", "up", F.concat("type", F.lit("["), number.cast("string"), F.lit("]")).alias("said"))
    return elements.join(_climbed(steps, by, "/").withColumnRenamed("said", "path"), [*by, "id"]).withColumn("path", F.concat(root, F.lit("/"), F.col("path")))


def selector(text: str, page: str = "page") -> Column:
    """The predicate of a selector: slide[N], a type or *, [name=X], [text=X], :contains("X"), :empty, in that order of writing."""
    made, rest = F.lit(True), text.strip()
    if "slide[" in rest:
        head = re.match(r"slide\[([0-9]+)\]\s*", rest)
        if not head or int(head[1]) < 1:
            raise ValueError(f"slide[N] stands first and counts from 1: {text!r}")
        made, rest = F.col(page) == int(head[1]), rest[head.end() :]
    kind = re.match(r"[^\[:]*", rest)[0]
    rest = rest[len(kind) :]
    if kind.strip() not in ("", "*"):
        made = made & (F.col("type") == kind.strip())
    body = F.coalesce("text", F.lit(""))
    while rest.strip():
        rest = rest.strip()
        part = re.match(r'\[(name|text)=([^\]]*)\]|:contains\(([^)]*)\)|:empty', rest)
        if not part:
            raise ValueError(f"not a selector: {rest!r}")
        if part[1] == "name":
            made = made & F.col("name").eqNullSafe(F.lit(part[2].strip('"')))
        elif part[0] == ":empty":
            made = made & (body == "")
        else:
            made = made & body.contains((part[2] if part[1] else part[3]).strip('"'))
        rest = rest[part.end() :]
    return made


def select(elements: DataFrame, text: str, page: str = "page") -> DataFrame:
    """Elements that a selector picks; predicates reach the scan."""
    return elements.where(selector(text, page))


def get(walked: DataFrame, path: str, below: bool = False) -> DataFrame:
    """The element at a path, or (below) all that hang from it too."""
    here = F.col("path") == path
    return walked.where(here | F.col("path").startswith(path + "/") if below else here)


def cells_at(cells: DataFrame, path: str) -> DataFrame:
    """Cells at /Sheet, /Sheet/B2, /Sheet/A1:C9 or /Sheet/row[3]; the sheet by name without case."""
    from lattica.operators.cells import window

    parts = path.strip("/").split("/")
    if len(parts) > 2 or not parts[0]:
        raise ValueError(f"not a path of a workbook: {path!r}")
    mine = cells.where(F.lower("sheet") == parts[0].lower())
    if len(parts) == 1:
        return mine
    row = re.fullmatch(r"row\[([0-9]+)\]", parts[1])
    return mine.where(F.col("row") == int(row[1])) if row else window(mine, parts[1] if ":" in parts[1] else f"{parts[1]}:{parts[1]}")


# ---------------------------------------------------------------- forms and attachments


def fields(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Form fields by their full name, a parent's before a point: nodes without children, with `full_name`."""
    named = _climbed(nodes.select(*by, "id", "up", F.coalesce("name", F.lit("")).alias("said")), by, ".").withColumnRenamed("said", "full_name")
    parents = nodes.where("up is not null").select(*by, F.col("up").alias("id")).distinct()
    return nodes.join(parents, [*by, "id"], "left_anti").join(named, [*by, "id"])


def field_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """How many fields there are of each type."""
    return found.groupBy(*by, "type").agg(F.count("*").alias("fields"))


def attachments(files: DataFrame, doc: str, name: str, content: str) -> DataFrame:
    """(doc, name, size, sha256) of the files that documents carry; a null content is empty."""
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return files.select(F.col(doc), F.col(name).alias("name"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"))


# ---------------------------------------------------------------- pages


def merged_pages(pages: DataFrame, file: str, page: str) -> DataFrame:
    """Adds `merged`, the page's number when files are put together in order of their names: counts of the files before, no global window."""
    sizes = pages.groupBy(file).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)))  # a row a file
    number = F.row_number().over(Window.partitionBy(file).orderBy(page))
    return pages.withColumn("_nr", number).join(before.select(file, "_before"), file).withColumn("merged", F.col("_nr") + F.coalesce("_before", F.lit(0))).drop("_nr", "_before")


def split_pages(pages: DataFrame, file: str, page: str) -> DataFrame:
    """Adds `part`, the name of the file of its own that each page becomes."""
    return pages.withColumn("part", F.concat(F.col(file), F.lit("_page"), F.lpad(F.col(page).cast("string"), 3, "0"), F.lit(".pdf")))


def clean_pages(pages: DataFrame, file: str, page: str, blank: Column) -> DataFrame:
    """Pages that are not blank, with `kept_as`, their number among those."""
    kept = pages.where(~F.coalesce(blank, F.lit(False)))
    return kept.withColumn("kept_as", F.row_number().over(Window.partitionBy(file).orderBy(page)))


# ---------------------------------------------------------------- paragraphs

#: Parts of style names and the classes that they stand for, fixed values, in the order in which they are asked.
NAMED = [("caption", "Caption"), ("题注", "Caption"), ("quote", "Quote"), ("引用", "Quote"), ("code", "Code"), ("代码", "Code"), ("toc", "TOC")]


def _level(n: Column) -> Column:
    return F.concat(F.lit("Heading"), F.least(F.greatest(n, F.lit(1)), F.lit(6)).cast("string"))


def paragraph_class(style: Column, outline: Column, name: Column) -> Column:
    """A paragraph's class by its style's id, outline level (from 0) and name; Normal where nothing says more."""
    low, id_ = F.lower(name), F.lower(style)
    digits = F.regexp_extract(low, r"heading[^0-9]*([0-9]+)", 1).try_cast("int")
    made = F.when(style.isNull() | id_.contains("header") | id_.contains("footer"), "Normal")
    made = made.when(outline <= 8, _level(outline + 1)).when(low.contains("heading"), _level(F.coalesce(digits, F.lit(1))))
    made = made.when(name.contains("标题"), _level(F.coalesce(F.regexp_extract(name, "([0-9])", 1).try_cast("int"), F.lit(1))))
    made = made.when(low == "title", "Title").when(low == "subtitle", "Subtitle")
    for part, kind in NAMED:
        made = made.when(low.contains(part), kind)
    number = F.regexp_extract(style, r"^Heading\+?([0-9]+)$", 1).try_cast("int")
    return made.when(number.between(0, 255), _level(number)).when(id_ == "title", "Title").otherwise("Normal")


def list_segments(line: Column) -> Column:
    """array<struct(marked, text)> of a line that holds several list items, cut at markers that stand alone; a line of one piece gives none."""
    from lattica.operators.text import BULLETS

    tokens = F.filter(F.split(line, " "), lambda t: t != "")
    start = F.struct(F.array().cast("array<struct<marked:boolean,text:string>>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("marked"))
    flushed = lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["marked"].alias("marked"), a["now"].alias("text")))))

    def step(a, token):
        marker = token.rlike(rf"^(?:[{BULLETS}-]|[0-9]{{1,3}}[.)])$")
        grown = F.when(a["now"] == "", token).otherwise(F.concat(a["now"], F.lit(" "), token))
        return F.struct(F.when(marker, flushed(a)).otherwise(a["done"]).alias("done"), F.when(marker, "").otherwise(grown).alias("now"), (marker | a["marked"] & ~marker).alias("marked"))

    made = F.aggregate(tokens, start, step, flushed)
    return F.when(F.size(made) > 1, made).otherwise(F.array().cast("array<struct<marked:boolean,text:string>>"))
