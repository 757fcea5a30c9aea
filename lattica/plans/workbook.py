"""Evaluation of a workbook's formulas: one projection for each template and dependency level.

Formulas become templates, their text with the references taken out; a formula filled down a million
rows is one template and one Column. Cells are evaluated in rounds: a round takes the formulas whose
referenced cells all have values, gathers those with one join, and projects each template. A column of
running sums, in which each formula adds to the cell above it (a balance, a counter), is one round: its steps
are projected and summed by a window. Rounds go on until no formula is ready, however deep the chain. What a
cycle holds stays without a value and is told by `unresolved`, and so is a formula beyond the rules.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lattica.functions.core import BOOL, GRID, NUM, STR, E, Fun, lit
from lattica.functions.lower import Scope, lower
from lattica.functions.parser import FormulaError, Name, Op, parse, parse_ref
from lattica.plans.materialise import Table

#: So many templates are projected in one plan; more take further plans in the same round.
PLAN_TEMPLATES = 200

VALUES = "sheet string, row int, col int, kind string, num double, str string, bool boolean"

_REFERENCE = re.compile(r"""("(?:[^"]|"")*")|(?:('(?:[^']|'')+'|[A-Za-z_][\w.]*)!)?(?<![\w.])(\$?[A-Za-z]{1,3}\$?[0-9]+)(?::(\$?[A-Za-z]{1,3}\$?[0-9]+))?(?![\w.(])""")


def template(text: str, sheet: str) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """A formula with its references as ref0, ref1, ..., and the ranges that they name."""
    refs: list[tuple[str, int, int, int, int]] = []

    def take(m):
        if m[1] is not None:
            return m[1]
        a, b = parse_ref(m[3]), parse_ref(m[4] or m[3])
        name = m[2].strip("'").replace("''", "'").lower() if m[2] else sheet.lower()
        refs.append((name, min(a.row, b.row), min(a.col, b.col), max(a.row, b.row), max(a.col, b.col)))
        return f"ref_{len(refs) - 1}"

    return _REFERENCE.sub(take, text), refs


def _templates(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, template, refs) of the formula cells."""
    ref = pa.struct([("sheet", pa.string()), *((k, pa.int32()) for k in ("r1", "c1", "r2", "c2"))])

    def run(batches):
        for batch in batches:
            made = [template(f, s) for s, f in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            refs = [[dict(zip(("sheet", "r1", "c1", "r2", "c2"), r, strict=True)) for r in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m[0] for m in made], pa.string()), pa.array(refs, pa.list_(ref))], names=["sheet", "row", "col", "template", "refs"])

    rows = cells.where(F.col("formula").isNotNull()).select("sheet", F.col("row").cast("int"), F.col("col").cast("int"), "formula")
    return rows.mapInArrow(run, "sheet string, row int, col int, template string, refs array<struct<sheet:string,r1:int,c1:int,r2:int,c2:int>>")


class _Gathered(Scope):
    """A template's references as grids gathered in columns g0, g1, ..."""

    def __init__(self, kinds: dict[int, str], single: dict[int, bool]):
        made = {}
        for k, kind in kinds.items():
            column = {NUM: "num", STR: "str", BOOL: "bool"}[kind]
            cells = _grid(k, column)
            made[f"ref_{k}"] = E(F.get(F.get(cells, 0), 0), kind) if single[k] else E(cells, GRID, kind)
        super().__init__(made)


def _grid(k: int, column: str):
    return F.transform(F.get("grids", k), lambda r: F.transform(r, lambda x: x[column]))


def _gather(ready: DataFrame, values: DataFrame) -> DataFrame:
    """Adds `grids`: for each reference its rows of cells; cells without a value are null."""
    refs = ready.select("sheet", "row", "col", "template", F.posexplode("refs").alias("k", "ref"))
    rows = F.explode(F.sequence("ref.r1", "ref.r2"))
    spots = refs.withColumn("r", rows).withColumn("c", F.explode(F.sequence("ref.c1", "ref.c2")))
    known = values.select(F.lower("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.struct("kind", "num", "str", "bool").alias("cell"))
    met = spots.join(known, (F.col("ref.sheet") == F.col("_s")) & (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")), "left")
    line = met.groupBy("sheet", "row", "col", "template", "k", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("cell", F.struct(F.lit("empty").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"))).alias("v")))), lambda x: x["v"]).alias("cells"))
    grid = line.groupBy("sheet", "row", "col", "template", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda x: x["cells"]).alias("grid"))
    return grid.groupBy("sheet", "row", "col", "template").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "grid"))), lambda x: x["grid"]).alias("grids"))


def _plain(e: E):
    """The value columns of a result; a grid's first cell stands at the anchor."""
    none = {NUM: "double", STR: "string", BOOL: "boolean"}
    col, kind = (F.get(F.get(e.col, 0), 0), e.elem) if e.kind == GRID else (e.col, e.kind)
    parts = {k: (col if k == kind else F.lit(None).cast(t)) for k, t in none.items()}
    said = F.when(col.isNull(), "empty").otherwise({NUM: "number", STR: "string", BOOL: "bool"}[kind])
    return [said.alias("kind"), parts[NUM].alias("num"), parts[STR].alias("str"), parts[BOOL].alias("bool")]


def _project(gathered: DataFrame, text: str, kinds: dict[int, str], single: dict[int, bool]) -> DataFrame:
    mine = gathered.where(F.col("template") == text)
    scope = _Gathered(kinds, single)
    if text.startswith("~"):  # a chain's step: what is added to the cell above, which counts as 0 here
        _, up, text = text.split("~", 2)
        scope = scope.with_names({f"ref_{up}": lit(0)})
    made = lower(parse(text), scope)
    if isinstance(made, Fun):
        raise FormulaError("a LAMBDA is not a value")
    if made.kind != GRID:
        return mine.select("sheet", "row", "col", F.lit(True).alias("anchor"), *_plain(made))
    lines = mine.select("sheet", "row", "col", F.posexplode(made.col).alias("down", "line"))
    cells = lines.select("sheet", "row", "col", "down", F.posexplode("line").alias("right", "v"))
    spot = cells.select("sheet", (F.col("row") + F.col("down")).alias("row"), (F.col("col") + F.col("right")).alias("col"), ((F.col("down") == 0) & (F.col("right") == 0)).alias("anchor"), "v")
    return spot.select("sheet", "row", "col", "anchor", *_plain(E(F.col("v"), made.elem)))


def _terms(tree, sign: int = 1):
    """The (sign, tree) terms of a sum."""
    if isinstance(tree, Op) and tree.op in "+-":
        return _terms(tree.left, sign) + _terms(tree.right, sign if tree.op == "+" else -sign)
    return [(sign, tree)]


def _names(tree) -> list[str]:
    if isinstance(tree, Name):
        return [tree.name]
    if hasattr(tree, "__dataclass_fields__"):
        return [n for f in tree.__dataclass_fields__ for n in _names(getattr(tree, f))]
    return [n for x in tree for n in _names(x)] if isinstance(tree, (list, tuple)) else []


def step_refs(text: str) -> list[int]:
    """Which references a template adds once, as they are, and uses nowhere else: ref_0 of "ref_0+ref_1*2"."""
    try:
        tree = parse(text)
    except FormulaError:
        return []
    every = _names(tree)
    plain = [t.name for sign, t in _terms(tree) if sign == 1 and isinstance(t, Name)]
    return [int(n[4:]) for n in plain if every.count(n) == 1 and n.startswith("ref_") and len(every) > 1]


def _with_steps(formulas: DataFrame) -> DataFrame:
    """Adds `up`: the number of the reference by which a formula adds to the cell above it, else null."""

    def run(batches):
        for batch in batches:
            up = []
            known: dict[str, list[int]] = {}
            for sheet, row, col, text, refs in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if text not in known:
                    known[text] = step_refs(text)
                above = {"sheet": sheet.lower(), "r1": row - 1, "c1": col, "r2": row - 1, "c2": col}
                up.append(next((k for k in known[text] if refs[k] == above), None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up, pa.int32())], names=[*batch.schema.names, "up"])

    return formulas.mapInArrow(run, StructType([*formulas.schema.fields, StructField("up", IntegerType())]))


def _blocked(pending: DataFrame, refs, some: DataFrame | None = None) -> DataFrame:
    """(sheet, row, col) of the (some, or all) formulas of which one of refs holds a pending cell."""
    waits = (pending if some is None else some).select("sheet", "row", "col", F.explode(refs).alias("ref"))
    others = pending.select(F.lower("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"))
    spots = waits.withColumn("_x", F.explode(F.sequence("ref.c1", "ref.c2")))
    inside = (F.col("ref.sheet") == F.col("_s")) & (F.col("_x") == F.col("_c")) & F.col("_r").between(F.col("ref.r1"), F.col("ref.r2"))
    return spots.join(others, inside).select("sheet", "row", "col").distinct()


def evaluate(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, unresolved): VALUES of all cells after evaluation, and the formula cells that are in a cycle or beyond the rules.

    A literal cell in the way of a spilled result wins.
    """
    key = ["sheet", "row", "col"]
    formulas = Table(_with_steps(_templates(cells)), "formulas")
    values = Table(cells.where(F.col("formula").isNull() & (F.col("kind") != "empty")).select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "kind", "num", "str", "bool"), "values")
    pending, beyond = formulas.df, []
    while True:
        # a chain's formula is held up by its other references alone, and by its head
        waiting = _blocked(pending, "refs").withColumn("_w", F.lit(True))
        others = F.filter("refs", lambda r, i: F.col("up").isNull() | (i != F.col("up")))
        barred = _blocked(pending, others, pending.where("up is not null")).withColumn("_o", F.lit(True))
        marked = Table(pending.join(waiting, key, "left").join(barred, key, "left").withColumn("plain", F.col("_w").isNull()).withColumn("chain", F.col("up").isNotNull() & F.col("_o").isNull() & F.col("_w").isNotNull()).drop("_w", "_o"), "marked")
        # rows of a column that follow each other, from a head whose cell above has its value
        order = Window.partitionBy("sheet", "col").orderBy("row")
        apart = F.coalesce(F.col("row") != F.lag("row").over(order) + 1, F.lit(True))
        runs = marked.df.where("plain or chain").withColumn("_new", (apart | F.col("plain")).cast("int"))
        runs = runs.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        runs = runs.withColumn("_head", F.max("plain").over(Window.partitionBy("sheet", "col", "run")))
        ready = Table(runs.where("_head").drop("_new", "_head"), "ready")
        if not ready.df.limit(1).count():
            break
        stepped = F.when(F.col("chain"), F.transform("refs", lambda r, i: F.when(i == F.col("up"), F.struct(r["sheet"].alias("sheet"), *(F.lit(0).alias(c) for c in ("r1", "c1", "r2", "c2")))).otherwise(r))).otherwise(F.col("refs"))
        asked = ready.df.withColumn("refs", stepped).withColumn("template", F.when(F.col("chain"), F.concat(F.lit("~"), F.col("up").cast("string"), F.lit("~"), F.col("template"))).otherwise(F.col("template")))
        with_refs = _gather(asked, values.df)
        bare = asked.where(F.size("refs") == 0).select(*key, "template", F.array().cast(with_refs.schema["grids"].dataType).alias("grids"))
        gathered = Table(with_refs.unionByName(bare), "gathered")
        said = gathered.df.select("template", F.posexplode_outer("grids").alias("k", "g"))
        said = said.groupBy("template", "k").agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform(F.flatten("g"), lambda x: x["kind"]))))).alias("kinds"), F.max(F.size(F.flatten("g"))).alias("n"))
        plan: dict[str, tuple[dict, dict]] = {}
        for r in said.toLocalIterator():  # a row for each reference of each template
            kinds, single = plan.setdefault(r["template"], ({}, {}))
            if r["k"] is not None:
                held = set(r["kinds"] or []) - {"empty"}
                kinds[r["k"]] = BOOL if held == {"bool"} else STR if "string" in held else NUM
                single[r["k"]] = r["n"] == 1
        texts, made = sorted(plan), []
        for lo in range(0, len(texts), PLAN_TEMPLATES):
            done = []
            for text in texts[lo : lo + PLAN_TEMPLATES]:
                try:
                    done.append(_project(_texts(gathered.df, plan[text][0]), text, *plan[text]))
                except (FormulaError, TypeError):
                    beyond.append(gathered.df.where(F.col("template") == text).select(*key, "template"))
            if done:
                made.append(Table(reduce(lambda a, b: a.unionByName(b), done), "projected").df)
        if made:
            fresh = reduce(lambda a, b: a.unionByName(b), made)
            steps = ready.df.select(*key, "run", "chain")
            anchors = fresh.where("anchor").join(steps, key)
            # the head's value and the steps after it, summed in order; a step without a number leaves the rest without one
            upto = Window.partitionBy("sheet", "col", "run").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            number = F.coalesce("num", F.col("bool").cast("double"), F.col("str").try_cast("double"))
            total = F.when(F.count(F.when(number.isNull(), 1)).over(upto) == 0, F.sum(number).over(upto))
            summed = anchors.withColumn("_sum", total)
            pick = lambda c, new: F.when(F.col("chain"), new).otherwise(F.col(c)).alias(c)
            anchors = summed.select(*key, pick("kind", F.when(F.col("_sum").isNull(), "empty").otherwise("number")), pick("num", F.col("_sum")), pick("str", F.lit(None).cast("string")), pick("bool", F.lit(None).cast("boolean")))
            taken = values.df.select(*key).unionByName(formulas.df.select(*key))
            spilled = fresh.where("not anchor").join(taken, key, "left_anti").select(*anchors.columns)
            values = Table(values.df.unionByName(anchors.unionByName(spilled)), "values")
        pending = Table(marked.df.drop("plain", "chain").join(ready.df.select(*key), key, "left_anti"), "pending").df
    unresolved = reduce(lambda a, b: a.unionByName(b), beyond, pending.select(*key, "template"))
    return values.df.where("kind <> 'empty'"), unresolved.withColumn("template", F.regexp_replace("template", "^~[0-9]+~", ""))


def _texts(gathered: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """Numbers and booleans of references that hold text are shown as text."""
    if STR not in kinds.values():
        return gathered
    number = lambda n: F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string"))
    cell = lambda x: F.struct(x["kind"].alias("kind"), x["num"].alias("num"), F.coalesce(x["str"], number(x["num"]), F.upper(x["bool"].cast("string"))).alias("str"), x["bool"].alias("bool"))
    return gathered.withColumn("grids", F.transform("grids", lambda g: F.transform(g, lambda r: F.transform(r, cell))))
