"""Office packages (zip of XML) from binary files: parts, workbooks, documents, decks.

A file is one row of Spark's binaryFile source and one task's unit; its parts are read with the
standard library in Arrow batches and leave as flat rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PARTS = "path string, part string, size long"
CELLS = "path string, sheet string, row int, col int, kind string, num double, str string, bool boolean, formula string"
BLOCKS = "path string, part int, pos int, type string, level int, text string, rows array<array<string>>"
ELEMENTS = "path string, slide int, pos int, type string, name string, text string, x double, y double, w double, h double"


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str):
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _relation(e):
    """The relation's id, which stands beside a plain id."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), None)


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, target part) of a part."""
    folder, name = posixpath.split(part)
    rels = posixpath.join(folder, "_rels", f"{name}.rels")
    if rels not in z.namelist():
        return {}
    out = {}
    for r in _xml(z, rels):
        target = r.get("Target", "")
        whole = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], whole)
    return out


def _main_part(z: zipfile.ZipFile) -> str:
    return next(t for k, t in _relations(z, "").values() if k == "officeDocument")


def _read(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """rows(path, zip) -> tuples; a file that is no package gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob.as_buffer())) as z:
                        made = list(rows(name, z))
                except (zipfile.BadZipFile, StopIteration):
                    continue
                for lo in range(0, len(made), 10_000):
                    columns = zip(*made[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def list_parts(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda name, z: [(name, i.filename, i.file_size) for i in z.infolist()], PARTS)


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    return _read(spark, path, lambda name, z: [(name, part, z.read(part))] if part in z.namelist() else [], "path string, part string, content binary")


def missing_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, severity, message) for relations whose target is not in the package."""

    def rows(name, z):
        names = set(z.namelist())
        for part in sorted(names):
            if not part.endswith(".rels"):
                for kind, target in _relations(z, part).values():
                    if target not in names and "://" not in target:
                        yield f"{name}/{part}", "error", f"missing {kind} {target}"

    return _read(spark, path, rows, "path string, severity string, message string")


def _column(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?([0-9]+)", ref)
    n = 0
    for c in m[1].upper():
        n = n * 26 + ord(c) - 64
    return int(m[2]), n


def _shared_strings(z):
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _xml(z, "xl/sharedStrings.xml")]


def shift_formula(text: str, down: int, right: int) -> str:
    """A formula moved by so many rows and columns; $ holds a part of a reference, text in quotes stays."""

    def move(m):
        if m["text"]:
            return m["text"]
        row, col = int(m["row"]) + (0 if m["fr"] else down), _column(m["col"] + "1")[1] + (0 if m["fc"] else right)
        letters = ""
        while col > 0:
            col, r = divmod(col - 1, 26)
            letters = chr(65 + r) + letters
        return f"{m['fc']}{letters}{m['fr']}{row}"

    return re.sub(r"""(?P<text>"[^"]*"|'[^']*'!)|(?<![A-Za-z0-9_.])(?P<fc>\$?)(?P<col>[A-Za-z]{1,3})(?P<fr>\$?)(?P<row>[0-9]+)(?![A-Za-z0-9_(.])""", move, text)


def _workbook(name, z):
    book = _main_part(z)
    relations, strings = _relations(z, book), _shared_strings(z)
    for sheet in (e for e in _xml(z, book).iter() if _tag(e) == "sheet"):
        kind, part = relations.get(_relation(sheet), ("", ""))
        if part not in z.namelist():
            continue
        shared: dict[str, tuple[str, int, int]] = {}
        row = 0
        for r in (e for e in _xml(z, part).iter() if _tag(e) == "row"):
            row = int(r.get("r") or row + 1)
            col = 0
            for c in r:
                at, col = _column(c.get("r")) if c.get("r") else (row, col + 1)
                parts = {_tag(x): x for x in c}
                formula = None
                if (f := parts.get("f")) is not None:
                    formula = f.text
                    if f.get("t") == "shared":
                        if formula:
                            shared[f.get("si")] = (formula, at, col)
                        elif f.get("si") in shared:
                            first, r0, c0 = shared[f.get("si")]
                            formula = shift_formula(first, at - r0, col - c0)
                value = parts["v"].text if "v" in parts else None
                kind = c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                elif kind == "s" and value is not None:
                    value = strings[int(value)]
                if value is None and formula is None:
                    continue
                text = value if kind in ("s", "str", "inlineStr", "e", "d") else None
                number = float(value) if kind == "n" and value is not None else None
                logical = value == "1" if kind == "b" and value is not None else None
                said = "string" if text is not None else "number" if number is not None else "bool" if logical is not None else "empty"
                yield name, sheet.get("name"), at, col, said, number, text, logical, formula


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _workbook, CELLS)


def _runs(e) -> str:
    out = []
    for x in e.iter():
        if _tag(x) in ("t", "delText"):
            out.append(x.text or "")
        elif _tag(x) in ("tab", "br"):
            out.append("\t" if _tag(x) == "tab" else "\n")
    return "".join(out)


def _document(name, z):
    body = next(e for e in _xml(z, _main_part(z)).iter() if _tag(e) == "body")
    for pos, e in enumerate(body):
        if _tag(e) == "p":
            style = next((_attr(x, "val") or "" for x in e.iter() if _tag(x) == "pStyle"), "")
            outline = next((int(_attr(x, "val") or 0) + 1 for x in e.iter() if _tag(x) == "outlineLvl"), None)
            heading = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            level = int(heading[1]) if heading else outline
            listed = any(_tag(x) == "numPr" for x in e.iter())
            broken = any(_tag(x) == "br" and _attr(x, "type") == "page" for x in e.iter())
            kind = "heading" if level else "list" if listed else "page_break" if broken and not _runs(e).strip() else "quote" if style.lower() == "quote" else "paragraph"
            yield name, 1, pos, kind, level, _runs(e), None
        elif _tag(e) == "tbl":
            rows = [["\n".join(_runs(p) for p in c if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
            yield name, 1, pos, "table", None, None, rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _document, BLOCKS)


_POINT = 12700.0


def _deck(name, z):
    deck = _main_part(z)
    relations = _relations(z, deck)
    slides = [relations[_relation(e)][1] for e in _xml(z, deck).iter() if _tag(e) == "sldId" and _relation(e) in relations]
    slides = [s for s in slides if s in z.namelist()]
    for number, part in enumerate(slides, 1):
        pos = 0
        for e in _xml(z, part).iter():
            if _tag(e) not in ("sp", "pic", "graphicFrame", "cxnSp"):
                continue
            pos += 1
            label = next((x.get("name") for x in e.iter() if _tag(x) == "cNvPr"), None)
            off, ext = (next((x for x in e.iter() if _tag(x) == t and x.get(a)), None) for t, a in (("off", "x"), ("ext", "cx")))
            box = [float(off.get("x")) / _POINT, float(off.get("y")) / _POINT] if off is not None else [None, None]
            box += [float(ext.get("cx")) / _POINT, float(ext.get("cy")) / _POINT] if ext is not None else [None, None]
            kind = {"pic": "image", "cxnSp": "line", "sp": "text"}.get(_tag(e)) or ("table" if any(_tag(x) == "tbl" for x in e.iter()) else "chart")
            text = "\n".join(_runs(p) for p in e.iter() if _tag(p) == "p")
            yield (name, number, pos, kind, label, text, *box)


def read_decks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _deck, ELEMENTS)
