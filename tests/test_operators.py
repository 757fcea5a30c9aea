"""Operators and sources on small inputs."""

import hashlib
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica import queries  # noqa: F401  (registers)
from lattica.operators import edits, formats, layout, lookup, markdown, quality, rows, specs, text, windows
from lattica.operators.criteria import criterion
from lattica.plans.workbook import evaluate, template
from lattica.registry import QUERIES
from lattica.sources import delimited, packages, products
from lattica.streaming import events


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_criteria(spark):
    df = spark.createDataFrame([(1.0, "a"), (10.0, "B*"), (None, ""), (9.0, None), (2.0, "ab")], "x double, s string")
    hits = lambda c, crit: [r[0] for r in df.select(F.coalesce(criterion(df, c, crit), F.lit(False))).collect()]
    assert hits("x", ">=9") == [False, True, False, True, False]
    assert hits("x", "10") == hits("x", 10) == [False, True, False, False, False]
    assert hits("x", "<>1") == [False, True, True, True, True]
    assert hits("x", "<>a") == [True, True, False, True, True]
    assert hits("x", "") == [False, False, True, False, False]
    assert hits("s", "A*") == [True, False, False, False, True]
    assert hits("s", "b~*") == [False, True, False, False, False]
    assert hits("s", ">=b") == [False, True, False, False, False]
    assert hits("s", "<>") == [True, True, False, False, True]


def test_sanitizers(spark):
    got = one(spark, text.content_sanitize(F.lit("a\x00b​cﬁＡ　­\tz")), text.private_use_count(F.lit("x")))
    assert got == ("abcfiA \tz", 2)
    code = "x&sup;² &amp;lt; &#65;&#x4e2d; \\u0041 H₂O ×… “q” &#xD800;"
    assert one(spark, text.code_sanitize(F.lit(code)))[0] == 'x&sup;<super>2</super> < A中 A H<sub>2</sub>O x... "q" &#xD800;'
    assert one(spark, text.kangxi_fixed(F.lit("⼀x⾕")), text.has_cjk(F.lit("a中"))) == ("一x谷", True)


def test_recognisers(spark):
    lines = ["• one", "1. two", "12) three", "(3) four", "-", "5.", "plain", "1.5 million", "(abcd) no"]
    got = [one(spark, text.list_item(F.lit(x)))[0] for x in lines]
    assert got == ["one", "two", "three", "four", "", "", None, None, None]
    assert [one(spark, text.heading_level(F.lit(x)))[0] for x in ("## b", "1.2.3 Name", "none")] == [2, 3, None]
    entry = one(spark, text.toc_entry(F.lit("Intro ..... 12")))[0]
    assert (entry["title"], entry["page"]) == ("Intro", 12)
    caesar = "".join(chr((ord(c) - 97 + 1) % 26 + 97) if c.isalpha() else c for c in "every reader sees a sentence like this one here")
    assert one(spark, *(text.is_garbled(F.lit(x)) for x in ("xkcd zzz bcdf ghjk lmnp qrst vwxz bcd", "plain english text is full of vowels indeed", "xz", caesar)))[:3] == (True, False, False)
    reasons = one(spark, text.complexity(F.lit("x" * 25), F.lit(0.01), F.lit(0.5), F.lit(True)))[0]
    assert reasons == ["scanned", "embedded_images"]
    assert one(spark, text.intent(F.lit("Annual report on sustainability")), text.intent(F.lit("x")))== ("neutral", "neutral")
    assert one(spark, text.contrast(F.lit("#000000"), F.lit("ffffff")))[0] == pytest.approx(21)


def test_suggestions(spark):
    words = spark.createDataFrame([("fontsize",), ("bol",), ("unrelated word",), (None,)], "w string")
    names = spark.createDataFrame([("font_size", 1), ("bold", 2), ("italic", 3)], "n string, o int")
    got = {r["w"]: r["suggestion"] for r in text.did_you_mean(words, "w", names, "n", "o").collect()}
    assert got == {"fontsize": "font_size", "bol": "bold", "unrelated word": None, None: None}


def test_suggestions_are_the_nearest_of_all(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abcX") for _ in range(rng.randrange(1, 13)))
    names, words = sorted({make() for _ in range(150)} | {"xy", "wxyz"}), sorted({make() for _ in range(100)} | {"ab", "", "q"})
    want = {}
    for w in words:
        near = [(distance(w.lower(), c.lower()), k, c) for k, c in enumerate(names) if distance(w.lower(), c.lower()) <= max(len(w) // 3, 2)]
        want[w] = min(near)[2] if near else None
    df, vocabulary = spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(c, k) for k, c in enumerate(names)], "n string, o int")
    assert {r["w"]: r["suggestion"] for r in text.did_you_mean(df, "w", vocabulary, "n", "o").collect()} == want


def test_toc_and_findings(spark):
    entries = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (2, 1, 4), (2, 2, 4), (3, 1, 9), (3, 2, 2)], "doc int, nr int, page int")
    got = {r["doc"]: (r["all_same"], r["non_monotonic"]) for r in text.toc_findings(entries, "doc", "nr", "page").collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True)}
    lines = spark.createDataFrame([(1, "，bad"), (1, "fine"), (2, "bad（ ")], "page int, t string")
    assert {tuple(r) for r in text.line_findings(lines, "page", "t").collect()} == {("/page[1]", "warning", "line starts with ，"), ("/page[2]", "warning", "line ends with （")}
    pages = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0, 0.0, 600.0, 800.0), (2, 9, 0, -9.0, 10.0, 500.0, 700.0, 600.0, 800.0), (3, 9, 0, 100.0, 10.0, 590.0, 700.0, 600.0, 800.0)], "page int, chars int, images int, x1 double, y1 double, x2 double, y2 double, width double, height double")
    assert {(r["path"], r["message"]) for r in quality.page_findings(pages).collect()} == {("/page[1]", "blank page"), ("/page[2]", "content overflows"), ("/page[3]", "margins differ")}
    boxes = spark.createDataFrame([(1, "/a", "A", -1.0, 0.0, 5.0, 5.0), (1, "/b", "a", 0.0, 0.0, 0.0, 5.0)], "page int, path string, name string, x double, y double, w double, h double")
    assert {(r["path"], r["message"]) for r in quality.elements(boxes, 100, 100).collect()} == {("/a", "outside the page"), ("/b", "no size"), ("/a", "duplicate name a")}


def test_formats(spark):
    cases = [
        (1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0;(#,##0)", "(1,235)"), (0.0, '0;-0;"none"', "none"), (0.256, "0.0%", "25.6%"), (5.0, "000", "005"), (1234567.0, '0.0,,"M"', "1.2M"), (2.5, "0", "3"), (-2.5, "0", "-3"), (1.5, "0.##", "1.5"),
        (1.0, "0.##", "1"), (3.0, '"n="0', "n=3"), (0.5, "#.00", ".50"), (45000.75, "yyyy-mm-dd hh:mm", "2023-03-15 18:00"), (45000.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm", "36:00"), (7.0, "General", "7"), (7.25, "General", "7.25"),
    ]
    got = one(spark, *(formats.format_number(F.lit(x), f) for x, f, _ in cases))
    assert list(got) == [w for *_, w in cases]
    assert one(spark, formats.format_number(F.lit(1.0), "# ?/?"))[0] is None
    assert formats.is_date_format("yyyy-mm-dd") and formats.is_date_format("mmm") and not formats.is_date_format('0.00 "day"') and formats.has_time_format("h:mm")
    assert formats.sections(r'0;"a;b";\;') == ["0", '"a;b"', r"\;"]


def test_template_fill(spark):
    data = json.dumps({"a": {"b": "x", "n": None, "l": [1, 2]}, "k": 3})
    df = spark.createDataFrame([("{{a.b}}-{{ k }}-{{a.n}}-{{a.l}}-{{no}}-{{a.no}}{{", data), ("plain", data), (None, data)], "t string, d string")
    made, hits = lookup.fill_template(df, "t", "d")
    assert [tuple(r)[0] for r in df.select(made).collect()][:2] == ["x-3--[1,2]-{{no}}-{{a.no}}{{", "plain"]
    assert df.select(hits.alias("h")).first()["h"] == 4


def test_edits(spark):
    state = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "path string, v string, w string")
    steps = [(1, "set", "a", {"w": "y"}), (2, "remove", "b", {}), (3, "add", "c", {"v": "3"}), (4, "set", "c", {"v": "4"}), (5, "set", "zz", {"v": "9"}), (6, "add", "b", {}), (7, "set", "b", {"w": "q"}), (8, "jump", "a", {})]
    log = spark.createDataFrame(steps, edits.STEPS)
    got = {r["path"]: (r["v"], r["w"]) for r in edits.apply_steps(state, "path", ["v", "w"], log).collect()}
    assert got == {"a": ("1", "y"), "b": (None, "q"), "c": ("4", None)}
    report = {r["idx"]: (r["ok"], r["message"]) for r in edits.replay_report(state, "path", log).collect()}
    assert report[4] == (True, None) and report[5] == (False, "no such path zz") and report[6] == (False, "skipped")
    forced = {r["idx"]: r["ok"] for r in edits.replay_report(state, "path", log, force=True).collect()}
    assert forced == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}


def items(spark, lines, size=10.0):
    """(y, [(x, text), ...]) to items, six points a letter."""
    made, n = [], 0
    for y, words in lines:
        for x, word in words:
            made.append((1, 1, n, float(x), x + 6.0 * len(word), float(y), size, word))
            n += 1
    return spark.createDataFrame(made, "doc_id int, page int, item int, x double, end_x double, y double, size double, text string")


def test_layout(spark):
    page = items(spark, [(700, [(72, "Name"), (200, "Age")]), (686, [(72, "Al"), (200, "30")]), (672, [(72, "Bo"), (200, "25")]), (640, [(72, "Some"), (99, "text")])])
    cells = layout.line_cells(layout.lines(page))
    found = layout.tables(cells).collect()
    assert [(r["first"], r["last"], r["columns"], r["rows"]) for r in found] == [(1, 3, 2, [["Name", "Age"], ["Al", "30"], ["Bo", "25"]])]
    assert [r["text"] for r in cells.where("line = 4").collect()] == ["Some text"]
    assert {r["line"]: r["block"] for r in layout.blocks(layout.line_text(cells)).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert layout.projected(cells).where("line = 1").first()["text"].split() == ["Name", "Age"]
    twice = page.unionByName(page.where("item = 0").withColumn("item", F.lit(99)))
    assert layout.overlaps(twice).count() == page.count()
    assert layout.body_size(page, ["doc_id"]).first()["body_size"] == 10.0


def test_two_columns(spark):
    kind = "doc_id int, page int, line int, x double, end_x double, y double, size double"

    def regions(lines):
        return {r["line"]: r["region"] for r in layout.xy_cut(spark.createDataFrame(lines, kind)).collect()}

    two = lambda end: [(1, 1, k + 12 * side, 72.0 + 268 * side, end + 268 * side, 700.0 - 14 * k, 12.0) for side in (0, 1) for k in range(12)]
    got = regions(two(180.0))
    assert {got[k] for k in range(12)} == {0} and {got[k] for k in range(12, 24)} == {1}
    assert set(regions(two(300.0)).values()) == {0}  # the left margin is the widest empty strip, and nothing lies before it
    spread = [(1, 1, k, 10.0 + 300 * (k % 2), 200.0 + 300 * (k % 2), 700.0 - 14 * (k // 2) - (100 if k >= 8 else 0), 12.0) for k in range(16)]
    got = regions(spread)
    assert [got[k] for k in range(16)] == [0, 2] * 4 + [1, 3] * 4


def test_table_runs_lose_their_leading_rows(spark):
    counts = [1, 3, 2, 2, 2, 1, 2, 3, 1, 2, 2]
    cells = [(1, 1, n, k, 10.0 * k, 10.0 * k + 5, 700.0 - 14 * n, 10.0, f"{n}.{k}") for n, c in enumerate(counts) for k in range(c)]
    df = spark.createDataFrame(cells, "doc_id int, page int, line int, cell int, x double, end_x double, y double, size double, text string")
    assert sorted((r["first"], r["last"], r["columns"], r["table"]) for r in layout.tables(df).collect()) == [(2, 4, 2, 1), (9, 10, 2, 2)]


def test_widths_and_radicals(spark):
    got = one(spark, text.width_em(F.lit("il f mM QZ 7 a é 中")), text.kangxi_fixed(F.lit("⼀x⾕⺁⻲")))
    assert got[0] == pytest.approx(2 * 0.28 + 0.36 + 2 * 0.85 + 0.72 + 0.68 + 0.556 + 0.52 + 0.55 + 1 + 7 * 0.28)
    assert got[1] == "一x谷厂亀"


def test_markdown(spark):
    rows_ = F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1\n2")))
    assert one(spark, markdown.table(rows_))[0] == "| a\\|b | c |\n| --- | --- |\n| 1<br>2 |  |"
    blocks = [(1, 0, "heading", 2, "T"), (1, 1, "quote", None, "q\nr"), (1, 2, "code", None, "x"), (1, 3, "list", 2, "i"), (1, 4, "page_break", None, None), (1, 5, "formula", None, "e=m"), (1, 6, "paragraph", None, "")]
    df = spark.createDataFrame(blocks, "doc int, pos int, type string, level int, text string")
    assert markdown.document(df, ["doc"], ["pos"]).first()["text"] == "## T\n\n> q\n> r\n\n```\nx\n```\n\n  - i\n\n---\n\n$e=m$"
    assert one(spark, *(markdown.revised(F.lit("x"), F.lit("del"), m) for m in ("final", "original", "markup"))) == ("", "x", "<del>x</del>")
    kpi = markdown.component(F.lit("kpi"), F.lit("Sales"), F.lit(5.0), F.lit(10.0), F.lit(-1.5))
    assert one(spark, kpi)[0] == "**Sales**: 5 (-1.5)"


def test_windows_and_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 7.0)], "k int, v double")
    assert [r["place"] for r in lookup.with_places(df, "k").orderBy("k").collect()] == [1, 2, 3, 4]
    assert {r["k"] for r in rows.drop(df, "k", -1).collect()} == {1, 2, 3}
    assert {r["k"] for r in rows.drop(df, "k", 0).collect()} == {1, 2, 3, 4}
    assert windows.kth(df.withColumn("g", F.lit(1)), "v", ["g"], 1).first()["value"] == 7.0
    asof = lookup.asof(spark.createDataFrame([(0,), (2,), (None,)], "t int"), "t", df, "k", ["v"])
    assert {r["t"]: r["v_asof"] for r in asof.collect()} == {0: None, 2: None, None: None}
    assert specs.violations(df, "v", "decimal", "greaterThan", 6).count() == 1
    assert specs.violations(df, "v", "list", values=["5.0"], allow_blank=False).count() == 3
    with pytest.raises(ValueError, match="page range"):
        rows.page_spec("3-1")


CELLS = "sheet string, row int, col int, kind string, num double, str string, bool boolean, formula string"


def test_workbook(spark):
    def value(r, c, v):
        kind = "string" if isinstance(v, str) else "number"
        return ("S", r, c, kind, None if kind == "string" else float(v), v if kind == "string" else None, None, None)

    def formula(r, c, f, sheet="S"):
        return (sheet, r, c, "empty", None, None, None, f)

    rows_ = [value(r, 1, r) for r in range(1, 6)] + [formula(r, 2, f"A{r}*2") for r in range(1, 6)]
    rows_ += [formula(1, 3, "SUM(B1:B5)"), formula(2, 3, "C1+1"), formula(1, 4, "SEQUENCE(3)"), value(3, 4, "in the way"), formula(1, 5, 'IF(C2>5,"big","small")&A1'), formula(1, 6, "F2"), formula(2, 6, "F1"), formula(1, 7, "NOPE(1)"), formula(1, 1, "S!C1*2", "Other")]
    values, waiting = evaluate(spark.createDataFrame(rows_, CELLS))
    got = {(r["sheet"], r["row"], r["col"]): r["num"] if r["kind"] == "number" else r["str"] for r in values.collect()}
    assert [got["S", r, 2] for r in range(1, 6)] == [2, 4, 6, 8, 10]
    assert (got["S", 1, 3], got["S", 2, 3], got["Other", 1, 1]) == (30, 31, 60)
    assert (got["S", 1, 4], got["S", 2, 4], got["S", 3, 4]) == (1, 2, "in the way")
    assert got["S", 1, 5] == "big1" and ("S", 1, 7) not in got
    assert {(r["row"], r["col"]) for r in waiting.collect()} == {(1, 6), (2, 6), (1, 7)}  # a cycle, and a name that is not known
    assert template('IF(A1>"B2",SUM(Other!A1:B2))', "S") == ('IF(ref_0>"B2",SUM(ref_1))', [("s", 1, 1, 1, 1), ("other", 1, 1, 2, 2)])


def test_chain_in_reverse_order(spark):
    rows_ = [("S", 3, 2, "number", 1.0, None, None, None)] + [("S", r, 2, "empty", None, None, None, f"B{r + 1}+1") for r in (1, 2)]
    values, waiting = evaluate(spark.createDataFrame(rows_, CELLS))
    assert {r["row"]: r["num"] for r in values.collect()} == {1: 3.0, 2: 2.0, 3: 1.0} and waiting.count() == 0


def test_running_balance_of_any_length(spark):
    """A thousand rows that each add to the one above are one round, whatever else the row needs."""
    n = 1000
    rows_ = [("S", 1, 3, "number", 100.0, None, None, None)]
    for r in range(2, n + 2):
        rows_ += [("S", r, 1, "number", float(r), None, None, None), ("S", r, 2, "empty", None, None, None, f"A{r}*0.5"), ("S", r, 3, "empty", None, None, None, f"C{r - 1}+A{r}-B{r}")]
    rows_ += [("S", 1, 5, "empty", None, None, None, f"SUM(C2:C{n + 1})"), ("S", 5, 6, "number", 1.0, None, None, None)] + [("S", r, 6, "empty", None, None, None, f"F{r - 1}*2") for r in range(6, 12)]
    values, waiting = evaluate(spark.createDataFrame(rows_, CELLS))
    got = {(r["row"], r["col"]): r["num"] for r in values.collect()}
    balance, total = 100.0, 0.0
    for r in range(2, n + 2):
        balance += r - r * 0.5
        total += balance
        assert got[r, 3] == balance
    assert got[1, 5] == pytest.approx(total) and got[11, 6] == 64 and waiting.count() == 0


def test_chains_stop_at_what_is_no_number(spark):
    cells = [("S", 1, 1, "number", 1.0, None, None, None), ("S", 3, 2, "string", None, "x", None, None), ("S", 1, 2, "number", 1.0, None, None, None), ("S", 2, 2, "number", 5.0, None, None, None), ("S", 4, 2, "number", 5.0, None, None, None)]
    cells += [("S", r, 1, "empty", None, None, None, f"A{r - 1}+B{r}") for r in range(2, 5)] + [("S", 2, 4, "empty", None, None, None, "D3+1"), ("S", 3, 4, "empty", None, None, None, "D2+1")]
    values, waiting = evaluate(spark.createDataFrame(cells, CELLS))
    got = {(r["row"], r["col"]): r["num"] for r in values.collect()}
    assert got[2, 1] == 6 and (3, 1) not in got and (4, 1) not in got
    assert {(r["row"], r["col"]) for r in waiting.collect()} == {(2, 4), (3, 4)}


def test_lookups_span_partitions(spark):
    """As-of and places in groups of which one holds most rows, against plain versions; small parts, nulls and ties."""
    import random

    rng = random.Random(2)
    quotes = [(rng.choice([None, "a", "a", "a", "b", "c"]), rng.randrange(60), k) for k in range(120)]
    trades = [(rng.choice([None, "a", "a", "a", "b", "d"]), rng.choice([None, *range(70)]), k) for k in range(200)]
    q, t = spark.createDataFrame(quotes, "g string, k int, v int"), spark.createDataFrame(trades, "g string, t int, id int")

    def best(g, at, grouped):
        known = [(k, -v) for h, k, v in quotes if at is not None and k <= at and (not grouped or h == g)]
        return -max(known)[1] if known else None

    for by in (["g"], None):
        got = {r["id"]: r["v_asof"] for r in lookup.asof(t, "t", q, "k", ["v"], by, "v").collect()}
        assert got == {i: best(g, at, bool(by)) for g, at, i in trades}
    placed = lookup.placed_in_groups(q, ["g"], "k").collect()
    for g in {x[0] for x in quotes}:
        mine = sorted((r["place"], r["k"]) for r in placed if r["g"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted(k for h, k, _ in quotes if h == g)
        assert {r["size"] for r in placed if r["g"] == g} == {len(mine)}


@pytest.mark.parametrize("short", [10_000, 3])
def test_long_reports_by_places(spark, monkeypatch, short):
    monkeypatch.setattr(rows, "SHORT", short)
    monkeypatch.setattr(specs, "SHORT", short)
    df = spark.createDataFrame([(k, float(k * 7 % 23)) for k in range(50)], "k int, v double")
    assert sorted(r["k"] for r in rows.take(df, "k", 9).collect()) == list(range(9))
    assert sorted(r["k"] for r in rows.take(df, "k", -9).collect()) == list(range(41, 50))
    assert sorted(r["k"] for r in rows.drop(df, "k", 45).collect()) == list(range(45, 50)) and rows.drop(df, "k", 99).count() == 0
    values = sorted((k * 7 % 23 for k in range(50)), reverse=True)
    for n, percent, bottom in [(10, False, False), (20, True, False), (10, False, True), (20, True, True), (99, False, False)]:
        edge = (values[::-1] if bottom else values)[min(n // 2 if percent else n, 50) - 1]
        got = {r["k"] for r in specs.top_rule(df, "v", "k", n, percent, bottom).where("hit").collect()}
        assert got == {k for k in range(50) if (k * 7 % 23 <= edge if bottom else k * 7 % 23 >= edge)}


def test_styles_are_inherited_over_twenty_steps(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, "x" if k == 0 else None) for k in range(30)], "id int, up int, f string")
    got = {r["id"]: r["f"] for r in lookup.inherit(chain, "id", "up", ["f"]).collect()}
    assert got == {k: "x" if k <= 20 else None for k in range(30)}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;age\n"Al; ""x""";30\n"two\nlines";true\nBo;\n')
    table = delimited.read_text_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in table.collect()] == [('Al; "x"', "30"), ("two\nlines", "true"), ("Bo", None)]
    cells = {(r["row"], r["col"]): (r["kind"], r["num"], r["str"], r["bool"]) for r in delimited.read_cells(spark, str(tmp_path / "a.csv")).collect()}
    assert cells[1, 1] == ("string", None, "name", None) and cells[2, 2] == ("number", 30.0, None, None) and cells[3, 2] == ("bool", None, None, True)
    assert [delimited.detect_delimiter(x) for x in ("a,b", "a\tb\tc", "a;b", "a|b", "none", "a,b|c")] == [",", "\t", ";", "|", ",", "|"]
    assert {r["column"]: r["width"] for r in delimited.column_widths(table).collect()} == {"name": 11, "age": 8}


def test_products(spark, tmp_path):
    sheet = {"name": "S", "rows": [{"index": 2, "cells": [{"ref": "B2", "value": "x"}, {"value": "7"}, {"value": "007", "type": "string"}]}, {"cells": [{"formula": "A1"}]}]}
    (tmp_path / "sheet1.json").write_text(json.dumps(sheet, indent=1))
    cells = products.read_sheets(spark, str(tmp_path / "*.json"))
    got = {(r["row"], r["col"]): (r["kind"], r["num"], r["str"], r["formula"]) for r in cells.collect()}
    assert got == {(2, 2): ("string", None, "x", None), (2, 3): ("number", 7.0, None, None), (2, 4): ("string", None, "007", None), (3, 1): ("empty", None, None, "A1")}
    products.write_sheets(cells.where("kind <> 'empty'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert json.loads(products.inline(cells.where("kind = 'number'")).first()["json"])["name"] == "S"
    files = spark.createDataFrame([("b.png", b"x"), ("a.png", b"x"), ("c", b"y")], "path string, content binary")
    made = {r["path"]: (r["mime"], r["sources"]) for r in products.manifest(files).collect()}
    assert made == {"a.png": ("image/png", ["a.png", "b.png"]), "c": ("application/octet-stream", ["c"])}


REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
ONE = '<Relationship Id="{}" Type="http://x/{}" Target="{}"/>'


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_packages(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package(
        tmp_path / "a.xlsx",
        {
            "_rels/.rels": REL.format(ONE.format("r1", "officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="urn:r"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": REL.format(ONE.format("r1", "worksheet", "worksheets/sheet1.xml") + ONE.format("r2", "theme", "lost.xml")),
            "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>he</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c><v>5</v></c><c t="b"><v>1</v></c></row><row><c><f t="shared" si="0">C2*$C$2</f><v>25</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c><f t="shared" si="0"/></c></row></sheetData></worksheet>',
        },
    )
    got = {(r["row"], r["col"]): (r["kind"], r["num"], r["str"], r["bool"], r["formula"]) for r in packages.read_workbooks(spark, str(tmp_path / "a.xlsx")).collect()}
    assert got == {
        (2, 2): ("string", None, "ab", None, None), (2, 3): ("number", 5.0, None, None, None), (2, 4): ("bool", None, None, True, None),
        (3, 1): ("number", 25.0, None, None, "C2*$C$2"), (3, 2): ("string", None, "in", None, None), (4, 1): ("empty", None, None, None, "C3*$C$2"),
    }
    assert {r["message"] for r in packages.missing_parts(spark, str(tmp_path / "a.xlsx")).collect()} == {"missing theme xl/lost.xml"}
    assert packages.list_parts(spark, str(tmp_path / "a.xlsx")).count() == 5
    assert b"sst" in packages.read_part(spark, str(tmp_path / "a.xlsx"), "xl/sharedStrings.xml").first()["content"]
    package(
        tmp_path / "a.docx",
        {
            "_rels/.rels": REL.format(ONE.format("r1", "officeDocument", "word/document.xml")),
            "word/document.xml": '<w:document xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>',
        },
    )
    blocks = packages.read_documents(spark, str(tmp_path / "a.docx")).orderBy("pos").collect()
    assert [(b["type"], b["level"], b["text"], b["rows"]) for b in blocks] == [("heading", 2, "Title", None), ("paragraph", None, "a\tb", None), ("table", None, None, [["1", ""]])]
    package(
        tmp_path / "a.pptx",
        {
            "_rels/.rels": REL.format(ONE.format("r1", "officeDocument", "ppt/presentation.xml")),
            "ppt/presentation.xml": '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst><p:sldId id="1" r:id="r9"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": REL.format(ONE.format("r9", "slide", "slides/slide1.xml")),
            "ppt/slides/slide1.xml": '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:cNvPr name="Box"/><a:off x="12700" y="25400"/><a:ext cx="127000" cy="12700"/><a:p><a:t>Hi</a:t></a:p></p:sp></p:sld>',
        },
    )
    shape = packages.read_decks(spark, str(tmp_path / "a.pptx")).first()
    assert (shape["slide"], shape["type"], shape["name"], shape["text"], shape["x"], shape["y"], shape["w"], shape["h"]) == (1, "text", "Box", "Hi", 1.0, 2.0, 10.0, 1.0)
    (tmp_path / "bad.xlsx").write_text("no package")
    assert packages.read_workbooks(spark, str(tmp_path / "bad.xlsx")).count() == 0


def test_streams(spark, tmp_path):
    rows_ = [(k, k % 3, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows_, "k long, user long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") * 60))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), df.schema, 3)
    made = events.windowed(stream, "ts", "10 minutes", ["user"], "value")
    q = made.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = events.windowed(df, "ts", "10 minutes", ["user"], "value")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
    q = events.running_state(stream, "user", "value", "ts").writeStream.format("memory").queryName("r").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["user"]: r["t"] for r in spark.table("r").groupBy("user").agg(F.max("total").alias("t")).collect()} == {u: float(sum(k for k in range(60) if k % 3 == u)) for u in range(3)}
    assert events.session_windows(df, "ts", "5 minutes", ["user"], "value").count() == 3


def test_replayed_stream(spark, tmp_path):
    steps = spark.createDataFrame([(1, "add", "a", {"v": "1"}), (2, "set", "a", {"v": "2"}), (3, "add", "b", {"v": "3"})], edits.STEPS)
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    stream = events.read_events(spark, str(tmp_path / "steps"), steps.schema)
    q = events.replay(stream, str(tmp_path / "state"), "path", ["v"], str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r["path"]: r["v"] for r in spark.read.parquet(str(tmp_path / "state/version=0")).collect()} == {"a": "2", "b": "3"}


def _code_sanitized(raw):
    """The rules of code_sanitize, plainly."""
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "mdash": "—", "ndash": "–", "hellip": "…", "bull": "•", "copy": "©", "reg": "®", "trade": "™", "times": "×", "divide": "÷", "plusmn": "±", "deg": "°", "micro": "µ", "para": "¶", "sect": "§", "middot": "·", "laquo": "«", "raquo": "»"}
    for k, v in names.items():
        raw = raw.replace(f"&{k};", v)
    point = lambda m, n: chr(n) if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]
    raw = re.sub("&#[xX]([0-9A-Fa-f]{1,6});", lambda m: point(m, int(m[1], 16)), raw)
    raw = re.sub("&#([0-9]{1,7});", lambda m: point(m, int(m[1])), raw)
    raw = re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: point(m, int(m[1], 16)), raw)
    for tag, odd, plain in (("super", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"), ("sub", "₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-")):
        raw = re.sub(f"[{odd}]+", lambda m: f"<{tag}>{m[0].translate(str.maketrans(odd, plain))}</{tag}>", raw)  # noqa: B023
    for a, b in zip("‘’“”–—…×≥≤≠≈∞−±∧∨·", ["'", "'", '"', '"', "-", "--", "...", "x", ">=", "<=", "!=", "~=", "inf", "-", "+/-", "AND", "OR", "-"], strict=True):
        raw = raw.replace(a, b)
    return raw


def test_code_sanitize_covers_all_pages(spark, tmp_path):
    from lattica.queries import _REFERENCES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = [(-1, None), (-2, ""), (-3, r"x&sup;² &lt; &#65;&#x4e2d; H₂O&times;… \u0041 &#xD800;"), (-4, "‘a’ &amp;copy; ≥≤≠≈∞−±∧∨·")]
    pages = pages.select("page_id", "html").union(spark.createDataFrame(odd, "page_id long, html string"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    want = {r["page_id"]: None if r["html"] is None else hashlib.sha256(_code_sanitized(_REFERENCES + r["html"]).encode()).hexdigest() for r in pages.collect()}
    got = {r["page_id"]: r["sha"] for r in QUERIES["code_sanitize"](spark, str(tmp_path)).collect()}
    assert len(want) == 54 and got == want


def test_matrix_gram_reads_all_vectors(spark, tmp_path):
    vectors = [(k, [float(k), 1.0, -2.0]) for k in range(100)] + [(100, None), (101, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["row"], r["col"]): r["value"] for r in QUERIES["matrix_gram"](spark, str(tmp_path)).collect()}
    s1, s2 = sum(range(100)), sum(k * k for k in range(100))
    assert got == {(0, 0): s2, (0, 1): s1, (1, 0): s1, (0, 2): -2 * s1, (2, 0): -2 * s1, (1, 1): 100, (1, 2): -200, (2, 1): -200, (2, 2): 400}
