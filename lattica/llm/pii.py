"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans of four kinds; the strict pattern's valid matches are the base. Three
labelers vote on each proposal (for, against, or not at all): the pattern's own validity check, a
gazetteer (domains, issuers, calling codes, address ranges) and the words before the span. Votes are
counted by kind and pattern of votes, which gives a table of at most 4 * 27 rows at any size of
input; on that table expectation-maximisation estimates how reliable each labeler is on each kind,
and a logistic span classifier is trained on the votes, weighted by the estimated truth. It is
applied as a Column. Loose proposals that it accepts, and that touch no base span, are added.

No Python runs on the executors. Positions count code points; a document's own matches are numbered
by a window over that document. Nulls: a null text has no spans; ids may be null or repeat, each row
gets a row. An empty table gives an empty result. Texts are whole at any length; the patterns are
written so that no run of characters is read twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Stage

KINDS = ("email", "ip", "card", "phone")

#: Strict patterns. A run of a local part or of digits is entered at its start or where the last
#: match ended, and never given back, which finds what the plain pattern finds in linear time.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

#: Loose patterns: further ways to write the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDS = {"email": r"[\[(](?:at|AT)[\])]", "phone": r"[0-9]{3}[.-][0-9]{4}"}

#: Gazetteer, fixed values: common endings of domains, issuers' first digits, calling codes.
ENDINGS = "com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl pt se no dk fi ie ru cn jp kr in br mx ca au nz za"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64|35|62)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-8]|38[0-9]|42[013]|85[0-9]|88[06]|96[0-8]|97[0-9]|99[2-8])"

#: Words before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": r"(?:e-?mail|mailto|contact|write|reach|@)",
    "ip": r"(?:\bip\b|address|host|server|login|from)",
    "card": r"(?:card|visa|master|amex|credit|payment)",
    "phone": r"(?:phone|call|tel\b|mobile|fax|cell|contact)",
}
AGAINST = r"(?:version|licen[cs]e|release|isbn|section|chapter|order|serial|part)\W*$"
CONTEXT = 32
ACCEPT = 0.9


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: Column, s: Column) -> Column:
    digits = F.length(_digits(s))
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", s.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(kind == "card", digits.between(13, 19) & F.call_function("luhn_check", _digits(s)))
        .otherwise(digits.between(9, 15))
    )


def _matches(text: Column, kind: str, pattern: str, needs: str, loose: bool) -> Column:
    """array<struct(kind, loose, gap, match, before)>: gap is the number of code points since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda gap, match: F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), F.length(gap).alias("gap"), match.alias("match"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("before")),
    )
    possible = text.contains("@") if needs == "@" else text.rlike(needs)
    none = F.array().cast("array<struct<kind:string,loose:boolean,gap:int,match:string,before:string>>")
    return F.when(possible, rows).otherwise(none)


def proposals(docs: DataFrame, key: list[Column], text: str = "text") -> DataFrame:
    """Every match, with its place; a row without any match stays as one row of nulls."""
    text = F.coalesce(F.col(text), F.lit(""))
    found = [_matches(text, k, STRICT[k], NEEDS[k], False) for k in KINDS] + [_matches(text, k, LOOSE[k], LOOSE_NEEDS[k], True) for k in LOOSE]
    rows = docs.select(*key, F.monotonically_increasing_id().alias("row"), F.concat(*found).alias("found"))
    names = [c for c in rows.columns if c != "found"]
    rows = rows.select(*names, F.posexplode_outer("found").alias("nr", "m"))
    rows = rows.select(*names, "nr", "m.*")
    upto = Window.partitionBy("row", "kind", "loose").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    return rows.withColumn("base", ~F.col("loose") & _valid(F.col("kind"), F.col("match"))).drop("gap", "nr")


def _votes(kind: Column, s: Column, before: Column) -> list[Column]:
    """The three labelers: 1 for, -1 against, 0 no vote."""
    ending = F.lower(F.regexp_extract(s, r"([A-Za-z]+)$", 1))
    first = F.regexp_extract(s, r"^0*([0-9]*)", 1).cast("int")
    rule = F.when(_valid(kind, s), 1).otherwise(-1)
    gazetteer = (
        F.when(kind == "email", F.when(F.array_contains(F.split(F.lit(ENDINGS), " "), ending), 1).otherwise(-1))
        .when(kind == "ip", F.when(first.between(1, 223) & (first != 127), 1).otherwise(-1))
        .when(kind == "card", F.when(_digits(s).rlike(ISSUERS), 1).otherwise(-1))
        .when(s.startswith("+"), F.when(s.rlike(CALLING), 1).otherwise(-1))
        .otherwise(F.when(_digits(s).rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))
    )
    cue = F.lit(False)
    for k in KINDS:
        cue = cue | (kind == k) & before.rlike(CUES[k])
    context = F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    return [rule, gazetteer, context]


# ---------------------------------------------------------------- a bounded table, in plain Python


def estimate(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 50):
    """EM on (kind, votes, count): the truth's probability of each row, and how often each labeler is right.

    Each labeler, where it votes, says the truth with its own chance for each kind and truth.
    Starts from the majority; the counts are smoothed, so that an unseen vote keeps a chance.
    """
    truth = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in table}
    hit: dict = {}
    for _ in range(rounds):
        prior, hit = {}, {}
        for kind in {k for k, _, _ in table}:
            mine = [(v, n) for k, v, n in table if k == kind]
            total = sum(n for _, n in mine)
            prior[kind] = (sum(n * truth[kind, v] for v, n in mine) + 1) / (total + 2)
            for j in range(3):
                for side in (1, -1):
                    p = lambda v, side=side: truth[kind, v] if side == 1 else 1 - truth[kind, v]  # noqa: B023, E731
                    said = sum(n * p(v) for v, n in mine if v[j] == side)
                    voted = sum(n * p(v) for v, n in mine if v[j])
                    hit[kind, j, side] = (said + 4) / (voted + 5)
        for kind, votes, _ in table:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, vote in enumerate(votes):
                if vote:
                    yes = hit[kind, j, 1] if vote == 1 else 1 - hit[kind, j, 1]
                    no = hit[kind, j, -1] if vote == -1 else 1 - hit[kind, j, -1]
                    odds += math.log(yes / no)
            truth[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return truth, hit


def train(table, truth, steps: int = 400) -> dict[str, list[float]]:
    """The span classifier: for each kind a bias and a weight for each labeler's vote."""
    weights = {}
    for kind in {k for k, _, _ in table}:
        mine = [(v, n, truth[k, v]) for k, v, n in table if k == kind]
        total = sum(n for _, n, _ in mine)
        w = [0.0] * 4
        for _ in range(steps):
            g = [0.01 * x for x in w]
            for v, n, y in mine:
                p = 1 / (1 + math.exp(-max(-30, min(30, w[0] + sum(a * b for a, b in zip(w[1:], v, strict=True))))))
                for j, x in enumerate((1, *v)):
                    g[j] += n / total * (p - y) * x
            w = [a - b for a, b in zip(w, g, strict=True)]
        weights[kind] = w
    return weights


def _score(weights: dict[str, list[float]]) -> Column:
    odds = F.lit(-30.0)
    for kind, w in weights.items():
        odds = F.when(F.col("kind") == kind, F.lit(w[0]) + sum(F.lit(x) * F.col(f"v{j}") for j, x in enumerate(w[1:]))).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def find_spans(docs: DataFrame, key: list[Column], text: str = "text") -> DataFrame:
    """(key columns, row, spans) for each row; spans: array<struct(nr of the kind, start, end, base)>, by kind, then start."""
    found = proposals(docs, key, text)
    names = [c for c in found.columns if c not in ("kind", "loose", "match", "before", "end", "start", "base")]
    voted = found.select("*", *(v.alias(f"v{j}") for j, v in enumerate(_votes(F.col("kind"), F.col("match"), F.col("before"))))).drop("match", "before")
    held = Stage(voted, "proposals")
    counted = held.df.where("kind is not null").groupBy("kind", "v0", "v1", "v2").count().collect()  # at most 4 * 27 rows
    table = sorted((r["kind"], (r["v0"], r["v1"], r["v2"]), r["count"]) for r in counted)
    truth, _ = estimate(table)
    scored = held.df.withColumn("accepted", F.col("base") | F.col("loose") & (_score(train(table, truth)) >= ACCEPT))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.when(F.col("accepted"), F.struct(number.alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("base").alias("base")))
    rows = scored.groupBy(*names).agg(F.collect_list(span).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: ~s["base"] & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("spans", F.sort_array(F.concat(base, more)))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; the counts are of base spans."""
    rows = find_spans(docs, [F.col(id).alias("_id")], text)
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return rows.select(F.col("_id").alias(id), *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; spans that overlap are replaced together."""
    whole = F.col(text)
    spans = find_spans(docs, [F.col(id).alias("_id"), F.xxhash64(whole).alias("_hash"), F.length(whole).alias("_size")], text)
    spans = spans.where(F.size("spans") > 0).groupBy("_id", "_hash", "_size").agg(F.first("spans").alias("_spans"))  # equal rows have equal spans
    names = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    held = F.col("_doc")[text]

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        part = F.concat(F.substring(held, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(F.element_at(names, s["kind"])), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(held, acc["at"].cast("int") + 1, F.length(held))))
    key = F.col("_doc")[id].eqNullSafe(F.col("_id")) & (F.xxhash64(held) == F.col("_hash")) & (F.length(held) == F.col("_size"))
    joined = docs.select(F.struct(*docs.columns).alias("_doc")).join(spans, key, "left")
    return joined.select(*(F.when(F.col("_spans").isNotNull(), done).otherwise(held).alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns))
