"""Text hygiene and recognisers, as regular expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes of the audit, fixed values (Java regular-expression classes).
CLASSES = {
    "replacement_char": r"\x{FFFD}",
    "control": r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{80}-\x{9F}",
    "zero_width": r"\x{200B}-\x{200D}\x{FEFF}\x{2060}",
    "bidi_control": r"\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}",
    "variation_selector": r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}",
    "private_use": r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}",
}
NON_CHARACTERS = r"\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}"
#: Ligatures and their letters, fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
#: Named HTML entities, fixed values, in the order in which they are decoded.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–",
    "&hellip;": "…", "&bull;": "•", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&times;": "×", "&divide;": "÷", "&plusmn;": "±",
    "&deg;": "°", "&micro;": "µ", "&para;": "¶", "&sect;": "§", "&middot;": "·", "&laquo;": "«", "&raquo;": "»",
}
#: Superscripts and subscripts with their plain characters, and safe spellings of symbols; fixed values.
SUPER = ("¹²³⁰⁴⁵⁶⁷⁸⁹⁺⁻", "1230456789+-")
SUB = ("₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-")
SYMBOLS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "×": "x", "≥": ">=", "≤": "<=", "≠": "!=", "≈": "~=", "∞": "inf", "−": "-", "±": "+/-", "∧": "AND", "∨": "OR", "·": "-"}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def _regexp_replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def private_use_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CLASSES['private_use']}]"))


def content_sanitize(text: Column) -> Column:
    """Without invisible, private and non-characters; ligatures spelt out, full-width forms as ASCII."""
    drop = "".join(CLASSES[k] for k in ("control", "zero_width", "bidi_control", "variation_selector", "private_use"))
    text = _regexp_replace(text, f"[{drop}{NON_CHARACTERS}\\x{{AD}}]")
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.translate(_replaced(text, LIGATURES), full, plain)


def _code_point(digits: Column, radix: int) -> Column:
    n = F.conv(digits, radix, 10).cast("long")
    return F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _decoded(text: Column, pattern: str, value) -> Column:
    """Every match of pattern replaced by value(match), or left where that is null."""
    marks, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    made = F.zip_with(gaps, F.transform(marks, lambda m: F.coalesce(value(m), m)), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.size(marks) > 0, F.array_join(made, "")).otherwise(text)


def code_sanitize(text: Column) -> Column:
    """Entities and \\uXXXX decoded, super- and subscripts in tags, symbols in safe spelling."""
    text = _replaced(text, ENTITIES)
    text = _decoded(text, r"&#[xX][0-9A-Fa-f]{1,6};", lambda m: _code_point(F.regexp_extract(m, r"&#[xX]([0-9A-Fa-f]+);", 1), 16))
    text = _decoded(text, r"&#[0-9]{1,7};", lambda m: _code_point(F.regexp_extract(m, r"([0-9]+)", 1), 10))
    text = _decoded(text, r"\\u[0-9A-Fa-f]{4}", lambda m: _code_point(F.substring(m, 3, 4), 16))
    text = F.translate(_regexp_replace(text, f"([{SUPER[0]}]+)", "<super>$1</super>"), *SUPER)
    text = F.translate(_regexp_replace(text, f"([{SUB[0]}]+)", "<sub>$1</sub>"), *SUB)
    return _replaced(text, SYMBOLS)


def audit(df: DataFrame, text: str, page: str) -> DataFrame:
    """(class, count, pages) of each class of suspect characters that occurs."""
    counts = [F.struct(F.lit(k).alias("class"), F.regexp_count(F.col(text), F.lit(f"[{c}]")).alias("n")) for k, c in CLASSES.items()]
    seen = df.select(page, F.explode(F.array(*counts)).alias("c")).where("c.n > 0")
    return seen.groupBy(F.col("c.class").alias("class")).agg(F.sum("c.n").alias("count"), F.count_distinct(page).alias("pages"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def is_garbled(text: Column) -> Column:
    """At least 30 Latin letters of which under a fifth are vowels."""
    n = letters(text)
    return F.coalesce((n >= 30) & (F.length(F.regexp_replace(text, "[^AEIOUaeiou]", "")) / n < 0.2), F.lit(False))


def complexity(text: Column, coverage: Column, image_share: Column, full_image: Column) -> Column:
    """Why a page may need recognition of images, as an array of reasons."""
    n = F.length(F.coalesce(text, F.lit("")))
    first = F.when(n < 20, "no_text").when(full_image & (n < 60), "scanned").when((n < 400) & (coverage < 0.05), "sparse_text")
    images = F.when((image_share > 0.25) | full_image, "embedded_images")
    return F.array_compact(F.array(first, images, F.when(is_garbled(F.coalesce(text, F.lit(""))), "garbled")))


def needs_ocr(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(F.lit("no_text"), F.lit("scanned"), F.lit("garbled")))


#: Radicals, Han, kana and their punctuation, compatibility forms and full-width forms; fixed values.
CJK = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}"
#: Punctuation that may not begin or end a line, fixed values.
NOT_FIRST = "，。、；：！？）》」』】〉”’"
NOT_LAST = "（《「『【〈“‘"


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


#: Radicals of the supplement block and the characters that they stand for, fixed values: code point, character.
RADICALS = """
2E81厂 2E85亻 2E88刂 2E8A卜 2E8C小 2E8D小 2E92巳 2E93糸 2E96忄 2E98手 2E9C日 2E9D月
2EA0民 2EA1氵 2EA3火 2EA7牛 2EA8犭 2EA9王 2EAB目 2EAE竹 2EAF糸 2EB0纟 2EB1罒 2EB6羊
2EB9老 2EBC肉 2EBE艹 2EBF艹 2EC0艹 2EC1虎 2EC2衤 2EC3西 2EC4西 2EC5见 2EC6角 2EC7角
2EC8讠 2EC9贝 2ECA足 2ECB车 2ECC辶 2ECD辶 2ECF阝 2ED0钅 2ED1長 2ED3长 2ED4门 2ED5阝
2ED6阝 2ED7雨 2ED8青 2ED9韦 2EDA页 2EDB风 2EDC飞 2EDD食 2EE0饣 2EE1页 2EE2马 2EE4鬼
2EE5鱼 2EE6鸟 2EE7卤 2EE8麦 2EE9黄 2EEA黾 2EEB斉 2EEC齐 2EED歯 2EEE齿 2EEF竜 2EF0龙
2EF1龟 2EF2亀
"""


def kangxi_fixed(text: Column) -> Column:
    """Radicals as the unified characters that they stand for: the supplement by RADICALS, the Kangxi block by NFKC.

    Applied only to those blocks; each is one character in and one out.
    """
    import unicodedata

    table = {chr(int(x[:4], 16)): x[4:] for x in RADICALS.split()}
    table |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2F00, 0x2FD6)}
    return F.translate(text, "".join(table), "".join(table.values()))


#: Widths of Latin characters in ems, fixed values; the first class that holds a character counts.
WIDTHS = [
    (r"ijl!'|.,:;\x20", 0.28),
    (r"ftr()\[\]\-/", 0.36),
    (r"mMWw@%", 0.85),
    (r"QOGDUHNBRKX", 0.72),
    (r"A-Z", 0.68),
    (r"0-9", 0.556),
    (r"a-z", 0.52),
]
WIDTH_OF_OTHERS = 0.55


def width_em(text: Column) -> Column:
    """An estimate of a text's width in ems: CJK 1, Latin by WIDTHS, others WIDTH_OF_OTHERS."""
    taken, rest = CJK, F.length(text)
    made = F.regexp_count(text, F.lit(f"[{CJK}]"))
    rest = rest - made
    for chars, width in WIDTHS:
        n = F.regexp_count(text, F.lit(f"[{chars}&&[^{taken}]]"))
        made, rest, taken = made + n * width, rest - n, taken + chars
    return made + rest * WIDTH_OF_OTHERS


def line_findings(lines: DataFrame, page: str, text: str) -> DataFrame:
    """(path, severity, message) for lines that begin or end with punctuation that may not stand there."""
    t = F.rtrim(F.col(text))
    first, last = F.left(t, F.lit(1)), F.right(t, F.lit(1))
    found = F.array_compact(
        F.array(
            F.when((t != "") & first.isin(*NOT_FIRST), F.concat(F.lit("line starts with "), first)),
            F.when((t != "") & last.isin(*NOT_LAST), F.concat(F.lit("line ends with "), last)),
        )
    )
    return lines.select(F.concat(F.lit("/page["), F.col(page).cast("string"), F.lit("]")).alias("path"), F.lit("warning").alias("severity"), F.explode(found).alias("message"))


#: Words that speak for an intent, fixed values (Latin ones).
INTENTS = {
    "nature": ["eco", "sustainability", "forest"],
    "neutral": ["report", "finance", "annual", "corporate"],
    "energy": ["marketing", "social", "campaign", "launch"],
    "authority": ["luxury", "fashion", "premium", "gala", "formal", "professional", "government", "bidding", "thesis", "dissertation", "proposal"],
    "calm": ["health", "meditation", "wellness", "calm", "minimalist", "simple"],
    "tension": ["urgent", "warning", "alert", "crisis"],
    "warmth": ["food", "lifestyle", "home"],
}


def intent(text: Column, table: dict[str, list[str]] = INTENTS) -> Column:
    """The intent of which most words occur; ties prefer any to neutral, then the alphabet; none is neutral."""
    low = F.lower(text)
    scores = [F.struct(sum((low.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(int(k != "neutral")).alias("own"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(sorted(table.items()))]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["k"]).otherwise("neutral")


BULLETS = "•·●■□○◦"


def list_item(line: Column) -> Column:
    """The text of a list item (a bullet, dash, 1. 1) or (1) before it), else null; a lone marker gives ""."""
    t = F.btrim(line, F.lit(" \t\r\n"))
    lone = t.rlike(rf"^(?:[{BULLETS}-]|[0-9]{{1,3}}[.)])$")
    marked = rf"^(?:[{BULLETS}-]|[0-9]{{1,3}}[.)]|\([^)]{{1,3}}\)) +"
    return F.when(lone, "").when(t.rlike(marked), F.btrim(F.regexp_replace(t, marked, "")))


def heading_level(line: Column) -> Column:
    """The level of a Markdown heading, or of a numbered title such as 1.2.3 Name."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    numbers = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\p{L}", 1)
    return F.when(marks > 0, marks).when(numbers != "", F.size(F.split(numbers, r"\.")))


def toc_entry(line: Column) -> Column:
    """struct(title, page) of a line such as `Name .... 12`, else null."""
    t = F.regexp_replace(F.btrim(line), r"[. ·…]+$", "")
    title, page = F.regexp_extract(t, r"^(.*?\D)[. ·…]*?([0-9]+)$", 1), F.regexp_extract(t, r"([0-9]+)$", 1)
    title = F.btrim(F.regexp_replace(title, r"[. ·…]+$", ""))
    return F.when((page != "") & (title != "") & (F.length(line) < 120), F.struct(title.alias("title"), page.try_cast("int").alias("page")))


def toc_findings(entries: DataFrame, by: str, order: str, page: str) -> DataFrame:
    """(by, entries, all_same, non_monotonic) of each table of contents."""
    from lattica.operators.windows import previous

    step = entries.withColumn("_back", F.col(page) < previous(page, [by], [order]))
    return step.groupBy(by).agg(F.count("*").alias("entries"), (F.min(page) == F.max(page)).alias("all_same"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("non_monotonic"))


def did_you_mean(df: DataFrame, word: str, candidates: DataFrame, name: str, order: str) -> DataFrame:
    """Adds `suggestion`: the nearest candidate by edit distance without case, within max(2, a third of the word).

    Only candidates that share a piece with the word are compared: the allowed distance splits it into one piece
    more, of which an edit each leaves one whole (pigeonhole). Words too short to be split meet the candidates with
    which they share what is left after two letters are taken out. So no cross join is made at any size.
    """
    a, b = F.lower(F.col(word)), F.lower(F.col("_c"))
    limit = F.greatest(F.floor(F.length(word) / 3), F.lit(2)).cast("int")
    vocabulary = candidates.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_c")).agg(F.min(order).alias("_o"))
    words = df.select(word).where(F.col(word).isNotNull()).distinct()
    pairs = _by_pieces(words.where(F.length(word) > 2), word, limit, vocabulary).unionByName(_by_deletions(words.where(F.length(word) <= 2), word, vocabulary))
    near = pairs.withColumn("_d", F.levenshtein(a, b)).where(F.col("_d") <= limit)
    best = near.groupBy(word).agg(F.min_by("_c", F.struct("_d", "_o")).alias("suggestion"))
    return df.join(best.withColumnRenamed(word, "_w"), F.col(word) == F.col("_w"), "left").drop("_w")


def _left_after(text: Column) -> Column:
    """What is left of a short text after none, one or two of its characters are taken out."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: F.concat(F.call_function("left", t, k - 1), F.call_function("substring", t, k + 1, F.length(t))))
    once = without(text)
    return F.array_distinct(F.concat(F.array(text), once, F.flatten(F.transform(once, without))))


def _by_deletions(words: DataFrame, word: str, vocabulary: DataFrame) -> DataFrame:
    """Pairs that may be within a distance of 2, for words of at most two characters."""
    mine = words.select(word, F.explode(_left_after(F.lower(F.col(word)))).alias("_p"))
    theirs = vocabulary.where(F.length("_c") <= 4).select("_c", "_o", F.explode(_left_after(F.lower(F.col("_c")))).alias("_p"))
    return mine.join(theirs, "_p").select(word, "_c", "_o").distinct()


def _by_pieces(words: DataFrame, word: str, limit: Column, vocabulary: DataFrame) -> DataFrame:
    """Pairs that may be within the limit: limit + 1 pieces of the word, one of which stands in the candidate, moved by at most the limit."""
    low, n = F.lower(F.col(word)), F.length(word)
    size = F.greatest(F.floor(n / (limit + 1)), F.lit(1)).cast("int")
    pieces = words.select(word, limit.alias("_l"), size.alias("_s"), F.posexplode(F.transform(F.sequence(F.lit(0), limit), lambda k: F.call_function("substring", low, k * size + 1, size))).alias("_k", "_p"))
    sizes = F.array(F.lit(1), F.lit(2))  # a third of the word as the limit makes pieces of one or two characters
    spots = vocabulary.select("_c", "_o", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_c"), F.lit(1)))).alias("_at")).select("*", F.explode(sizes).alias("_s"))
    grams = spots.select("_c", "_o", "_at", "_s", F.call_function("substring", F.lower("_c"), F.col("_at"), F.col("_s")).alias("_p"))
    met = pieces.join(grams, ["_p", "_s"]).where(F.abs(F.col("_at") - 1 - F.col("_k") * F.col("_s")) <= F.col("_l"))
    return met.select(word, "_c", "_o").distinct()


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio of two RRGGBB colours."""

    def light(c):
        parts = [F.conv(F.substring(F.translate(c, "#", ""), k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5)]
        linear = [F.when(p <= 0.03928, p / 12.92).otherwise(F.pow((p + 0.055) / 1.055, 2.4)) for p in parts]
        return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]

    x, y = light(a), light(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
