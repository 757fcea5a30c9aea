"""Number and date formats of cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.dates import from_serial


def sections(fmt: str) -> list[str]:
    """Positive, negative and zero parts; ; in quotes or behind \\ does not split."""
    out, now, quoted, k = [], "", False, 0
    while k < len(fmt):
        c = fmt[k]
        if c == "\\" and k + 1 < len(fmt):
            now += fmt[k : k + 2]
            k += 2
            continue
        quoted ^= c == '"'
        if c == ";" and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
        k += 1
    return [*out, now]


def plain_format(fmt: str) -> str:
    """A format without literals, colours and conditions."""
    return re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", fmt)


def is_date_format(fmt: str) -> bool:
    return bool(re.search(r"[yd]|m{3,}|(?<![#0?.,%])m(?![#0?])", plain_format(fmt).lower())) and not re.search(r"[#0?]", re.sub(r"\.0+", "", plain_format(fmt)))


def has_time_format(fmt: str) -> bool:
    return bool(re.search(r"[hs]", plain_format(fmt).lower())) or bool(re.search(r"\[[hms]+\]", fmt.lower()))


def _literal(text: str) -> str:
    text = re.sub(r"\[[^\]]*\]", "", text)
    text = re.sub(r"_.", " ", re.sub(r"\*.", "", text))
    return re.sub(r"\\(.)", r"\1", text.replace('"', ""))


def _section(x: Column, fmt: str) -> Column | None:
    """One section as an expression, or None where it needs conditions, fractions or text."""
    if re.search(r"\[[<>=]", fmt) or "@" in fmt or re.search(r"[#0?]\s*/\s*[#0?]", fmt) or re.search(r"[eE][+-]", plain_format(fmt)):
        return None
    m = re.search(r"[#0?](?:[#0?,]*[#0?])?(,*)(\.[#0?]+)?(,*)", fmt)
    if not m:
        return F.lit(_literal(fmt))
    before, after = fmt[: m.start()], fmt[m.end() :]
    x = x * 100.0 ** plain_format(fmt).count("%") / 1000.0 ** (len(m[1]) + len(m[3]))
    digits = (m[2] or "")[1:]
    places = len(digits)
    scale = 10.0**places
    x = F.floor(F.abs(x) * scale + 0.5) / scale  # halves away from zero
    made = F.format_number(x, places)
    whole = re.split(r"\.", m[0])[0]
    if "," not in whole.rstrip(","):
        made = F.translate(made, ",", "")
    width = whole.count("0")
    if width > 1:
        made = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(F.regexp_extract(made, r"^([0-9,]*)", 1)), F.lit(0))), made)
    if width == 0:
        made = F.regexp_replace(made, r"^0(?=\.|$)", "")
    optional = len(digits) - len(digits.rstrip("#"))
    for _ in range(optional):
        made = F.regexp_replace(made, r"(\.[0-9]*?)0$", "$1")
    if optional:
        made = F.regexp_replace(made, r"\.$", "")
    return F.concat(F.lit(_literal(before)), made, F.lit(_literal(after)))


def format_number(x: Column, fmt: str) -> Column:
    """The text of a number in a format; null where the format is beyond this (conditions, fractions, text)."""
    if fmt.lower() == "general":
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    if is_date_format(fmt) or has_time_format(fmt):
        return format_datetime(x, fmt)
    parts = sections(fmt)
    made = [_section(x, p) for p in parts]
    if any(m is None for m in made):
        return F.lit(None).cast("string")
    minus = F.concat(F.lit("-"), made[0])
    out = F.when(x < 0, made[1] if len(made) > 1 else minus).otherwise(made[0])
    return F.when((x == 0), made[2]).otherwise(out) if len(made) > 2 else out


def format_datetime(x: Column, fmt: str, date1904: bool = False) -> Column:
    """y m d h s, AM/PM and elapsed [h] of a serial; m is minutes next to hours or seconds."""
    from lattica.functions.dates import EPOCH_1904

    x = x + EPOCH_1904 if date1904 else x
    day = from_serial(x)
    seconds = F.rint((x - F.floor(x)) * 86400).cast("long")
    hour, minute, second = F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    noon = bool(re.search(r"am/pm|a/p", fmt, re.I))
    shown_hour = F.when(hour % 12 == 0, 12).otherwise(hour % 12) if noon else hour
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    tokens = re.findall(r'"[^"]*"|\\.|\[[hms]+\]|am/pm|a/p|y+|m+|d+|h+|s+(?:\.0+)?|.', fmt, re.I | re.S)
    out, clock = [], False
    for k, raw in enumerate(tokens):
        t = raw.lower()
        near = next((u.lower() for u in tokens[k + 1 :] if re.match(r"[ymdhs]", u, re.I)), "")
        if t[0] == '"' or t[0] == "\\":
            out.append(F.lit(raw.strip('"') if t[0] == '"' else raw[1:]))
            continue
        if t == "[h]" or t == "[hh]":
            out.append(F.floor(x * 24 + 1e-9).cast("long").cast("string"))
            clock = True
        elif t in ("[m]", "[mm]"):
            out.append(F.floor(x * 1440 + 1e-9).cast("long").cast("string"))
        elif t in ("[s]", "[ss]"):
            out.append(F.rint(x * 86400).cast("long").cast("string"))
        elif t in ("am/pm", "a/p"):
            out.append(F.when(hour < 12, "AM" if t == "am/pm" else "A").otherwise("PM" if t == "am/pm" else "P"))
        elif t[0] == "y":
            out.append(F.date_format(day, "yyyy" if len(t) > 2 else "yy"))
        elif t[0] == "d":
            out.append(F.date_format(day, {1: "d", 2: "dd", 3: "EEE"}.get(len(t), "EEEE")))
        elif t[0] == "h":
            out.append(two(shown_hour) if len(t) > 1 else shown_hour.cast("string"))
        elif t[0] == "s":
            out.append(two(second) if len(t.split(".")[0]) > 1 else second.cast("string"))
        elif t[0] == "m" and (clock or near.startswith("s")):
            out.append(two(minute) if len(t) > 1 else minute.cast("string"))
        elif t[0] == "m":
            out.append(F.date_format(day, {1: "M", 2: "MM", 3: "MMM"}.get(len(t), "MMMM")))
        else:
            out.append(F.lit(raw))
        if re.match(r"[ymdhs]", t):
            clock = t[0] == "h"
    return F.concat(*out)
