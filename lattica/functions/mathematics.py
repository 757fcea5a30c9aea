"""Arithmetic, rounding, trigonometry, number theory, bases and bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.core import NUM, STR, default, register, times, total


def _power10(d: Column | None) -> Column:
    return F.pow(F.lit(10.0), F.lit(0) if d is None else d)


def away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def toward(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def plain(name: str, f):
    register(name, "n")(f)


for _name, _f in {
    "ABS": F.abs,
    "INT": lambda x: F.floor(x).cast("double"),
    "SQRT": lambda x: F.when(x >= 0, F.sqrt(x)),
    "SIGN": F.signum,
    "EXP": F.exp,
    "LN": lambda x: F.when(x > 0, F.log(x)),
    "LOG10": lambda x: F.when(x > 0, F.log10(x)),
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "ASIN": F.asin,
    "ACOS": F.acos,
    "ATAN": F.atan,
    "SINH": F.sinh,
    "COSH": F.cosh,
    "TANH": F.tanh,
    "DEGREES": F.degrees,
    "RADIANS": F.radians,
    "SEC": F.sec,
    "CSC": F.csc,
    "COT": F.cot,
    "ACOT": lambda x: F.when(x == 0, F.pi() / 2).otherwise(F.atan(1 / x)),
    "ASEC": lambda x: F.acos(F.try_divide(F.lit(1.0), x)),
    "ACSC": lambda x: F.asin(F.try_divide(F.lit(1.0), x)),
    "SQRTPI": lambda x: F.when(x >= 0, F.sqrt(x * F.pi())),
    "EVEN": lambda x: F.signum(x) * 2 * F.ceil(F.abs(x) / 2),
    "ODD": lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1)),
}.items():
    plain(_name, _f)

register("PI", "")(lambda: F.pi())
register("POWER", "nn")(lambda a, b: F.pow(a, b))
register("MOD", "nn")(lambda a, b: a - b * F.floor(F.try_divide(a, b)))
register("LOG", "n|n")(lambda x, b: F.when(x > 0, F.log10(x) if b is None else F.log(x) / F.log(b)))
register("ROUND", "n|n")(lambda x, d: F.try_divide(away(x * _power10(d)), _power10(d)))
register("TRUNC", "n|n")(lambda x, d: toward(x * _power10(d)) / _power10(d))
register("ROUNDDOWN", "n|n")(lambda x, d: toward(x * _power10(d)) / _power10(d))
register("ROUNDUP", "n|n")(lambda x, d: F.signum(x) * F.ceil(F.abs(x) * _power10(d)) / _power10(d))
register("ATAN2", "nn")(lambda x, y: F.atan2(y, x))
register("CEILING CEILING.MATH", "n|n")(lambda x, s: F.ceil(F.try_divide(x, default(s, 1.0))) * default(s, 1.0))
register("FLOOR FLOOR.MATH", "n|n")(lambda x, s: F.floor(F.try_divide(x, default(s, 1.0))) * default(s, 1.0))
register("MROUND", "nn")(lambda x, m: F.when(m == 0, 0.0).otherwise(away(F.try_divide(x, m)) * m))


def factorial(n: Column) -> Column:
    n = F.greatest(F.floor(n), F.lit(0)).cast("int")
    return F.when(n <= 170, F.when(n < 2, 1.0).otherwise(times(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k.cast("double")))))


def falling(n: Column, k: Column) -> Column:
    """n (n - 1) ... (n - k + 1)."""
    n, k = F.floor(n), F.floor(k)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), lambda j: n - j + 1)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(times(steps))


def choose(n: Column, k: Column) -> Column:
    n, k = F.floor(n), F.floor(k)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), lambda j: (n - k + j) / j)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(F.rint(times(steps)))


register("FACT", "n")(factorial)
register("COMBIN", "nn")(choose)
register("PERMUT", "nn")(falling)


@register("MULTINOMIAL", "N")
def _multinomial(ns):
    return F.aggregate(
        ns,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("made")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["made"] * choose(a["sum"] + x, x)).alias("made")),
        lambda a: a["made"],
    )


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 80 steps, enough for 53 bits."""
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(a.alias("x"), b.alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.coalesce(F.try_mod(s["x"], s["y"]), F.lit(0.0)).alias("y"))),
    )
    return done["x"]


register("GCD", "N")(lambda ns: F.aggregate(ns, F.lit(0.0), lambda a, x: _gcd(F.floor(F.abs(x)).cast("double"), a)))
register("LCM", "N")(
    lambda ns: F.when(F.exists(ns, lambda x: x == 0), 0.0).otherwise(
        F.aggregate(ns, F.lit(1.0), lambda a, x: F.try_divide(a * F.floor(F.abs(x)), _gcd(F.floor(F.abs(x)).cast("double"), a)))
    )
)
register("PRODUCT", "N")(times)
register("SUM", "N")(total)
register("SUMSQ", "N")(lambda ns: total(ns, lambda x: x * x))

#: Fixed values.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


@register("ROMAN", "i|n", STR)
def _roman(n, form):
    parts, rest = [], n
    for value, letters in ROMAN:
        parts.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(0, 3999), F.concat(*parts))


@register("ARABIC", "s")
def _arabic(s):
    values = F.transform(F.split(F.upper(F.trim(s)), ""), lambda c: sum((F.when(c == k, v).otherwise(0) for v, k in ROMAN if len(k) == 1), F.lit(0)))
    nxt = F.concat(F.slice(values, 2, F.length(s) + 1), F.array(F.lit(0)))
    signed = F.zip_with(values, nxt, lambda a, b: F.when(a < F.coalesce(b, F.lit(0)), -a).otherwise(a).cast("double"))
    return F.when(F.upper(F.trim(s)).rlike("^[IVXLCDM]*$"), total(signed))


def _conv(s: Column, a, b) -> Column:
    return F.call_function("conv", s, a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def _base(x, r, n):
    made = _conv(F.floor(x).cast("long").cast("string"), 10, r)
    return made if n is None else F.call_function("lpad", made, F.greatest(n, F.length(made)), F.lit("0"))


register("BASE", "ni|i", STR)(_base)


def _digits(pattern: str, radix: int):
    return lambda s: F.when(F.upper(s).rlike(pattern), _conv(s, radix, 10).cast("double")).otherwise(0.0)


register("DECIMAL", "si")(lambda s, r: _conv(s, r, 10).cast("double"))
register("HEX2DEC", "s")(_digits("^[0-9A-F]+$", 16))
register("BIN2DEC", "s")(_digits("^[01]+$", 2))
register("OCT2DEC", "s")(_digits("^[0-7]+$", 8))


def _to_radix(radix: int):
    def f(x, n):
        return _base(F.greatest(x, F.lit(0.0)), F.lit(radix), n)

    return f


register("DEC2HEX", "n|i", STR)(_to_radix(16))
register("DEC2BIN", "n|i", STR)(_to_radix(2))
register("DEC2OCT", "n|i", STR)(_to_radix(8))

_long = lambda x: F.floor(x).cast("long")
register("BITAND", "nn")(lambda a, b: _long(a).bitwiseAND(_long(b)).cast("double"))
register("BITOR", "nn")(lambda a, b: _long(a).bitwiseOR(_long(b)).cast("double"))
register("BITXOR", "nn")(lambda a, b: _long(a).bitwiseXOR(_long(b)).cast("double"))
register("BITLSHIFT", "nn")(lambda a, b: F.call_function("shiftleft", _long(a), b.cast("int")).cast("double"))
register("BITRSHIFT", "nn")(lambda a, b: F.call_function("shiftright", _long(a), b.cast("int")).cast("double"))
register("DELTA", "n|n")(lambda a, b: (a == default(b, 0.0)).cast("double"))
register("GESTEP", "n|n")(lambda a, s: (a >= default(s, 0.0)).cast("double"))

__all__ = ["NUM", "away", "choose", "factorial"]
