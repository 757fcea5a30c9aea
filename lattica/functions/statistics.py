"""Aggregates over a row's own cells, order statistics, distributions and tests.

Aggregates over a table's rows are in lattica.operators.aggregate. The distributions have no closed
form in Spark's functions: they are Arrow-batched Pandas UDFs over `special`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import special
from lattica.functions.core import E, _num, _txt, as_grid, boolean, column_grid, compare, count, default, flat, mean, num, numbers, register, total, txt

# ---------------------------------------------------------------- aggregates of a row


def _any(array: Column, made: Column) -> Column:
    return F.when(F.size(array) > 0, made)


register("AVERAGE", "N")(mean)
register("COUNT", "N")(count)
register("MIN MINA", "N")(F.array_min)
register("MAX MAXA", "N")(F.array_max)
register("COUNTA", "S")(lambda xs: F.size(F.filter(xs, lambda x: x.isNotNull())).cast("double"))
register("COUNTBLANK", "S")(lambda xs: F.size(F.filter(xs, lambda x: x.isNull())).cast("double"))


def devsq(xs: Column) -> Column:
    m = mean(xs)
    return total(xs, lambda x: (x - m) * (x - m))


def _spread(sample: bool, root: bool):
    def f(xs):
        n = F.size(xs)
        made = devsq(xs) / F.when(n >= (2 if sample else 1), n - int(sample))
        return F.sqrt(made) if root else made

    return f


register("STDEV STDEV.S", "N")(_spread(True, True))
register("STDEV.P STDEVP", "N")(_spread(False, True))
register("VAR VAR.S", "N")(_spread(True, False))
register("VAR.P VARP", "N")(_spread(False, False))


def _with_text(args) -> Column:
    """Every cell that is not empty; text counts as 0."""
    args = [x for a in args for x in (sum(a.cells, []) if a.kind == "g" and a.cells else [a])]
    cells = [F.transform(F.filter(flat(a), lambda x: x.isNotNull()), lambda x: F.lit(0.0) if a.base == "s" else _num(x, a.base)) for a in args]
    return F.concat(*cells)


for _name, _f in {"STDEVA": _spread(True, True), "STDEVPA": _spread(False, True), "VARA": _spread(True, False), "VARPA": _spread(False, False)}.items():
    register(_name)(lambda *args, f=_f: E(f(_with_text(args)), "n"))


def percentile(xs: Column, k: Column) -> Column:
    s, at = F.array_sort(xs), k * (F.size(xs) - 1)
    lo = F.floor(at).cast("int")
    low, high = F.get(s, lo), F.coalesce(F.get(s, lo + 1), F.get(s, lo))
    return F.when(k.between(0, 1), low + (high - low) * (at - lo))


register("MEDIAN", "N")(lambda xs: _any(xs, percentile(xs, F.lit(0.5))))
register("PERCENTILE PERCENTILE.INC", "en")(lambda xs, k: percentile(numbers([xs]), k))
register("QUARTILE QUARTILE.INC", "en")(lambda xs, k: percentile(numbers([xs]), F.floor(k) / 4))
register("LARGE", "ei")(lambda xs, k: F.get(F.sort_array(numbers([xs]), False), k - 1))
register("SMALL", "ei")(lambda xs, k: F.get(F.sort_array(numbers([xs])), k - 1))
register("GEOMEAN", "N")(lambda xs: F.when(F.array_min(xs) > 0, F.exp(mean(F.transform(xs, lambda x: F.log(x))))))
register("HARMEAN", "N")(lambda xs: F.when(F.array_min(xs) > 0, count(xs) / total(xs, lambda x: 1 / x)))
register("DEVSQ", "N")(devsq)


@register("AVEDEV", "N")
def _avedev(xs):
    m = mean(xs)
    return F.try_divide(total(xs, lambda x: F.abs(x - m)), count(xs))


def _better(x, xs, up):
    return F.size(F.filter(xs, lambda y: F.when(up, y < x).otherwise(y > x)))


@register("RANK RANK.EQ", "ne|b")
def _rank(x, xs, up):
    xs, up = numbers([xs]), F.lit(False) if up is None else up
    return F.when(F.array_contains(xs, x), (_better(x, xs, up) + 1).cast("double"))


@register("RANK.AVG", "ne|b")
def _rank_avg(x, xs, up):
    xs, up = numbers([xs]), F.lit(False) if up is None else up
    ties = F.size(F.filter(xs, lambda y: y == x))
    return F.when(ties > 0, _better(x, xs, up) + 1 + (ties - 1) / 2)


@register("PERCENTRANK PERCENTRANK.INC", "en|n")
def _percentrank(xs, x, digits):
    xs = numbers([xs])
    return F.when(F.size(xs) > 1, F.size(F.filter(xs, lambda y: y < x)) / (F.size(xs) - 1)).otherwise(0.0)


@register("TRIMMEAN", "en")
def _trimmean(xs, share):
    xs = F.array_sort(numbers([xs]))
    cut = F.floor(F.size(xs) * share / 2).cast("int")
    kept = F.slice(xs, cut + 1, F.greatest(F.size(xs) - 2 * cut, F.lit(0)))
    return mean(kept)


@register("MODE MODE.SNGL", "N")
def _mode(xs):
    tally = F.transform(xs, lambda x, i: F.struct(F.size(F.filter(xs, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    best = F.array_max(tally)
    return F.when(best["n"] > 1, best["x"])


@register("FREQUENCY", "ee")
def _frequency(xs, bins):
    xs, bins = numbers([xs]), numbers([bins])
    lower = F.transform(bins, lambda b: F.coalesce(F.array_max(F.filter(bins, lambda c: c < b)), F.lit(float("-inf"))))
    counts = F.zip_with(bins, lower, lambda b, lo: F.size(F.filter(xs, lambda x: (x <= b) & (x > lo))).cast("double"))
    over = F.size(F.filter(xs, lambda x: x > F.array_max(bins))).cast("double")
    return column_grid(F.concat(counts, F.array(over)))


def _pairs(a: E, b: E) -> Column:
    both = F.arrays_zip(F.transform(flat(a), lambda x: _num(x, a.base)).alias("x"), F.transform(flat(b), lambda x: _num(x, b.base)).alias("y"))
    return F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _moments(pairs: Column):
    n = F.size(pairs).cast("double")
    mx, my = F.try_divide(total(pairs, lambda p: p["x"]), n), F.try_divide(total(pairs, lambda p: p["y"]), n)
    xy = total(pairs, lambda p: (p["x"] - mx) * (p["y"] - my))
    return n, mx, my, xy, total(pairs, lambda p: (p["x"] - mx) * (p["x"] - mx)), total(pairs, lambda p: (p["y"] - my) * (p["y"] - my))


def _paired(names: str, f):
    register(names)(lambda a, b: E(f(*_moments(_pairs(a, b))), "n"))


_paired("CORREL PEARSON", lambda n, mx, my, xy, xx, yy: F.try_divide(xy, F.sqrt(xx * yy)))
_paired("RSQ", lambda n, mx, my, xy, xx, yy: F.try_divide(xy * xy, xx * yy))
_paired("COVAR COVAR.P COVARIANCE.P", lambda n, mx, my, xy, xx, yy: F.try_divide(xy, n))
_paired("COVARIANCE.S", lambda n, mx, my, xy, xx, yy: F.try_divide(xy, n - 1))
_paired("SLOPE", lambda n, mx, my, xy, xx, yy: F.try_divide(xy, yy))  # (known y, known x)
_paired("INTERCEPT", lambda n, mx, my, xy, xx, yy: mx - F.try_divide(xy, yy) * my)
register("FORECAST FORECAST.LINEAR")(lambda x, ys, xs: E((lambda n, mx, my, xy, xx, yy: mx + F.try_divide(xy, yy) * (num(x) - my))(*_moments(_pairs(ys, xs))), "n"))
register("SUMXMY2")(lambda a, b: E(total(_pairs(a, b), lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"])), "n"))
register("SUMX2MY2")(lambda a, b: E(total(_pairs(a, b), lambda p: p["x"] * p["x"] - p["y"] * p["y"]), "n"))
register("SUMX2PY2")(lambda a, b: E(total(_pairs(a, b), lambda p: p["x"] * p["x"] + p["y"] * p["y"]), "n"))


@register("SUMPRODUCT")
def _sumproduct(*args: E):
    made = F.transform(flat(args[0]), lambda x: F.coalesce(_num(x, args[0].base), F.lit(0.0)))
    for a in args[1:]:
        made = F.zip_with(made, flat(a), lambda x, y: x * F.coalesce(_num(y, a.base), F.lit(0.0)))
    return E(total(F.filter(made, lambda x: x.isNotNull())), "n")


#: The aggregate of each SUBTOTAL code.
SUBTOTAL = {1: mean, 2: count, 3: count, 4: F.array_max, 5: F.array_min, 6: lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * x), 7: _spread(True, True), 8: _spread(False, True), 9: total, 10: _spread(True, False), 11: _spread(False, False)}


@register("SUBTOTAL", "iN")
def _subtotal(code, xs):
    made = F.lit(None).cast("double")
    for k, f in SUBTOTAL.items():
        made = F.when((code - 1) % 100 + 1 == k, f(xs).cast("double")).otherwise(made)
    return made


# ---------------------------------------------------------------- conditional aggregates of a row


def criterion(value: E, crit: E) -> Column:
    """Does a cell meet a criterion such as ">10", "<>x" or "b*"? See operators.criteria for whole columns."""
    text = txt(crit)
    op = F.regexp_extract(text, r"^(>=|<=|<>|>|<|=)?", 0)
    rest = F.call_function("substring", text, F.length(op) + 1, F.length(text))
    right = rest.try_cast("double")
    left = _num(value.col, value.kind) if value.kind != "s" else value.col.try_cast("double")
    numeric = right.isNotNull() & left.isNotNull()
    a, b = F.upper(F.coalesce(_txt(value.col, value.kind), F.lit(""))), F.upper(rest)
    wild = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"([.\\+\[\]^$(){}|])", r"\\$1"), r"(?<!~)\*", ".*"), r"(?<!~)\?", "."), F.lit("$"))
    same = F.when(numeric, left == right).when(b.rlike(r"[*?]"), F.call_function("regexp_like", a, wild)).otherwise(a == b)
    made = F.when(op == "<>", ~same)
    for sign, f in {">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, "<": lambda x, y: x < y}.items():
        comparable = F.when(numeric, f(left, right)).when(right.isNull(), f(a, b) & value.col.isNotNull()).otherwise(False)
        made = made.when(op == sign, comparable)
    return F.coalesce(made.otherwise(same), F.lit(False))


def _mask(pairs: list[E]) -> Column:
    masks = [F.transform(flat(r), lambda x: criterion(E(x, r.base), c)) for r, c in zip(pairs[::2], pairs[1::2], strict=True)]
    made = masks[0]
    for m in masks[1:]:
        made = F.zip_with(made, m, lambda a, b: a & b)
    return made


def _chosen(target: E, pairs: list[E]) -> Column:
    cells = F.transform(flat(target), lambda x: _num(x, target.base))
    picked = F.zip_with(cells, _mask(pairs), lambda x, m: F.when(m, x))
    return F.filter(picked, lambda x: x.isNotNull())


def _if_family(name: str, f):
    register(name + "IF")(lambda r, c, target=None: E(f(_chosen(target or r, [r, c])), "n"))
    register(name + "IFS")(lambda target, *pairs: E(f(_chosen(target, list(pairs))), "n"))


_if_family("SUM", total)
_if_family("AVERAGE", mean)
register("MAXIFS")(lambda target, *pairs: E(F.array_max(_chosen(target, list(pairs))), "n"))
register("MINIFS")(lambda target, *pairs: E(F.array_min(_chosen(target, list(pairs))), "n"))
register("COUNTIF COUNTIFS")(lambda *pairs: E(count(F.filter(_mask(list(pairs)), lambda m: m)), "n"))

# ---------------------------------------------------------------- distributions

register("PHI", "n")(lambda x: F.exp(-x * x / 2) / F.sqrt(2 * F.pi()))
register("STANDARDIZE", "nnn")(lambda x, m, sd: F.try_divide(x - m, sd))
register("EXPON.DIST EXPONDIST", "nnb")(lambda x, r, cumulative: F.when(x >= 0, F.when(cumulative, 1 - F.exp(-r * x)).otherwise(r * F.exp(-r * x))))
register("WEIBULL WEIBULL.DIST", "nnnb")(
    lambda x, a, b, cumulative: F.when(x >= 0, F.when(cumulative, 1 - F.exp(-F.pow(x / b, a))).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * F.exp(-F.pow(x / b, a))))
)
register("FISHER", "n")(lambda x: F.atanh(x))
register("FISHERINV", "n")(lambda x: F.tanh(x))

#: name: (argument letters, function of special, default of the last argument)
_UDF = {
    "NORM.DIST NORMDIST": ("nnnb", special.normal),
    "NORM.S.DIST": ("nb", lambda x, c: special.normal(x, 0.0, 1.0, c)),
    "NORMSDIST": ("n", lambda x: special.normal(x, 0.0, 1.0, 1.0)),
    "NORM.INV NORMINV": ("nnn", special.normal_inv),
    "NORM.S.INV NORMSINV": ("n", lambda p: special.normal_inv(p, 0.0, 1.0)),
    "LOGNORM.DIST": ("nnnb", special.lognormal),
    "LOGNORMDIST": ("nnn", lambda x, m, sd: special.lognormal(x, m, sd, 1.0)),
    "LOGNORM.INV LOGINV": ("nnn", special.lognormal_inv),
    "POISSON.DIST POISSON": ("nnb", special.poisson),
    "BINOM.DIST BINOMDIST": ("nnnb", special.binomial),
    "GAMMA": ("n", special.gamma_function),
    "GAMMALN": ("n", special.log_gamma),
    "GAMMA.DIST GAMMADIST": ("nnnb", special.gamma),
    "GAMMA.INV GAMMAINV": ("nnn", special.gamma_inv),
    "CHISQ.DIST": ("nnb", special.chi_square),
    "CHISQ.DIST.RT CHISQDIST CHIDIST": ("nn", lambda x, k: 1 - special.chi_square(x, k, 1.0)),
    "CHISQ.INV": ("nn", special.chi_square_inv),
    "CHISQ.INV.RT CHIINV": ("nn", lambda p, k: special.chi_square_inv(1 - p, k)),
    "CONFIDENCE CONFIDENCE.NORM": ("nnn", lambda a, sd, n: special.normal_inv(1 - a / 2, 0.0, 1.0) * sd / n**0.5),
    "GAUSS": ("n", lambda x: special.normal(x, 0.0, 1.0, 1.0) - 0.5),
    "HYPGEOM.DIST": ("nnnnb", special.hypergeometric),
    "HYPGEOMDIST": ("nnnn", lambda x, n, m, t: special.hypergeometric(x, n, m, t, 0.0)),
    "NEGBINOM.DIST": ("nnnb", special.negative_binomial),
    "NEGBINOMDIST": ("nnn", lambda f, s, p: special.negative_binomial(f, s, p, 0.0)),
    "ERF": ("n", special.erf),
    "ERFC": ("n", lambda x: 1 - special.erf(x)),
}
#: The same of functions that take whole arrays.
_ARRAY_UDF = {
    "BETA.DIST": ("nnnb", special.beta),
    "BETADIST": ("nnn", lambda x, a, b: special.beta(x, a, b, 1.0)),
    "BETA.INV BETAINV": ("nnn", special.beta_inv),
    "T.DIST": ("nnb", special.student),
    "T.DIST.RT": ("nn", lambda x, k: 1 - special.student(x, k, 1.0)),
    "T.DIST.2T": ("nn", lambda x, k: 2 * (1 - special.student(abs(x), k, 1.0))),
    "TDIST": ("nnn", lambda x, k, tails: tails * (1 - special.student(abs(x), k, 1.0))),
    "T.INV": ("nn", special.student_inv),
    "T.INV.2T TINV": ("nn", lambda p, k: special.student_inv(1 - p / 2, k)),
    "F.DIST": ("nnnb", special.fisher),
    "F.DIST.RT FDIST": ("nnn", lambda x, a, b: 1 - special.fisher(x, a, b, 1.0)),
    "F.INV": ("nnn", special.fisher_inv),
    "F.INV.RT FINV": ("nnn", lambda p, a, b: special.fisher_inv(1 - p, a, b)),
}
for _names, (_sig, _f) in (_UDF | _ARRAY_UDF).items():
    register(_names)(lambda *args, f=_f, sig=_sig, whole=_names in _ARRAY_UDF: E(special.vectorised(f, whole)(*(boolean(a).cast("double") if c == "b" else num(a) for a, c in zip(args, sig, strict=True))), "n"))


@register("Z.TEST ZTEST", "en|n")
def _z_test(xs, mu, sigma):
    xs = numbers([xs])
    sd = _spread(True, True)(xs) if sigma is None else sigma
    z = (mean(xs) - mu) / (sd / F.sqrt(count(xs)))
    return 1 - special.vectorised(lambda x: special.normal(x, 0.0, 1.0, 1.0))(z)


@register("T.TEST TTEST", "eeni")
def _t_test(a, b, tails, kind):
    x, y = numbers([a]), numbers([b])
    var = _spread(True, False)
    nx, ny, vx, vy = count(x), count(y), var(x), var(y)
    gaps = F.transform(_pairs(a, b), lambda p: p["x"] - p["y"])
    paired = mean(gaps) / F.sqrt(var(gaps) / count(gaps))
    pooled = ((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)
    equal = (mean(x) - mean(y)) / F.sqrt(pooled * (1 / nx + 1 / ny))
    se = vx / nx + vy / ny
    welch = (mean(x) - mean(y)) / F.sqrt(se)
    free = se * se / (F.pow(vx / nx, 2) / (nx - 1) + F.pow(vy / ny, 2) / (ny - 1))
    t = F.when(kind == 1, paired).when(kind == 2, equal).otherwise(welch)
    k = F.when(kind == 1, count(gaps) - 1).when(kind == 2, nx + ny - 2).otherwise(free)
    return special.vectorised(lambda t, k, tails: tails * (1 - special.student(abs(t), k, 1.0)), True)(t, k, tails)


@register("F.TEST FTEST", "ee")
def _f_test(a, b):
    x, y = numbers([a]), numbers([b])
    vx, vy = _spread(True, False)(x), _spread(True, False)(y)
    swap = vx < vy
    ratio = F.when(swap, vy / vx).otherwise(vx / vy)
    top, low = F.when(swap, count(y)).otherwise(count(x)) - 1, F.when(swap, count(x)).otherwise(count(y)) - 1
    return special.vectorised(lambda f, a, b: 2 * (1 - special.fisher(f, a, b, 1.0)), True)(ratio, top, low)


@register("CHISQ.TEST CHITEST")
def _chi_test(seen: E, expected: E):
    x2 = total(_pairs(seen, expected), lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"]) / p["y"])
    cells = as_grid(seen).col
    r, c = F.size(cells), F.size(F.get(cells, 0))
    free = F.when((r > 1) & (c > 1), (r - 1) * (c - 1)).otherwise(r * c - 1).cast("double")
    return E(special.vectorised(lambda x, k: 1 - special.chi_square(x, k, 1.0))(x2, free), "n")


__all__ = ["compare", "criterion", "default"]
