"""Guarded arithmetic, binning, hashing and small array helpers as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Value of ``mapping`` for ``key`` as a CASE expression (stays inside code generation)."""
    items = list(mapping.items())
    out = F.when(key == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def safe_divide(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` or ``default`` where the denominator is zero or null."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def percentage_change(old: Column, new: Column) -> Column:
    return safe_divide((new - old) * 100.0, old, 0.0)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    return x


def right_closed_bin(x: Column, edges: list[float], labels: list) -> Column:
    """Label of the interval ``(edges[i], edges[i + 1]]`` holding ``x``; null outside."""
    out = F.when(x <= F.lit(float(edges[0])), F.lit(None))
    for hi, label in zip(edges[1:], labels):
        out = out.when(F.lit(True) if math.isinf(hi) else x <= F.lit(float(hi)), F.lit(label))
    return F.when(x.isNotNull(), out)


def one_hot(col: Column, vocabulary: list[str], prefix: str) -> dict[str, Column]:
    """0/1 columns over a fixed vocabulary, so no pass over the data is needed."""
    return {f"{prefix}_{v}": F.when(col == v, 1).otherwise(0) for v in vocabulary}


def null_sentinel(x: Column, limit: float) -> Column:
    """Missing-value sentinels (at or below ``limit``) and NaN become null."""
    return F.when((x > F.lit(limit)) & ~F.isnan(x), x)


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF by the rational approximation of Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def log_gamma_ratio(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for positive ``a``: by the asymptotic series beyond 12, to which smaller ones are stepped up."""
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda s, k: s + F.log((a + k) / (a + k + 0.5)))
    b = a + 12
    series = 0.5 * F.log(b) - 1 / (8 * b) + 1 / (192 * b * b * b) - 1 / (640 * b * b * b * b * b) + 17 / (14336 * b * b * b * b * b * b * b)
    return steps + series


def incomplete_beta(x: Column, a: Column, b: float = 0.5, terms: int = 200) -> Column:
    """Regularised incomplete beta function I_x(a, 1/2) by its continued fraction (modified Lentz), as one fold.

    The fraction is used on the side where it converges quickly: for x above (a + 1) / (a + b + 2) the other tail is
    worked out."""
    if b != 0.5:
        raise ValueError("only b = 1/2 is needed and supported")
    tiny = 1e-300
    half = F.lit(0.5)

    def fraction(x, p, q):
        def away(v):
            return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

        def step(s, m):
            def turn(s, numerator):
                d = 1 / away(1 + numerator * s["d"])
                c = away(1 + numerator / s["c"])
                return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))
            even = turn(s, m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)))
            return F.get(F.transform(F.array(even), lambda e: turn(e, -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)))), 0)

        d = 1 / away(1 - (p + q) * x / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)).cast("array<double>"), start, step, lambda s: s["h"])

    front = F.exp(log_gamma_ratio(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(1 - x))
    near = x < (a + 1) / (a + 2.5)
    value = F.when(near, front * fraction(x, a, half) / a).otherwise(1 - front * fraction(1 - x, half, a) / 0.5)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def t_two_sided_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t."""
    v = freedom.cast("double")
    return incomplete_beta(v / (v + t * t), v / 2)


def kolmogorov_p(stat: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = stat * (en + 0.12 + 0.11 / en)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * lam * lam * k * k))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(clip(2.0 * series, 0.0, 1.0))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    scale = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.try_divide(F.covar_pop(xx, yy), F.when(scale > 0, scale))


# ---- short arrays (at most a few dozen elements) --------------------------------

def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a).cast("double"))


def array_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def array_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of ``y`` on ``x``."""
    n = F.size(x).cast("double")
    return F.try_divide(n * array_dot(x, y) - array_sum(x) * array_sum(y),
                        n * array_dot(x, x) - array_sum(x) * array_sum(x))


def array_min_max_scale(a: Column) -> Column:
    """Scale to 0..1; a constant array becomes 0.5 everywhere."""
    span = F.array_max(a) - F.array_min(a)
    return F.when(span == 0, F.transform(a, lambda v: F.lit(0.5))) \
        .otherwise(F.transform(a, lambda v: F.try_divide(v - F.array_min(a), span)))


def pad_to(a: Column, n: int) -> Column:
    """Truncate to ``n`` elements or repeat the last one."""
    return F.slice(F.concat(a, F.array_repeat(F.element_at(a, -1), n)), 1, n)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2.0)


def array_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of two short arrays; null when either is constant."""
    n = F.size(a).cast("double")
    cov = array_dot(a, b) - array_sum(a) * array_sum(b) / n
    va, vb = array_dot(a, a) - array_sum(a) * array_sum(a) / n, array_dot(b, b) - array_sum(b) * array_sum(b) / n
    varies = (F.array_max(a) > F.array_min(a)) & (F.array_max(b) > F.array_min(b))
    return F.when(varies, F.try_divide(cov, F.sqrt(F.greatest(va * vb, F.lit(0.0)))))
