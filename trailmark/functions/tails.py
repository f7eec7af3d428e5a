"""Tail probabilities as column expressions: normal, chi-square, Student t.

They fold a series or continued fraction over an array of step numbers, so they run in the plan, without Python workers. Meant for
the rows of a result, where a few hundred steps a row don't matter. Null or NaN arguments give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom above which Student's t is taken by an expansion about the normal; there it is nearer than 1e-10.
T_EXPANSION = 400.0
#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _known(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c)
    return out


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a > 0: Stirling's series at a + 8, less the logarithms stepped over."""
    z, stepped, tail = a + 8.0, a, F.lit(0.0)
    for k in range(1, 8):
        stepped = stepped * (a + float(k))
    for c in reversed(STIRLING):
        tail = tail / (z * z) + c
    # Above 1e30 the product would pass a double; there the step is below precision anyway.
    plain = lambda v: (v - 0.5) * F.log(v) - v + 0.9189385332046727
    return F.when(a > 1e30, plain(a)).otherwise(plain(z) + tail / z - F.log(stepped))


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x), for a > 0 and up to about 10^6 steps of sqrt(a)."""
    steps = F.least(F.lit(1_000_000), F.ceil(F.sqrt(a) * 12.0 + 120.0)).cast("int")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    # Below a + 1: the power series, summed from its last term; above: Legendre's continued fraction, from its last step.
    series = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1.0 + s * x / (a + k))
    fraction = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), x + 2.0 * steps + 1.0 - a, lambda t, k: x + 2.0 * k - 1.0 - a - k * (k - a) / t)
    q = F.when(x <= 0, 1.0).when(x > a + 700.0 + 40.0 * F.sqrt(a), 0.0).when(x < a + 1.0, 1.0 - front * series / a).otherwise(front / fraction)
    return F.when(_known(a, x) & (a > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of a chi-square with df degrees of freedom; null without degrees."""
    return upper_gamma(df.cast("double") / 2.0, x.cast("double") / 2.0)


def normal_p(z: Column) -> Column:
    """Two-sided tail of a normal."""
    z = z.cast("double")
    return upper_gamma(F.lit(0.5), z * z / 2.0)


def lower_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction, taken from the side where it converges.
    rest: 1 - x, given as it may be far below x's precision."""

    def fraction(p: Column, q: Column, y: Column, other: Column) -> Column:
        steps = F.ceil(F.sqrt(F.greatest(p, q)) * 8.0 + 100.0).cast("int")

        def step(t: Column, k: Column) -> Column:
            even = k * (q - k) * y / ((p + 2.0 * k - 1.0) * (p + 2.0 * k))
            odd = -(p + k) * (p + q + k) * y / ((p + 2.0 * k) * (p + 2.0 * k + 1.0))
            return 1.0 + even / (1.0 + odd / t)

        inner = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), step)
        whole = 1.0 - (p + q) * y / (p + 1.0) / inner
        return F.exp(p * F.log(y) + q * F.log(other) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p / whole

    value = F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(x < (a + 1.0) / (a + b + 2.0), fraction(a, b, x, rest)).otherwise(1.0 - fraction(b, a, rest, x))
    return F.when(_known(a, b, x), value)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t; null without degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    # Hill's expansion of the normal deviate.
    a = df - 0.5
    u = F.sqrt(a * F.log1p(t * t / df))
    b = 48.0 * a * a
    z = u + (F.pow(u, 3) + 3.0 * u) / b - (4.0 * F.pow(u, 7) + 33.0 * F.pow(u, 5) + 240.0 * F.pow(u, 3) + 855.0 * u) / (10.0 * b * (b + 0.8 * F.pow(u, 4) + 100.0))
    whole = F.abs(t) == float("inf")
    p = F.when(whole, 0.0).when(df > T_EXPANSION, normal_p(z)).otherwise(lower_beta(df / 2.0, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))
    return F.when(_known(t, df) & (df > 0), p)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees of freedom; 0 at |r| = 1."""
    df = n.cast("double") - 2.0
    rest = 1.0 - r * r
    return F.when(_known(r) & (df > 0), F.when(rest <= 0, 0.0).otherwise(t_p(r * F.sqrt(df / F.when(rest > 0, rest)), df)))
