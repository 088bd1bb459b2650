"""Tail probabilities of the usual distributions.

Plain scalar functions for driver-side use and Arrow columns for result tables
(one row per test, so the Python side only ever sees the small final rows).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
EPS = 1e-16


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    """Inverse normal by Newton steps on the complementary error function."""
    if not 0.0 < p < 1.0:
        return -math.inf if p == 0.0 else math.inf if p == 1.0 else math.nan
    if p > 0.5:
        return -normal_ppf(1.0 - p)
    t = math.sqrt(-2.0 * math.log(p))
    z = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    for _ in range(6):
        err = normal_sf(-z) - p
        dens = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        if dens == 0.0:
            break
        step = err / dens
        z -= step / (1 + 0.5 * z * step)
        if abs(step) < 1e-15 * max(1.0, abs(z)):
            break
    return z


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, continued fraction by Lentz's method."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        delta = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + term / c
            c = c if abs(c) > TINY else TINY
            delta = c * d
            h *= delta
        if abs(delta - 1.0) < EPS * 4:
            break
    return front * h / a


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        delta = c * d
        h *= delta
        if abs(delta - 1.0) < EPS * 4:
            break
    return math.exp(log_front) * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0.0:
        return 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_ppf(p: float, df: float) -> float:
    """Inverse of Student's t by bisection on the survival function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, 2.0
    while t_sf(hi, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, df) > 1.0 - p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def one_or_two_sided(upper: float, alternative: str) -> float:
    """p-value from the upper-tail probability of a symmetric statistic."""
    if alternative == "greater":
        return upper
    if alternative == "less":
        return 1.0 - upper
    return min(1.0, 2.0 * min(upper, 1.0 - upper))


def _elementwise(fn, *series: pd.Series) -> pd.Series:
    out = []
    for args in zip(*series):
        out.append(None if any(a is None or a != a for a in args) else fn(*args))
    return pd.Series(out, dtype="float64")


def _column(fn, arity: int):
    if arity == 1:
        def one(a: pd.Series) -> pd.Series:
            return _elementwise(fn, a)
        return F.pandas_udf(one, "double")
    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return _elementwise(fn, a, b)
        return F.pandas_udf(two, "double")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _elementwise(fn, a, b, c)
    return F.pandas_udf(three, "double")


def t_upper(t: Column, df: Column) -> Column:
    return _column(t_sf, 2)(t.cast("double"), df.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _column(lambda a, d: one_or_two_sided(t_sf(a, d), "two-sided"), 2)(t.cast("double"), df.cast("double"))


def t_quantile(p: float, df: Column) -> Column:
    return _column(lambda d: t_ppf(p, d), 1)(df.cast("double"))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, 3)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return _column(chi2_sf, 2)(x.cast("double"), df.cast("double"))


def z_upper(z: Column) -> Column:
    return _column(normal_sf, 1)(z.cast("double"))


def z_two_sided(z: Column) -> Column:
    return _column(normal_two_sided, 1)(z.cast("double"))


# Coefficients of the rational functions of algorithm AS 241 (Wichura 1988), lowest power first.
_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_OUTER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(pair, x: Column) -> Column:
    sides = []
    for powers in pair:
        value = F.lit(powers[-1])
        for c in reversed(powers[:-1]):
            value = value * x + F.lit(c)
        sides.append(value)
    return sides[0] / sides[1]


def z_quantile(p: Column) -> Column:
    """Inverse normal of every row as column arithmetic; infinite at 0 and 1, NaN outside."""
    p = p.cast("double")
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    far = F.when(tail <= 5.0, _ratio(_OUTER, tail - 1.6)).otherwise(_ratio(_FAR, tail - 5.0))
    inside = F.when(F.abs(q) <= 0.425, q * _ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * far)
    edge = F.when(p == 0, -math.inf).when(p == 1, math.inf).otherwise(math.nan)
    return F.when(p.isNull(), None).when((p > 0) & (p < 1), inside).otherwise(edge)


def sided(upper: Column, alternative: str) -> Column:
    """Column form of ``one_or_two_sided``."""
    if alternative == "greater":
        return upper
    if alternative == "less":
        return 1 - upper
    return F.least(F.lit(1.0), 2 * F.least(upper, 1 - upper))
