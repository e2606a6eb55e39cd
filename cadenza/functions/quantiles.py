"""Quantile functions that Spark lacks, normal as an expression, as Arrow-batched functions: chi-square (Poisson bounds), beta (exact binomial)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDS = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def _beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + up * d or 1e-300), 1 + up / c
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + down * d or 1e-300), 1 + down / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _solve(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    if not 0 < p < 1:
        return math.nan
    return _solve(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), p, -40.0, 40.0)


def poisson_bounds(count: float, alpha: float = 0.05) -> tuple[float, float]:
    top = count + 40 * math.sqrt(count + 1) + 40
    low = 0.0 if count <= 0 else _solve(lambda x: _lower_gamma(count, x), alpha / 2, 0.0, top)
    return low, _solve(lambda x: _lower_gamma(count + 1, x), 1 - alpha / 2, 0.0, top)


def binomial_bounds(k: float, n: float, alpha: float = 0.05) -> tuple[float, float]:
    if n <= 0:
        return math.nan, math.nan
    low = 0.0 if k <= 0 else _solve(lambda x: _beta_cdf(k, n - k + 1, x), alpha / 2, 0.0, 1.0)
    high = 1.0 if k >= n else _solve(lambda x: _beta_cdf(k + 1, n - k, x), 1 - alpha / 2, 0.0, 1.0)
    return low, high


#: Coefficients of Wichura's rational approximations (AS 241, 16 digits), lowest power first: centre, tail up to 5, beyond.
#: Fixed values.
PPND16 = (
    (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)


def _ratio(x, pair):
    """Quotient of two polynomials of x, a Column or a number."""
    out = []
    for coefficients in pair:
        y = coefficients[-1]
        for c in reversed(coefficients[:-1]):
            y = x * y + c
        out.append(y)
    return out[0] / out[1]


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution, NULL outside (0, 1), as one JVM-side expression."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, PPND16[1])).otherwise(_ratio(r - 5.0, PPND16[2]))
    inside = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, PPND16[0])).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), inside)


@F.pandas_udf(BOUNDS)
def poisson_rate_interval(count: pd.Series, exposure_sec: pd.Series) -> pd.DataFrame:
    """Exact 95 % bounds of a rate per minute."""
    rows = [tuple(b * 60 / e for b in poisson_bounds(c)) if e and e > 0 else (None, None) for c, e in zip(count, exposure_sec, strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"])


@F.pandas_udf(BOUNDS)
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([binomial_bounds(a, b) for a, b in zip(k, n, strict=True)], columns=["low", "high"])
