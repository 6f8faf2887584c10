"""Upper tails of the chi-squared and Student t distributions.

Spark has no column function for either. Both are evaluated on result rows only: one row per
test, pair or coefficient. The tail that all pairs of groups need, with one degree of freedom, is
a column expression.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: From these degrees of freedom on the tail is not summed but expanded.
MANY_DF = 200


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for whole degrees of freedom; small values keep their digits.

    Few degrees of freedom: a finite sum, from its largest term to either side. Many: the uniform
    expansion around the normal tail near the mean, a continued fraction above, a series below.
    """
    if x is None or df is None or math.isnan(x) or df != df:
        return math.nan
    if df < 1:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    df = int(df)
    return _chi2_sum(x / 2.0, df) if df < MANY_DF else _gamma_tail(df / 2.0, x / 2.0)


def _chi2_sum(half: float, df: int) -> float:
    start = 0.5 if df % 2 else 0.0
    count = (df - df % 2) // 2
    total = math.erfc(math.sqrt(half)) if df % 2 else 0.0
    if not count:
        return total
    # half^(start + i) e^-half / gamma(start + i + 1); the largest has start + i next to half.
    top = min(count - 1, max(0, int(half - start)))
    power = start + top
    largest = math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
    terms, term = largest, largest
    for i in range(top + 1, count):
        term *= half / (start + i)
        terms += term
    term = largest
    for i in range(top, 0, -1):
        term *= (start + i) / half
        terms += term
    return min(total + terms, 1.0)


def _excess(m: float) -> float:
    """m - ln(1 + m), without the digits that the difference loses for small m."""
    if abs(m) > 0.4:
        return m - math.log1p(m)
    # With w = m / (2 + m): ln(1 + m) = 2 (w + w^3 / 3 + w^5 / 5 + ...), and m - 2 w = m w.
    w = m / (2.0 + m)
    total, power, k = 0.0, w * w * w, 3
    while True:
        term = power / k
        if abs(term) <= 1e-18 * abs(m * w):
            return m * w - 2.0 * total
        total += term
        power *= w * w
        k += 2


@functools.cache
def _uniform_coefficients(orders: int = 12, size: int = 26) -> list[list[float]]:
    """Taylor coefficients in eta of the functions c_0, c_1, ... of the uniform expansion.

    By their recursions, in exact fractions: lambda as a series in eta, the coefficients of
    Stirling's series, and from both those of each function.
    """
    length = size + 2 * orders + 3
    alpha = [Fraction(0), Fraction(1), Fraction(1, 3)]
    for n in range(3, length):
        inner = sum(j * alpha[j] * alpha[n - j + 1] for j in range(2, n))
        alpha.append((alpha[n - 1] - inner) / (n + 1))
    # Squares of the root of two that the usual recursion of Stirling's series carries are left out.
    a = [Fraction(1)]
    for k in range(1, 2 * orders + 1):
        inner = sum(a[i] * a[k - i] / (i + 1) for i in range(1, k))
        a.append((a[k - 1] / k - inner) / (1 + Fraction(1, k + 1)))
    stirling, rising = [Fraction(1)], Fraction(1)
    for k in range(1, orders):
        rising *= Fraction(2 * k - 1, 2)
        stirling.append(rising * 2**k * a[2 * k])
    first = [Fraction(-1, 3), *((n + 2) * alpha[n + 2] for n in range(1, length - 2))]
    rows, last = [first], first
    for k in range(1, orders):
        last = [(-1) ** k * stirling[k] * first[n] + (n + 2) * last[n + 2] for n in range(len(last) - 2)]
        rows.append(last)
    return [[float(x) for x in row[:size]] for row in rows]


def _gamma_tail(a: float, x: float) -> float:
    """Q(a, x), the upper share of the incomplete gamma function, for large a."""
    m = (x - a) / a
    excess = _excess(m)
    if abs(m) < 0.25:
        eta = math.copysign(math.sqrt(2.0 * excess), m)
        total, scale = 0.0, 1.0
        for row in _uniform_coefficients():
            value = 0.0
            for c in reversed(row):
                value = value * eta + c
            total += value * scale
            scale /= a
            if scale < 1e-17:
                break
        rest = math.exp(-a * excess) / math.sqrt(2.0 * math.pi * a) * total
        return min(1.0, 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + rest)
    # x^a e^-x / gamma(a), by Stirling's series.
    series = 1.0 / (12.0 * a) - 1.0 / (360.0 * a**3) + 1.0 / (1260.0 * a**5)
    front = math.exp(-a * excess - series) * math.sqrt(a / (2.0 * math.pi))
    if x < a:
        total = term = 1.0 / a
        n = a
        while term > 1e-17 * total:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    # Continued fraction (modified Lentz), all of whose partial denominators are positive.
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * value


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if t is None or df is None or math.isnan(t) or not df > 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > LARGE_DF:
        return _large_df_tail(t, df)
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


#: From here on the differences inside the incomplete beta function lose more digits than the
#: expansion around the normal distribution leaves out.
LARGE_DF = 1e5


def _large_df_tail(t: float, df: float) -> float:
    """Two-sided tail for many degrees of freedom: Hill's normalising expansion (1970).

    The terms left out are of the order of df to the power -4; ``log1p`` keeps t * t / df exact.
    """
    a = df - 0.5
    b = 48.0 * a * a
    y = a * math.log1p(t * t / df)
    inner = (((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b)
    z = ((inner + y + 3.0) / b + 1.0) * math.sqrt(y)
    return math.erfc(z / math.sqrt(2.0))


def _log_gamma_step(a: float, b: float) -> float:
    """ln gamma(a + b) - ln gamma(a) without the digits that the difference of both loses."""
    if a < 1e3:
        return math.lgamma(a + b) - math.lgamma(a)

    def rest(z: float) -> float:
        return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3)

    return (a + b - 0.5) * math.log1p(b / a) + b * math.log(a) - b + rest(a + b) - rest(a)


def f_tail(f: float, df1: int, df2: float) -> float:
    """P(F >= f) for whole df1: a sum of positive terms, so small values survive."""
    if f is None or math.isnan(f) or not df1 >= 1 or not df2 > 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    a, ratio = df2 / 2.0, df1 * f / df2
    log_x, log_y = -math.log1p(ratio), math.log(ratio) - math.log1p(ratio)
    odd = int(df1) % 2
    total = t_two_sided(math.sqrt(df1 * f), df2) if odd else math.exp(a * log_x)
    b = 0.5 if odd else 1.0
    while b < df1 / 2.0:
        total += math.exp(a * log_x + b * log_y + _log_gamma_step(a, b) - math.lgamma(b + 1.0))
        b += 1.0
    return min(total, 1.0)


def t_quantile(level: float, df: float) -> float:
    """The t with P(|T| <= t) = level, by bisection."""
    if not df > 0:
        return math.nan
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1.0 - level:
        high *= 2.0
    while high - low > 1e-14 * high:
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        if t_two_sided(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def _chi2_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


def t_reach(df: Column, level: float) -> Column:
    """The t with P(|T| <= t) = level, of a column of degrees of freedom; null where undefined."""

    @F.pandas_udf(T.DoubleType())
    def reach(df: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(level, x) for x in df], dtype="float64")

    return F.nanvl(reach(df.cast("double")), F.lit(None).cast("double"))


#: x up to here: the series of erf; beyond, the continued fraction of erfc, with so many parts.
_SERIES_TO, _SERIES_TERMS, _FRACTION_PARTS = 8.0, 48, 40


def chi2_sf_one(x: Column) -> Column:
    """Upper chi-squared tail for one degree of freedom, without leaving the JVM.

    P(X >= x) = erfc(sqrt(x / 2)): one less the series of erf, whose terms are all positive, or a
    continued fraction evaluated from its last part, where erfc is small. Null for null and NaN.
    """
    x = x.cast("double")
    # The sum of x^n / (1 * 3 * ... * (2 n + 1)), from the last term on.
    steps = F.sequence(F.lit(_SERIES_TERMS), F.lit(1), F.lit(-1))
    low = F.least(x, F.lit(_SERIES_TO))
    series = F.aggregate(steps, F.lit(1.0), lambda total, n: 1.0 + total * low / (2 * n + 1))
    near = 1.0 - F.sqrt(low * (2.0 / math.pi)) * F.exp(-low / 2) * series
    y = F.greatest(x, F.lit(_SERIES_TO)) / 2
    parts = F.sequence(F.lit(_FRACTION_PARTS), F.lit(1), F.lit(-1))
    last = y + (2 * _FRACTION_PARTS + 0.5)
    fraction = F.aggregate(parts, last, lambda f, k: y + 2 * k - 1.5 - k * (k - 0.5) / f)
    far = F.exp(-y) * F.sqrt(y / math.pi) / fraction
    found = F.when(x <= 0, F.lit(1.0)).when(x <= _SERIES_TO, near).when(x == math.inf, F.lit(0.0)).otherwise(far)
    return F.when(x.isNotNull() & ~F.isnan(x), found)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper chi-squared tail of a column; null where undefined."""
    return F.nanvl(_chi2_udf(x.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def t_sf(t: Column, df: Column) -> Column:
    """Two-sided Student t tail of a column; null where undefined."""
    return F.nanvl(_t_udf(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))
