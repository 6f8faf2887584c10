"""Tail probabilities where digits are easily lost."""

from __future__ import annotations

import math
import time
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rollcall.functions import tails


def finite_t_tail(t: float, df: int) -> float:
    """P(|T| >= t) for even df, as a finite sum."""
    angle = math.atan(t / math.sqrt(df))
    terms, coefficient = 0.0, 1.0
    for k in range(df // 2):
        terms += coefficient * math.cos(angle) ** (2 * k)
        coefficient *= (2 * k + 1) / (2 * k + 2)
    return 1 - math.sin(angle) * terms


def expanded_t_tail(t: float, df: float) -> float:
    """The normal tail and two corrections in 1 / df."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = (t**3 + t) / 4
    second = (3 * t**7 - 5 * t**5 + 7 * t**3 - 3 * t) / 96
    # The tail of T is that of the normal distribution at t less these terms of its expansion.
    return math.erfc(t / math.sqrt(2)) + 2 * density * (first / df + (second + 0) / df**2)


@pytest.mark.parametrize("t", [0.5, 1.96, 4.0])
def test_t_tail_at_46(t):
    assert tails.t_two_sided(t, 46) == pytest.approx(finite_t_tail(t, 46), rel=1e-9)


@pytest.mark.parametrize("df", [1e6, 1e9, 1e12])
@pytest.mark.parametrize("t", [0.5, 1.96, 4.0, 8.0])
def test_t_tail_at_many_rows(t, df):
    assert tails.t_two_sided(t, df) == pytest.approx(expanded_t_tail(t, df), rel=1e-9)


@pytest.mark.parametrize("t", [0.1, 1.96, 5.0])
def test_both_ways_meet(t):
    below = tails.beta_share(tails.LARGE_DF / 2, 0.5, tails.LARGE_DF / (tails.LARGE_DF + t * t))
    assert tails._large_df_tail(t, tails.LARGE_DF) == pytest.approx(below, rel=1e-8)


def test_fraction_that_does_not_converge_raises(monkeypatch):
    with pytest.raises(ArithmeticError):
        tails._beta_fraction(1e18, 1e18, 0.5)


def exact_f_tail(f: Fraction, df1: int, df2: int) -> Fraction:
    """For even df2 and df1 the tail is a finite sum of rationals."""
    x = df2 / (df2 + df1 * f)
    total, term = Fraction(0), x ** (df2 // 2)
    for i in range(df1 // 2):
        total += term
        term = term * (Fraction(df2, 2) + i) / (i + 1) * (1 - x)
    return total


@pytest.mark.parametrize(("df1", "df2"), [(2, 10), (4, 20), (8, 30)])
def test_f_tail_even(df1, df2):
    for f in (Fraction(1, 3), Fraction(2), Fraction(9)):
        assert tails.f_tail(float(f), df1, df2) == pytest.approx(float(exact_f_tail(f, df1, df2)), rel=1e-12)


def test_f_tail_odd_and_bounds():
    assert tails.f_tail(3.24, 1, 17) == pytest.approx(tails.t_two_sided(1.8, 17), rel=1e-12)
    # The tails of F(3, n) for many n approach a chi-squared tail.
    assert tails.f_tail(2.5, 3, 1e9) == pytest.approx(tails.chi2_tail(7.5, 3), rel=1e-6)
    assert tails.f_tail(0, 3, 5) == 1 and tails.f_tail(math.inf, 3, 5) == 0
    assert math.isnan(tails.f_tail(1.0, 0, 5))


getcontext().prec = 150


def exact_chi2(x: float, df: int) -> Decimal:
    """1 - P(df / 2, x / 2) from the lower series, with 150 digits."""
    a, y = Decimal(df) / 2, Decimal(x) / 2
    if a < 2000:
        # gamma(a + 1) as a product, down to gamma(1) or gamma(1/2).
        gamma, k = Decimal(1), a
        while k > 0:
            gamma *= k
            k -= 1
        gamma = gamma.ln() + (Decimal(PI).sqrt().ln() if df % 2 else 0)
    else:
        z = a + 1
        gamma = (z - Decimal("0.5")) * z.ln() - z + (2 * Decimal(PI)).ln() / 2
        for top, bottom, power in ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9), (-691, 360360, 11), (1, 156, 13)):
            gamma += Decimal(top) / (Decimal(bottom) * z**power)
    total = term = Decimal(1)
    n = a
    while term > total * Decimal("1e-130"):
        n += 1
        term *= y / n
        total += term
    return 1 - (a * y.ln() - y - gamma).exp() * total


PI = "3.14159265358979323846264338327950288419716939937510582097494459"


@pytest.mark.parametrize("df", [1, 2, 3, 10, 49, 50, 199, 200, 201, 999, 10_000, 1_000_001, 10**8, 10**9])
@pytest.mark.parametrize("z", [-6.0, -2.0, -0.3, 0.0, 0.7, 2.0, 5.0, 9.0])
def test_chi2_tail_against_many_digits(df, z):
    x = df + z * math.sqrt(2 * df)
    if x <= 0:
        x = df / 100
    want = exact_chi2(x, df)
    assert abs(Decimal(tails.chi2_tail(x, df)) / want - 1) < Decimal("1e-12")


@pytest.mark.parametrize("df", [200, 777, 3000])
@pytest.mark.parametrize("ratio", [0.3, 0.74, 0.76, 1.24, 1.26, 1.6])
def test_chi2_tail_where_the_ways_meet(df, ratio):
    want = exact_chi2(df * ratio, df)
    assert abs(Decimal(tails.chi2_tail(df * ratio, df)) / want - 1) < Decimal("1e-12")


def test_chi2_tail_far_out_and_bounds():
    assert tails.chi2_tail(1600.0, 198) == pytest.approx(float(exact_chi2(1600.0, 198)), rel=1e-11)
    assert tails.chi2_tail(math.inf, 5) == 0 and tails.chi2_tail(-1, 5) == 1 and tails.chi2_tail(1e-10, 150) == 1
    assert math.isnan(tails.chi2_tail(math.nan, 5)) and math.isnan(tails.chi2_tail(1.0, 0))


@pytest.mark.parametrize("df", [30, 199, 200, 10**4, 10**6, 10**9])
def test_chi2_tail_takes_microseconds(df):
    tails.chi2_tail(df * 1.1, df)
    start = time.perf_counter()
    for i in range(300):
        tails.chi2_tail(df * (0.6 + i / 300), df)
    assert (time.perf_counter() - start) / 300 < 2e-4


def test_tail_for_one_degree_as_a_column(spark):
    values = [0.0, 1e-12, 1e-4, 0.3, 1.0, 3.84, 7.999, 8.0, 8.001, 12.0, 40.0, 300.0, 1400.0, math.inf, -1.0]
    rows = [(v,) for v in [*values, None, math.nan]]
    df = spark.createDataFrame(rows, "x double").withColumn("p", tails.chi2_sf_one(F.col("x")))
    found = {repr(r["x"]): r["p"] for r in df.collect()}
    for v in values:
        assert found[repr(v)] == pytest.approx(math.erfc(math.sqrt(max(v, 0) / 2)), rel=1e-12)
    assert found["None"] is None and found["nan"] is None
