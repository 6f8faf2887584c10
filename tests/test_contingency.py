"""G-tests against direct sums, and distribution tails against tabulated points."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest

from rollcall.functions import tails
from rollcall.operators import contingency

CELLS = ("not_listed", "listed")


def direct_g(table: list[tuple]) -> float:
    n = sum(map(sum, table))
    cols = [sum(c) for c in zip(*table)]
    return 2 * sum(
        o * math.log(o * n / (sum(row) * cols[j]))
        for row in table
        for j, o in enumerate(row)
        if o > 0
    )


def frame(spark, table):
    return spark.createDataFrame(
        [(f"g{i:02d}", *row) for i, row in enumerate(table)], "grp string, not_listed long, listed long"
    )


TABLES = [
    [(12, 5), (3, 9), (20, 20)],
    [(0, 7), (5, 0), (3, 3), (1, 1)],
    [(4, 0), (9, 0)],
    [(2, 4), (1, 2), (10, 20)],
    [(10**9, 10**9 + 5), (3 * 10**8, 10**8)],
]


@pytest.mark.parametrize("table", TABLES)
def test_g_test(spark, table):
    row = contingency.g_test(frame(spark, table), CELLS).first()
    want = direct_g(table)
    assert row.g == pytest.approx(want, rel=1e-9, abs=1e-6 if max(table[0]) > 1e6 else 1e-9)
    assert (row.df, row.n) == (len(table) - 1, sum(map(sum, table)))
    assert row.p == pytest.approx(tails.chi2_tail(row.g, row.df), rel=1e-12)


def test_g_is_zero_iff_proportions_are_equal(spark):
    assert contingency.g_test(frame(spark, TABLES[3]), CELLS).first().g == pytest.approx(0, abs=1e-12)
    assert contingency.g_test(frame(spark, TABLES[0]), CELLS).first().g > 1


@pytest.mark.parametrize("raw", [True, False])
def test_g_test_long_of_rows_and_of_counts(spark, raw):
    rng = random.Random(4)
    cells = {(r, c): rng.randrange(0, 6) for r in "abcd" for c in "xyz"}
    table = [tuple(cells[r, c] for c in "xyz") for r in "abcd"]
    if raw:
        data = [(r, c) for (r, c), n in cells.items() for _ in range(n)]
        df, n = spark.createDataFrame(data, "r string, c string"), None
    else:
        df, n = spark.createDataFrame([(r, c, k) for (r, c), k in cells.items()], "r string, c string, n long"), "n"
    got = contingency.g_test_long(df, "r", "c", n).first()
    assert got.g == pytest.approx(direct_g(table), rel=1e-9)
    assert (got.df, got.n) == (6, sum(cells.values()))


def test_long_and_wide_agree_with_zero_rows(spark):
    table = TABLES[1]
    wide = contingency.g_test(frame(spark, table), CELLS).first()
    long = spark.createDataFrame(
        [(f"g{i}", c, o) for i, row in enumerate(table) for c, o in zip("ab", row)],
        "r string, c string, n long",
    )
    got = contingency.g_test_long(long, "r", "c", "n").first()
    assert (got.g, got.df, got.n) == (pytest.approx(wide.g, rel=1e-9), wide.df, wide.n)


@pytest.mark.parametrize("blocks", [1, 2, 8])
def test_every_pair_once(spark, blocks):
    rng = random.Random(blocks)
    table = [(rng.randrange(0, 30), rng.randrange(1, 30)) for _ in range(23)]
    got = contingency.pairwise_g_test(frame(spark, table), "grp", CELLS, blocks=blocks).collect()
    found = {(r.group_a, r.group_b): r for r in got}
    assert len(found) == len(got) == 23 * 22 // 2
    for i, j in combinations(range(23), 2):
        row = found[f"g{i:02d}", f"g{j:02d}"]
        want = direct_g([table[i], table[j]])
        assert row.g == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert row.p == pytest.approx(tails.chi2_tail(want, 1), rel=1e-6, abs=1e-12)


def test_matrix_layout(spark):
    pairs = contingency.pairwise_g_test(frame(spark, TABLES[0]), "grp", CELLS)
    matrix = contingency.to_matrix(pairs)
    assert sorted(matrix.columns) == ["g00", "g01", "group_b"]
    by_row = {r.group_b: r for r in matrix.collect()}
    assert sorted(by_row) == ["g01", "g02"]
    assert by_row["g01"].g01 is None and by_row["g02"].g01 is not None


def test_empty_table(spark):
    assert contingency.g_test(frame(spark, [(0, 0)]), CELLS).first().g is None


# Tabulated 5% and 0.1% points.
@pytest.mark.parametrize(
    "x, df, p",
    [
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (7.814727903251179, 3, 0.05),
        (11.070497693516351, 5, 0.05),
        (18.307038053275146, 10, 0.05),
        (124.34211340400407, 100, 0.05),
        (10.827566170662733, 1, 0.001),
    ],
)
def test_chi2_tail(x, df, p):
    assert tails.chi2_tail(x, df) == pytest.approx(p, rel=1e-9)


def test_chi2_far_tail_and_bounds():
    assert 0 < tails.chi2_tail(200.0, 1) < 1e-40
    assert tails.chi2_tail(0.0, 3) == 1.0
    assert 0 < tails.chi2_tail(2000.0, 1500) < 1e-14
    assert tails.chi2_tail(1e6, 10**6) == pytest.approx(0.5, abs=1e-3)
    assert math.isnan(tails.chi2_tail(float("nan"), 1))
    values = [tails.chi2_tail(x / 4, 7) for x in range(200)]
    assert values == sorted(values, reverse=True)


# Tabulated two-sided 5% points.
@pytest.mark.parametrize(
    "t, df", [(12.706204736432095, 1), (4.302652729911275, 2), (2.2281388519649385, 10), (2.0128955989, 46)]
)
def test_t_tail_and_quantile(t, df):
    assert tails.t_two_sided(t, df) == pytest.approx(0.05, rel=1e-8)
    assert tails.t_quantile(0.95, df) == pytest.approx(t, rel=1e-8)


def test_t_tail_of_one_df_is_cauchy():
    for t in (0.1, 1.0, 5.0, 300.0):
        assert tails.t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-9)


def test_null_group_counts_alike_in_both_tests(spark):
    df = spark.createDataFrame([("a", 3, 9), ("b", 5, 2), (None, 7, 7)], "g string, no long, yes long")
    cells = ("no", "yes")
    assert contingency.g_test(df, cells).first()["df"] == 2
    pairs = contingency.pairwise_g_test(df, "g", cells)
    assert sorted((r["group_a"], r["group_b"]) for r in pairs.collect() if r["group_b"]) == [("a", "b")]
    assert sorted(r["group_a"] for r in pairs.collect() if r["group_b"] is None) == ["a", "b"]
    assert contingency.g_test(df, cells, group="g", null_group=False).first()["df"] == 1
    assert contingency.pairwise_g_test(df, "g", cells, null_group=False).count() == 1


def test_all_pairs_stay_in_the_jvm(spark):
    counts = spark.createDataFrame([(g, 10 + g, 20 - g) for g in range(9)], "g int, a int, b int")
    plan = contingency.pairwise_g_test(counts, "g", ("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
