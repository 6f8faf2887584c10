"""Moments, least squares and stepwise search against numpy on the same rows."""

from __future__ import annotations

import math
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rollcall.operators import linear, moments
from rollcall.operators.moments import Moments, pair_moments

XS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 5)) * [1, 20, 0.01, 5, 1] + [0, 3000, 4, -7, 1e6]
    y = 2 + 1.5 * x[:, 0] - 0.05 * x[:, 1] + rng.normal(size=n)
    region = rng.integers(0, 6, size=n)
    region[: n // 3] = 0
    return x, y, region


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y, region = table
    data = [(int(r), float(v), *map(float, row)) for r, v, row in zip(region, y, x)]
    return spark.createDataFrame(data, "region_key int, y double, " + ", ".join(f"{c} double" for c in XS)).repartition(7)


def reference_fit(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    centre = x.mean(axis=0)
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x - centre]), y, rcond=None)
    beta = np.concatenate([[beta[0] - beta[1:] @ centre], beta[1:]])
    rss = float(((y - design @ beta) ** 2).sum())
    free = len(y) - design.shape[1]
    # Rows of the pseudo-inverse of the design give the variances without squaring its condition.
    scale = np.sqrt((design**2).sum(axis=0))
    rows = np.linalg.pinv(design / scale, rcond=1e-14) / scale[:, None]
    error = np.sqrt((rows**2).sum(axis=1) * rss / free)
    return beta, error, rss


def aic(x, y, cols, k=2.0):
    rss = reference_fit(x[:, cols], y)[2] if cols else float(((y - y.mean()) ** 2).sum())
    return len(y) * math.log(rss / len(y)) + k * (len(cols) + 1)


def test_ols(frame, table):
    x, y, _ = table
    beta, error, rss = reference_fit(x, y)
    got = {r.term: r for r in linear.ols(frame, "y", XS).collect()}
    for i, term in enumerate([linear.INTERCEPT, *XS]):
        assert got[term].estimate == pytest.approx(beta[i], rel=1e-6)
        assert got[term].std_error == pytest.approx(error[i], rel=1e-5)
        assert got[term].ci_low < got[term].estimate < got[term].ci_high
    assert got["a"].n == 400 and got["a"].df_residual == 394
    assert got["a"].r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert got["a"].p < 1e-20 and got["d"].p > 1e-4


def test_ols_by_group(frame, table):
    x, y, region = table
    got = linear.ols(frame, "y", XS[:2], by="region_key").collect()
    for g in range(6):
        beta, *_ = reference_fit(x[region == g][:, :2], y[region == g])
        mine = {r.term: r.estimate for r in got if r.region_key == g}
        assert [mine[t] for t in [linear.INTERCEPT, "a", "b"]] == pytest.approx(list(beta), rel=1e-6)


def test_leave_each_out(frame, table):
    x, y, region = table
    got = linear.ols_leave_each_out(frame, "y", XS[:2]).collect()
    assert len(got) == 18
    for g in range(6):
        beta, error, _ = reference_fit(x[region != g][:, :2], y[region != g])
        mine = {r.term: r for r in got if r.region_key == g}
        terms = [linear.INTERCEPT, "a", "b"]
        assert [mine[t].estimate for t in terms] == pytest.approx(list(beta), rel=1e-6)
        assert [mine[t].std_error for t in terms] == pytest.approx(list(error), rel=1e-5)
        one = linear.ols(linear.leave_out(frame, g), "y", XS[:2]).collect()
        assert {r.term: r.n for r in one}["a"] == int((region != g).sum())


def test_repeated_term_is_null_and_changes_nothing(frame):
    df = frame.withColumns({"twice": frame.a * 2, "flat": frame.a * 0 + 3})
    got = {r.term: r for r in linear.ols(df, "y", ["a", "twice", "b", "flat"]).collect()}
    plain = {r.term: r for r in linear.ols(frame, "y", ["a", "b"]).collect()}
    assert got["twice"].estimate is None and got["flat"].estimate is None
    assert got["b"].estimate == pytest.approx(plain["b"].estimate, rel=1e-9)
    assert got["b"].df_residual == plain["b"].df_residual


def test_rows_with_missing_values_are_left_out(spark):
    data = [(1.0, 1.0), (2.0, 2.1), (3.0, 2.9), (None, 5.0), (4.0, None), (float("nan"), 1.0), (5.0, 5.2)]
    df = spark.createDataFrame(data, "x double, y double")
    whole = spark.createDataFrame([d for d in data if None not in d and d[0] == d[0]], "x double, y double")
    assert linear.ols(df, "y", ["x"]).collect() == linear.ols(whole, "y", ["x"]).collect()


def test_large_mean_small_spread(spark):
    rng = np.random.default_rng(5)
    x = 1e8 + rng.normal(size=2000)
    y = 3 * (x - 1e8) + rng.normal(size=2000) * 0.1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(9)
    got = {r.term: r.estimate for r in linear.ols(df, "y", ["x"]).collect()}
    centred = x - x.mean()
    assert got["x"] == pytest.approx(float(centred @ y / (centred @ centred)), rel=1e-9)


@pytest.mark.parametrize("direction", ["backward", "forward", "both"])
@pytest.mark.parametrize("penalty", [2.0, None])
def test_step_search_against_refits(frame, table, direction, penalty):
    x, y, _ = table
    weight = math.log(len(y)) if penalty is None else penalty
    current = [] if direction == "forward" else list(range(5))
    best = aic(x, y, current, weight)
    path = [(set(current), best)]
    while True:
        moves = []
        if direction != "forward":
            moves += [[c for c in current if c != d] for d in current]
        if direction != "backward":
            moves += [[*current, c] for c in range(5) if c not in current]
        score, cols = min((aic(x, y, m, weight), m) for m in moves)
        if score >= best:
            break
        current, best = cols, score
        path.append((set(current), best))
    got = sorted(linear.step_aic(frame, "y", XS, direction=direction, penalty=penalty).collect())
    assert [({XS.index(t) for t in r.terms}) for r in got] == [p[0] for p in path]
    assert [r.criterion for r in got] == pytest.approx([p[1] for p in path], abs=1e-5)
    assert [r.is_final for r in got] == [0] * (len(got) - 1) + [1]
    assert got[-1].criterion <= got[0].criterion


def test_lower_scope_and_corrected_criterion(frame, table):
    x, y, _ = table
    last = max(linear.step_aic(frame, "y", XS, lower=["e"], direction="backward").collect())
    assert "e" in last.terms
    first = min(linear.step_aic(frame, "y", XS, direction="forward", corrected=True).collect())
    n = len(y)
    assert first.criterion == pytest.approx(aic(x, y, []) + 2 * 2 * 3 / (n - 3), abs=1e-6)
    with pytest.raises(ValueError):
        linear.step_aic(frame, "y", XS, direction="sideways")
    with pytest.raises(ValueError):
        linear.step_aic(frame, "y", XS, start=["nope"])


def test_step_fit_is_the_fit_of_the_last_step(frame):
    last = max(linear.step_aic(frame, "y", XS, direction="forward").collect())
    fit = linear.step_fit(frame, "y", XS, direction="forward").collect()
    again = linear.ols(frame, "y", list(last.terms)).collect()
    assert [r.term for r in fit] == [linear.INTERCEPT, *last.terms]
    assert [r.estimate for r in fit] == pytest.approx([r.estimate for r in again], rel=1e-9)


def test_correlations_pairwise(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) + [0, 50, 1e6, 0]
    x[:, 1] += x[:, 0]
    holes = rng.random(x.shape) < 0.2
    data = [tuple(None if h else float(v) for v, h in zip(r, hr)) for r, hr in zip(x, holes)]
    names = ["p", "q", "r", "s"]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.x, r.y): r for r in linear.corr_matrix(df, names).collect()}
    for i, j in combinations(range(4), 2):
        both = ~holes[:, i] & ~holes[:, j]
        r = np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got[names[i], names[j]].r == pytest.approx(r, rel=1e-7, abs=1e-9)
        assert got[names[i], names[j]].n == both.sum()
        assert 0 <= got[names[i], names[j]].p <= 1


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 9.0)], "a double, b double")
    row = linear.corr_matrix(df, ["a", "b"]).first()
    assert (row.r, row.n, row.p) == (None, 3, None)


def test_fit_line(spark, frame, table):
    x, y, _ = table
    row = linear.fit_line(frame, "b", "y").first()
    slope, intercept = np.polyfit(x[:, 1], y, 1)
    assert (row.slope, row.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    assert row.r == pytest.approx(np.corrcoef(x[:, 1], y)[0, 1])
    fit = {r.term: r for r in linear.ols(frame, "y", ["b"]).collect()}
    assert row.p == pytest.approx(fit["b"].p, rel=1e-6)
    assert linear.fit_line(frame, "b", "y", by="region_key").count() == 6


def same(a: Moments, b: Moments, atol=1e-6):
    for name in ("n", "mean", "spread", "cross"):
        assert np.allclose(getattr(a, name), getattr(b, name), rtol=1e-9, atol=atol), name


@pytest.mark.parametrize("holes", [0.0, 0.3])
def test_moments_of_parts_merge_to_the_whole(holes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3)) + [0, 1e5, 3]
    x[rng.random(x.shape) < holes] = np.nan
    if holes:
        x[:10, 1] = np.nan
    whole = Moments.of_rows(x)
    # One stack of nine groups must equal nine separate reductions.
    stack = Moments.of_rows(x, range(0, 90, 10))
    for i in range(9):
        same(stack.take(np.array([i])), Moments.of_rows(x[10 * i : 10 * i + 10]))
    for order in (range(9), reversed(range(9)), [4, 0, 8, 2, 6, 1, 3, 5, 7]):
        same(stack.take(np.array(list(order))).combined([0]), whole)
    pairs = stack.combined([0, 4])
    same(pairs.take(np.array([1])), Moments.of_rows(x[40:]))
    same(pairs.combined([0]), whole)
    others = stack.others()
    for i in range(9):
        same(others.take(np.array([i])), Moments.of_rows(np.delete(x, slice(10 * i, 10 * i + 10), axis=0)))
    outside = Moments.of_rows(x[::7])
    more = stack.others(outside).take(np.array([4]))
    same(more, Moments.of_rows(np.concatenate([np.delete(x, slice(40, 50), axis=0), x[::7]])))
    assert (stack.take(np.array([0])).others().n == 0).all()


def test_null_group_keys_stay_apart(spark):
    df = spark.createDataFrame(
        [(None, 1, 1.0), (None, 1, 3.0), (2, None, 5.0), (2, 1, 7.0), (2, 1, 8.0)], "g int, h int, v double"
    )
    got = {(r.g, r.h): (r.n[0], r["mean"][0]) for r in pair_moments(df, ["v"], ["g", "h"]).collect()}
    assert got == {(None, 1): (2.0, 2.0), (2, None): (1.0, 5.0), (2, 1): (2.0, 7.5)}


def test_groups_over_several_reductions(spark, monkeypatch):
    from rollcall.operators import moments

    monkeypatch.setattr(moments, "HELD_BYTES", 8 * 25)
    df = spark.range(0, 600, 1, 3).selectExpr("id % 60 as g", "cast(id as double) as v")
    with_small_batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(with_small_batches)
    spark.conf.set(with_small_batches, 10)
    try:
        got = {r.g: (r.n[0], r["mean"][0]) for r in pair_moments(df, ["v"], "g").collect()}
    finally:
        spark.conf.set(with_small_batches, old)
    assert got == {g: (10.0, g + 60 * 4.5) for g in range(60)}


def test_path_does_not_depend_on_the_order_of_candidates(frame):
    def path(xs):
        found = linear.step_aic(frame, "y", xs, direction="both").orderBy("step").collect()
        return [(r["move"], sorted(r["terms"]), r["criterion"]) for r in found]

    assert path(XS) == path(XS[::-1])


def test_model_without_residual_freedom_says_so(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)] + [("b", float(i), float(i * i)) for i in range(9)], "g string, y double, x double")
    found = linear.step_aic(df, "y", ["x"], by="g", direction="both").orderBy("g", "step").collect()
    first = found[0]
    assert (first["g"], first["criterion"], first["reason"]) == ("a", None, "no residual freedom")
    assert found[1]["criterion"] is not None and found[1]["reason"] is None


def test_adjusted_r2_and_f(frame, spark):
    rows = [(float(i), float(i % 4), float((7 * i) % 5), 2.0 * i + (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    fit = linear.ols(df, "y", ["a", "b", "c"]).first()
    x = np.column_stack([np.ones(40), np.array(rows)[:, :3]])
    y = np.array(rows)[:, 3]
    rss = float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))
    tss = float(np.sum((y - y.mean()) ** 2))
    assert fit["adj_r2"] == pytest.approx(1 - (rss / 36) / (tss / 39))
    assert fit["f"] == pytest.approx(((tss - rss) / 3) / (rss / 36)) and fit["f_df"] == 3
    assert 0 <= fit["f_p"] < 1e-9


def test_leave_each_out_has_no_task_with_all_regions(frame):
    """Regions are dealt into buckets before any of their rows meet; one step sees the buckets."""
    fits = linear.ols_leave_each_out(frame, "y", ["a"])
    plan = fits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [line for line in plan if "InArrow" in line and "MapInArrow" not in line]

    assert sum("CoGroups" in line for line in steps) == 1
    grouped = [line.split("InArrow ")[1] for line in steps if "CoGroups" not in line]
    assert sum(line.startswith("[_bucket") for line in grouped) == 1
    # Without a key: the bucket totals only.
    assert sum(not line.startswith(("[_bucket", "[region_key")) for line in grouped) == 1


def test_leaving_out_a_region_that_outweighs_all_others(spark):
    """The others keep their digits beside a region with nearly all rows and far larger values."""
    rng = np.random.default_rng(8)
    small = [(r, float(x), float(x + 0.1 * e)) for r in range(1, 11) for x, e in rng.normal(size=(10, 2))]
    x = rng.normal(size=100_000) * 1e6 + 5e6
    hot = spark.createDataFrame(
        [(0, float(a), float(b)) for a, b in zip(x, 3 * x + rng.normal(size=len(x)) * 1e6, strict=True)][:100_000],
        "region_key int, x double, y double",
    )
    df = hot.unionByName(spark.createDataFrame(small, "region_key int, x double, y double"))
    found = {
        (r["region_key"], r["term"]): r for r in linear.ols_leave_each_out(df.repartition(5), "y", ["x"]).collect()
    }
    rest = np.array(small)[:, 1:]
    centred = rest - rest.mean(axis=0)
    slope = (centred[:, 0] @ centred[:, 1]) / (centred[:, 0] @ centred[:, 0])
    assert found[(0, "x")]["estimate"] == pytest.approx(slope, rel=1e-9)
    assert found[(0, "x")]["n"] == len(small) and len(found) == 2 * 11


def test_leave_each_out_of_many_regions_against_refits(spark, monkeypatch):
    monkeypatch.setattr(linear, "MERGE_FAN_IN", 4)
    df = spark.range(0, 3000, 1, 7).selectExpr(
        "if(id % 3 = 0, 0, id % 41) as region_key", "(id * 37 % 101) * 1.5 + 1000 as a", "(id * id) % 89 + id % 5 as y"
    )
    found = {(r["region_key"], r["term"]): r for r in linear.ols_leave_each_out(df, "y", ["a"]).collect()}
    assert len(found) == 2 * 41
    for left in (0, 1, 17, 40):
        for r in linear.ols(df.where(f"region_key <> {left}"), "y", ["a"]).collect():
            got = found[(left, r["term"])]
            assert got["estimate"] == pytest.approx(r["estimate"], rel=1e-9)
            assert got["std_error"] == pytest.approx(r["std_error"], rel=1e-9) and got["n"] == r["n"]


def one_by_one(x, y, penalty):
    """A stepwise search, both ways from no terms, that refits every candidate with lstsq."""
    n = len(y)

    def value(columns):
        design = np.column_stack([np.ones(n), x[:, columns]])
        rss = float(np.sum((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2))
        return n * math.log(rss / n) + penalty * np.linalg.matrix_rank(design)

    current, path = [], []
    best = value(current)
    while True:
        moves = [(value([d for d in current if d != c]), f"- x{c:03}", [d for d in current if d != c]) for c in current]
        moves += [(value([*current, c]), f"+ x{c:03}", [*current, c]) for c in range(x.shape[1]) if c not in current]
        least = min(m[0] for m in moves)
        if least >= best - 1e-7:
            return path, best
        best, move, current = min((m for m in moves if m[0] <= least + 1e-7), key=lambda m: m[1])
        path.append(move)


def made_model(seed, n, p, twins=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1:] += 0.7 * x[:, :-1]
    for a, b in twins:
        x[:, a] = 2 * x[:, b] + 3
    return x, x @ (rng.random(p) < 0.2) + rng.normal(size=n)


@pytest.mark.parametrize("twins", [(), ((3, 7), (9, 4))])
def test_sweeps_give_the_path_of_refits(twins):
    x, y = made_model(4, 150, 18, twins)
    model = linear._Model(Moments.of_rows(np.column_stack([y, x])).take(0))
    names = [f"x{c:03}" for c in range(18)]
    path = linear._search(model, names, [], set(), "both", 2.0, False)
    want, best = one_by_one(x, y, 2.0)
    assert [p["move"] for p in path[1:]] == want
    assert path[-1]["criterion"] == pytest.approx(best, rel=1e-9)
    back = linear._search(model, names, list(range(1, 19)), set(), "both", 2.0, False)
    assert back[0]["criterion"] >= back[-1]["criterion"]
    assert all(a["criterion"] > b["criterion"] for a, b in zip(back, back[1:], strict=False))


def test_sweeping_in_and_out():
    x, y = made_model(5, 80, 9)
    model = linear._Model(Moments.of_rows(np.column_stack([y, x])).take(0))
    swept = linear._Swept(model, [1, 2, 5, 8])
    total = model.cross[0, 0]
    assert swept.share * total == pytest.approx(model.fit([1, 2, 5, 8])[2])
    assert swept.with_column(3)[0] * total == pytest.approx(model.fit([1, 2, 5, 8, 3])[2])
    assert swept.without_column(5)[0] * total == pytest.approx(model.fit([1, 2, 8])[2])
    swept._sweep(5, -1.0)
    assert swept.a == pytest.approx(linear._Swept(model, [1, 2, 8]).a)


def test_two_hundred_candidates():
    x, y = made_model(6, 5000, 200)
    model = linear._Model(Moments.of_rows(np.column_stack([y, x])).take(0))
    names = [f"x{c:03}" for c in range(200)]
    start = time.perf_counter()
    forward = linear._search(model, names, [], set(), "both", math.log(5000), False)
    backward = linear._search(model, names, list(range(1, 201)), set(), "both", math.log(5000), False)
    assert time.perf_counter() - start < 30
    assert forward[-1]["criterion"] == pytest.approx(backward[-1]["criterion"], rel=0.01)


def test_many_partials_of_one_group(spark, monkeypatch):
    from rollcall.operators import moments as module

    df = spark.range(20_000, numPartitions=40).selectExpr(
        "if(id % 3 = 0, 0, id % 50) as g", "id * 0.5 + 1e6 as x", "(id * id) % 97 as y"
    )
    want = {r["g"]: r for r in module.pair_moments(df, ["x", "y"], "g").collect()}
    # Tasks flush early and merges take three at a time.
    monkeypatch.setattr(module, "HELD_BYTES", 4000)
    monkeypatch.setattr(module, "MERGE_FAN_IN", 3)
    got = {r["g"]: r for r in module.pair_moments(df, ["x", "y"], "g").collect()}
    assert got.keys() == want.keys()
    for g, row in want.items():
        for part in module.PARTS:
            assert got[g][part] == pytest.approx(row[part], rel=1e-9, abs=1e-6)


def test_a_task_reduces_its_rows_in_little_memory():
    """However many rows of however many groups a task reads."""
    arrow = pa.schema([("g", pa.int64()), *((p, pa.list_(pa.float64())) for p in moments.PARTS)])
    for groups in (25, 10**9):

        def batches():
            for at in range(0, 2_000_000, 10_000):
                i = np.arange(at, at + 10_000)
                x = (i % 101).astype(float)
                yield pa.record_batch({"g": i % groups, "_x0": x, "_x1": 3 * x + i % 7})

        tracemalloc.start()
        n = 0
        for part in moments.reduced_by_group(batches(), ["_x0", "_x1"], ["g"], arrow, moments.HELD_BYTES):
            n += sum(part.column(1).flatten().to_numpy()[::4])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2_000_000 and peak < 200e6
        if groups == 25:
            assert peak < 50e6
