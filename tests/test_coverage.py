"""Coverage against plain Python sets, on random lists with nulls, repeats and a hot key."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollcall.operators import coverage as cov
from rollcall.operators import scenario

LIST = "region_key string, entity_key string"


def random_list(seed: int, size: int, *, regions=8, entities=40) -> list[tuple]:
    """A third of the rows share one entity, some keys are null, no key pair repeats."""
    rng = random.Random(seed)
    pairs = set()
    for i in range(size):
        region = None if rng.random() < 0.05 else f"r{rng.randrange(regions)}"
        entity = "hot" if i % 3 == 0 else None if rng.random() < 0.05 else f"e{rng.randrange(entities)}"
        pairs.add((region, entity))
    return sorted(pairs, key=repr)


def group_of(entity) -> str | None:
    return None if entity is None else f"g{sum(map(ord, entity)) % 4}"


@pytest.fixture(params=[1, 2, 3])
def data(request, spark):
    range_ = random_list(request.param, 120)
    local = random_list(request.param + 10, 50, entities=60)
    national = random_list(request.param + 20, 40, entities=60)
    frames = [
        spark.createDataFrame([(*p, group_of(p[1])) for p in part], LIST + ", grp string")
        for part in (range_, local, national)
    ]
    return (range_, local, national), frames


def test_entities_covered_and_uncovered(data):
    (range_, local, national), (r, l, n) = data
    on = {e for _, e in local}
    either = on | {e for _, e in national}
    all_ = {e for _, e in range_}
    assert rows(cov.on_any(r, l)) == sorted([(e,) for e in all_ & on], key=repr)
    assert rows(cov.not_on(r, l)) == sorted([(e,) for e in all_ - on], key=repr)
    assert rows(cov.not_on(r, [l, n])) == sorted([(e,) for e in all_ - either], key=repr)
    assert rows(cov.on_any(r, [l, n])) == sorted([(e,) for e in all_ & either], key=repr)


def expected_groups(range_, on) -> dict:
    out = defaultdict(lambda: [0, 0])
    for e in {e for _, e in range_}:
        out[group_of(e)][e in on] += 1
    return out


def test_coverage_by_group(data, spark):
    (range_, local, _), (r, l, _) = data
    want = expected_groups(range_, {e for _, e in local})
    got = cov.coverage_by(r, l, "grp")
    assert rows(got, "grp", "total", "not_listed", "listed") == sorted(
        [(g, a + b, a, b) for g, (a, b) in want.items()], key=repr
    )
    entities = sorted({e for _, e in range_ if e is not None})
    attrs = spark.createDataFrame([(e, group_of(e)) for e in entities], "entity_key string, grp string")
    assert rows(cov.coverage_by(r, l, "grp", attrs=attrs)) == rows(got)


def test_rollup_modes(data):
    (range_, local, _), (r, l, _) = data
    want = expected_groups(range_, {e for _, e in local})
    fine = cov.coverage_by(r, l, "grp")
    coarse = {"big": ["g0", "g1"]}

    def rolled(counts):
        out = defaultdict(lambda: [0, 0])
        for g, (a, b) in counts.items():
            name = "big" if g in coarse["big"] else g
            out[name][0] += a
            out[name][1] += b
        return sorted([(g, a + b, a, b, a / (a + b)) for g, (a, b) in out.items()], key=repr)

    assert rows(cov.rollup_groups(fine, "grp", coarse)) == rolled(want)
    kept = {g: c for g, c in want.items() if c[0] > 0}
    assert rows(cov.rollup_groups(fine, "grp", coarse, compat=True)) == rolled(kept)


def test_compat_drops_fully_listed_groups(spark):
    r = spark.createDataFrame([("a", "x", "p"), ("a", "y", "q"), ("a", "z", "p")], LIST + ", grp string")
    l = spark.createDataFrame([("a", "y"), ("a", "x")], LIST)
    assert rows(cov.coverage_by(r, l, "grp"), "grp", "total") == [("p", 2), ("q", 1)]
    assert rows(cov.coverage_by(r, l, "grp", compat=True), "grp", "total") == [("p", 2)]
    fine = cov.coverage_by(r, l, "grp")
    both = {"all": ["p", "q"]}
    assert rows(cov.rollup_groups(fine, "grp", both), "grp", "total") == [("all", 3)]
    assert rows(cov.rollup_groups(fine, "grp", both, compat=True), "grp", "total") == [("all", 2)]


def test_coverage_by_region(data, spark):
    (range_, local, _), (r, l, _) = data
    totals = Counter(x for x, _ in range_)
    listed = Counter(x for x, e in range_ if x is not None and (x, e) in set(local))
    got = rows(cov.coverage_by_region(r, l), "region_key", "total", "listed")
    assert got == sorted([(x, n, listed[x]) for x, n in totals.items()], key=repr)
    joined = cov.coverage_by_region(r, l, small_listing=True)
    assert rows(joined, "region_key", "total", "listed") == got
    regions = spark.createDataFrame([(f"r{i}",) for i in range(12)], "region_key string")
    filled = cov.coverage_by_region(r, l, regions=regions)
    assert filled.count() == 12
    empty = filled.where("region_key = 'r11'").first()
    assert (empty.total, empty.listed, empty.proportion_listed, empty.proportion_not_listed) == (0, 0, 0, 1)
    for row in filled.collect():
        assert row.proportion_listed + row.proportion_not_listed == pytest.approx(1)
    assert cov.covered_by_region(r, l).count() == sum(listed.values())


def test_range_coverage(data):
    (range_, local, _), (r, l, _) = data
    occur, listed = Counter(e for _, e in range_), Counter(e for _, e in local)
    want = [(e, n, listed[e], listed[e] / n) for e, n in occur.items() if e in listed]
    assert rows(cov.range_coverage(r, l)) == sorted(want, key=repr)
    pairs = set(range_)
    within = Counter(e for x, e in local if x is not None and (x, e) in pairs)
    want = [(e, n, within[e], within[e] / n) for e, n in occur.items() if e in listed]
    assert rows(cov.range_coverage(r, l, within_range=True)) == sorted(want, key=repr)
    assert rows(cov.fully_covered(cov.range_coverage(r, l)), "entity_key") == sorted(
        [(e,) for e, n in occur.items() if e in listed and listed[e] >= n], key=repr
    )


def test_single_region(data):
    (_, local, _), (_, l, _) = data
    counts = Counter(e for _, e in local)
    once = {e for e, n in counts.items() if n == 1}
    assert rows(cov.single_region(l), "entity_key") == sorted([(e,) for e in once], key=repr)
    detail = rows(cov.single_region_detail(l), "region_key", "entity_key", "regions_occur")
    assert detail == sorted([(x, e, 1) for x, e in local if e in once], key=repr)


def test_counts_by_region_default_and_placeholder_mode(spark):
    listing = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("d", "x"), ("d", "y")], LIST)
    regions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "region_key string")
    assert rows(cov.counts_by_region(listing, regions)) == [("a", 2), ("b", 1), ("c", 0), ("d", 2)]
    extra = spark.createDataFrame([("c",), ("d",)], "region_key string")
    got = rows(cov.placeholder_counts_by_region(listing, extra))
    assert got == sorted([("a", 2), ("b", None), ("c", None), ("d", 3)], key=repr)
    got = rows(cov.placeholder_counts_by_region(listing, extra, as_zero=True))
    assert got == [("a", 2), ("b", 0), ("c", 0), ("d", 3)]
    split = cov.split_counts_by_region(listing, regions, F.col("entity_key") == "x", ("x", "rest"))
    assert rows(split) == [("a", 1, 1), ("b", 1, 0), ("c", 0, 0), ("d", 1, 1)]


def test_headline(spark):
    table = spark.createDataFrame(
        [("a", 0.6, 0.4), ("b", 0.5, 0.5), ("c", 0.1, 0.9), ("d", 0.6, 0.4)],
        "region_key string, proportion_listed double, proportion_not_listed double",
    )
    row = cov.headline(table).first()
    assert (row.n_regions, row.top_region, row.n_above_half, row.n_half_or_less, row.n_below_third) == (
        4, "d", 2, 2, 1,
    )
    assert row.mean_not_listed == pytest.approx(0.55)


def test_composition(spark):
    df = spark.createDataFrame([("e1", "P"), ("e1", "P"), ("e2", "Q")], "entity_key string, kind string")
    assert rows(cov.composition(df, "kind")) == [("P", 2), ("Q", 1)]
    assert rows(cov.composition(df, "kind", entity="entity_key")) == [("P", 1), ("Q", 1)]


def test_properties(data):
    """Identities that hold for any lists."""
    _, (r, l, n) = data
    def share(x):
        return cov.share_uncovered(r, x).first()

    one, other, both = share(l), share(n), share([l, n])
    assert one.listed + one.not_listed == one.total == r.select("entity_key").distinct().count()
    assert both.not_listed <= min(one.not_listed, other.not_listed)
    assert cov.on_any(r, l).count() == one.listed


# Policy what-if ------------------------------------------------------------------------------


def policy_frame(spark, rules: dict):
    return spark.createDataFrame(list(rules.items()), "region_key string, rule string")


def test_each_rule(spark):
    kinds = [("E", "Plants"), ("T", "Plants"), ("E", "Birds"), ("T", "Birds"), (None, "Birds"), ("E", None)]
    names = ["ALL", "E_ONLY", "NON_PLANT", "E_NON_PLANT", "NONE"]
    national = spark.createDataFrame(
        [(x, f"e{i}", s, g) for x in names for i, (s, g) in enumerate(kinds)],
        LIST + ", status string, group string",
    )
    local = spark.createDataFrame(
        [(x, f"e{i}") for x in [*names, "unruled"] for i in range(7)] + [(None, "e0")], LIST
    )
    left = scenario.apply_policy(local, national, policy_frame(spark, {n: n for n in names}))
    removed = {
        "ALL": {0, 1, 2, 3, 4, 5},
        "E_ONLY": {0, 2, 5},
        "NON_PLANT": {2, 3, 4},
        "E_NON_PLANT": {2},
        "NONE": set(),
        "unruled": set(),
    }
    want = [(x, f"e{i}") for x, gone in removed.items() for i in range(7) if i not in gone]
    assert rows(left) == sorted([*want, (None, "e0")], key=repr)


def test_policy_properties(data, spark):
    _, (r, l, n) = data
    typed = n.withColumns({"status": F.lit("E"), "group": F.lit("Birds")})
    none = policy_frame(spark, {f"r{i}": "NONE" for i in range(8)})
    assert rows(scenario.apply_policy(l, typed, none)) == rows(l)
    everything = policy_frame(spark, {f"r{i}": "ALL" for i in range(8)})
    left = scenario.apply_policy(l, typed, everything)
    assert left.count() <= l.count()
    assert cov.share_uncovered(r, left).first().not_listed >= cov.share_uncovered(r, l).first().not_listed
    twice = policy_frame(spark, {"r0": "ALL"}).unionByName(policy_frame(spark, {"r0": "ALL"}))
    once = scenario.apply_policy(l, typed, policy_frame(spark, {"r0": "ALL"}))
    assert rows(scenario.apply_policy(l, typed, twice)) == rows(once)


def test_change_equals_difference_of_tables(data, spark):
    _, (r, l, n) = data
    regions = spark.createDataFrame([(f"r{i}",) for i in range(9)], "region_key string")
    before = cov.coverage_by_region(r, [l, n], regions=regions)
    after = cov.coverage_by_region(r, l, regions=regions)
    slow = scenario.coverage_delta(before, after)
    fast = scenario.coverage_change(r, [l, n], l, regions=regions)
    cols = ("region_key", "after", "before", "lost", "percent_lost")
    assert rows(slow, *cols) == rows(fast, *cols)


def test_policy_from_flags(spark):
    flags = spark.createDataFrame([("a", "Y"), ("b", "Y"), ("c", "N"), ("d", None)], "region_key string, f string")
    got = scenario.policy_from_flags(flags, "f", {"b": "E_ONLY", "c": "ALL"})
    assert rows(got) == [("a", "ALL"), ("b", "E_ONLY"), ("c", "NONE"), ("d", "NONE")]


def test_repeated_listing_rows_count_a_region_once(spark):
    range_ = spark.createDataFrame([("r1", "e"), ("r2", "e"), ("r2", "e")], LIST)
    listing = spark.createDataFrame([("r1", "e"), ("r1", "e"), ("r3", "e")], LIST)
    found = cov.range_coverage(range_, listing, within_range=True)
    assert rows(found, "regions_occur", "regions_listed", "proportion_listed") == [(2, 1, 0.5)]
    assert cov.fully_covered(found).count() == 0


def test_carried_columns_come_from_one_row(spark):
    range_ = spark.createDataFrame([("r", "e", "b", "x"), ("r", "e", "a", "y")], LIST + ", p string, q string")
    listing = spark.createDataFrame([("r", "e")], LIST)
    found = cov.coverage_by(range_, listing, ["p", "q"])
    assert rows(found, "p", "q", "total", "listed") == [("a", "y", 1, 1)]


def test_policy_marks_agree_with_removing_rows(data, spark):
    _, (r, l, n) = data
    policy = spark.createDataFrame(
        [(f"r{i}", ["ALL", "E_ONLY", "NON_PLANT", "NONE"][i % 4]) for i in range(7)], "region_key string, rule string"
    )
    national = n.withColumns({"status": F.when(F.hash("entity_key") % 2 == 0, "E").otherwise("T"), "group": F.col("grp")})
    left = scenario.apply_policy(l, national, policy)
    keys = ["region_key", "entity_key"]
    marks = scenario.policy_marks(r, l, national, policy)
    want = scenario.coverage_change(r, [l.select(keys), n.select(keys)], left)
    assert rows(scenario.policy_change_by_region(marks), *want.columns) == rows(want)
    types = r.select("entity_key", "grp").distinct()
    want = scenario.coverage_delta(
        cov.coverage_by(r, l, "grp", attrs=types), cov.coverage_by(r, left, "grp", attrs=types), keys="grp"
    )
    got = scenario.policy_change_by_group(marks, types, "grp")
    columns = ["grp", "before", "after", "lost"]
    assert [x for x in rows(got, *columns) if x[0]] == [x for x in rows(want, *columns) if x[0]]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan
