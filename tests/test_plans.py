"""The shape of physical plans: what must hold when the tables are a thousand times larger."""

from __future__ import annotations

import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from rollcall.operators import coverage as cov
from rollcall.operators import keys, resolve, scenario
from rollcall.plans.catalogue import QUERIES

NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": -1,
    "spark__sql__adaptive__autoBroadcastJoinThreshold": -1,
}
SKEW = NO_BROADCAST | {
    "spark__sql__shuffle__partitions": 64,
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": 100_000,
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": 50_000,
}


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one entity."""
    entity = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40_000)
    return spark.range(0, 900_000, 1, 16).select(
        (F.col("id") % 50).alias("region_key"),
        entity.alias("entity_key"),
        F.xxhash64("id").alias("note"),
    )


@pytest.fixture(scope="module")
def listing(spark):
    return spark.range(0, 60_000, 1, 4).select(
        (F.col("id") % 50).alias("region_key"), (F.col("id") % 20_000).alias("entity_key")
    )


def rest(df):
    """One row that needs every column, so nothing is pruned away."""
    return df.agg(F.count("*"), F.bit_xor("note"))


@pytest.mark.parametrize(
    "operator",
    [
        lambda r, l: keys.covered(r, l),
        lambda r, l: keys.uncovered(r, l),
        lambda r, l: keys.attach(
            r,
            keys.unique_side(l, "entity_key", [F.count(F.lit(1)).alias("n")]),
            "entity_key",
            null_safe=(),
        ).withColumn("note", F.xxhash64("note", "n")),
        lambda r, l: keys.with_group_count(r, "entity_key").withColumn(
            "note", F.xxhash64("note", "n")
        ),
        lambda r, l: resolve.resolve_names(
            r,
            l.select(F.col("entity_key").alias("scientific_name"), F.lit(1).cast("long").alias("standard_name")),
            name="entity_key",
        ).withColumn("note", F.xxhash64("note", "accepted_name")),
    ],
    ids=["covered", "uncovered", "plain key lookup", "group count", "resolve names"],
)
def test_hot_key_is_split_in_row_keeping_joins(settings, hot, listing, operator):
    with settings(**SKEW):
        assert "skew=true" in final_plan(rest(operator(hot, listing)))


def test_hot_region_is_split_in_the_policy_join(spark, settings, hot, listing):
    national = hot.withColumns(
        {
            "region_key": F.when(F.col("note") % 3 == 0, F.lit(7)).otherwise(F.col("region_key")),
            "entity_key": F.col("note"),
            "status": F.lit("E"),
            "group": F.lit("x"),
        }
    )
    policy = spark.range(50).select(
        F.col("id").alias("region_key"), F.when(F.col("id") % 2 == 1, "ALL").otherwise("NONE").alias("rule")
    )
    local = national.select("region_key", "entity_key", "note").where("note % 5 < 2")
    plain = rest(scenario.apply_policy(local, national, policy)).collect()
    with settings(**SKEW):
        left = rest(scenario.apply_policy(local, national, policy))
        plan = final_plan(left)
        assert left.collect() == plain
    joins = [line for line in plan.splitlines() if "SortMergeJoin(skew=true)" in line]
    assert any("_policy_region" in line for line in joins)


def test_hot_key_join_gives_the_same_rows_split_or_not(settings, hot, listing):
    plain = rest(keys.covered(hot, listing)).collect()
    with settings(**SKEW):
        assert rest(keys.covered(hot, listing)).collect() == plain


def test_first_by_cuts_groups_before_the_shuffle(hot):
    plan = initial_plan(keys.first_by(hot, "entity_key", ["note"]))
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_summaries_shuffle_once_per_grouping_and_never_join(hot, listing):
    plan = initial_plan(cov.entity_status(hot, listing))
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    plan = initial_plan(cov.coverage_by_region(hot, listing))
    assert plan.count("Exchange ") == 2 and "Join" not in plan
    plan = initial_plan(cov.range_coverage(hot, listing))
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_small_listing_leaves_the_range_in_place(settings, tmp_path, hot, listing):
    listing.limit(100).write.parquet(str(tmp_path / "listing"))
    small = listing.sparkSession.read.parquet(str(tmp_path / "listing"))
    df = cov.coverage_by_region(hot, small, small_listing=True)
    plan = initial_plan(df)
    assert "BroadcastHashJoin" in plan
    # One shuffle of the listing's keys, one of the per-region counts, none of the range.
    assert plan.count("Exchange hashpartitioning") == 2
    assert sorted(df.collect()) == sorted(cov.coverage_by_region(hot, small).collect())
    with settings(**NO_BROADCAST):
        sorted_join = cov.coverage_by_region(hot, small, small_listing=True)
        assert "SortMergeJoin" in initial_plan(sorted_join)
        assert sorted(sorted_join.collect()) == sorted(df.collect())


def test_hot_key_reaches_the_shuffle_combined(spark, settings, hot, listing):
    """Rows shuffled by the summary are bounded by keys per task, not by rows per key."""
    with settings(spark__sql__shuffle__partitions=8):
        status = cov.entity_status(hot.where("entity_key = 7"), listing.where("entity_key = 7"))
        assert status.first().n_rows > 290_000
        plan = initial_plan(status)
    assert "partial_sum" in plan[plan.index("Exchange") :]


def test_no_query_crosses_or_loops(spark, small, settings):
    with settings(**NO_BROADCAST):
        for name, query in QUERIES.items():
            plan = initial_plan(query(spark, small))
            for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit"):
                assert word not in plan, (name, word)


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = initial_plan(QUERIES["coverage_by_type"](spark, small))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    ranged = next(line for line in scans if "l_discount" in line)
    assert "LessThanOrEqual(l_discount,0.01)" in ranged
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_discount:double>" in ranged
    assert not any("l_shipdate" in line or "p_name" in line for line in scans)


def test_fuzzy_expansion_is_never_broadcast(spark, small):
    df = QUERIES["fuzzy_resolve_two"](spark, small)
    plan = final_plan(df)
    assert "SortMergeJoin [_key" in plan
    assert "REPARTITION_BY_NUM" in plan


def test_leave_each_out_scans_the_rows_once(spark, small):
    assert "ReusedExchange" in final_plan(QUERIES["leave_each_out"](spark, small))


def test_what_if_shuffles_the_local_list_once(spark, small):
    for name in ("coverage_delta", "coverage_delta_by_type"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan
        assert plan.count("l_returnflag") and plan.lower().count("union") == 1


def test_hot_key_is_split_without_the_forced_setting(settings, hot, listing):
    """The join is the last step here; a session does not need the forced split for it."""
    plain = SKEW | {"spark__sql__adaptive__forceOptimizeSkewedJoin": "false"}
    with settings(**plain):
        assert "skew=true" in final_plan(keys.covered(hot, listing))
        assert "skew=true" in final_plan(keys.uncovered(hot, listing))
