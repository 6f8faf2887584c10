"""What-if: drop the rows a region holds only because its policy takes over the national list."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.numeric import ratio
from rollcall.operators.coverage import Listing, membership
from rollcall.operators.keys import ENTITY, REGION, any_of, attach, unique_side


def standard_rules(
    status: str = "status", group: str = "group", *, plant: str = "Plants", endangered: str = "E"
) -> dict[str, Column]:
    """Which national rows a region takes over, by rule name."""
    is_endangered = F.col(status) == F.lit(endangered)
    no_plant = F.col(group) != F.lit(plant)
    return {
        "ALL": F.lit(True),
        "E_ONLY": is_endangered,
        "NON_PLANT": no_plant,
        "E_NON_PLANT": is_endangered & no_plant,
        "NONE": F.lit(False),
    }


def imported_rows(
    national: DataFrame,
    policy: DataFrame,
    rules: Mapping[str, Column],
    *,
    region: str = REGION,
    rule: str = "rule",
) -> DataFrame:
    """The national rows that each region's policy takes over."""
    chosen = reduce(
        Column.__or__,
        ((F.col(rule) == F.lit(name)) & condition for name, condition in rules.items()),
    )
    # Unique on both columns but joined on one: the join keeps its own shuffle on either side, so
    # a region with most of the rows can be split where the policy is too large to broadcast.
    rules_of = policy.select(F.col(region).alias("_policy_region"), rule)
    policy = unique_side(rules_of, ["_policy_region", rule])
    return (
        national.join(policy, F.col(region) == F.col("_policy_region"))
        .where(chosen)
        .drop("_policy_region", rule)
    )


def apply_policy(
    local: DataFrame,
    national: DataFrame,
    policy: DataFrame,
    *,
    rules: Mapping[str, Column] | None = None,
    region: str = REGION,
    entity: str = ENTITY,
    rule: str = "rule",
) -> DataFrame:
    """The local rows left once every row the region only imported is removed.

    All rules are one condition and all regions one anti join. Local rows without a region or in
    a region without a rule stay.
    """
    rules = standard_rules() if rules is None else rules
    keys = [region, entity]
    # Grouped by the pair as one value: rows of a region must not stay together in one task.
    pairs = (
        imported_rows(national, policy, rules, region=region, rule=rule)
        .select(F.struct(*keys).alias("_pair"))
        .distinct()
        .select("_pair.*")
    )
    return attach(local, pairs, keys, "left_anti", null_safe=[entity])


def policy_marks(
    range_: DataFrame,
    local: DataFrame,
    national: DataFrame,
    policy: DataFrame,
    *,
    rules: Mapping[str, Column] | None = None,
    region: str = REGION,
    entity: str = ENTITY,
    rule: str = "rule",
) -> DataFrame:
    """One row per (region, entity) with counts ``in_range``, ``local``, ``national``, ``imported``.

    ``imported`` counts the national rows that the region's policy takes over. Listed before is
    ``local > 0 or national > 0``, left afterwards is ``local > 0 and imported = 0``: an imported
    row is one more mark, so no list is shuffled twice and nothing is taken away by a join. A null
    region has no policy, so nothing is imported there.
    """
    rules = standard_rules() if rules is None else rules
    chosen = reduce(
        Column.__or__,
        ((F.col(rule) == F.lit(name)) & condition for name, condition in rules.items()),
    )
    rules_of = policy.select(F.col(region).alias("_policy_region"), rule)
    ruled = national.join(
        unique_side(rules_of, ["_policy_region", rule]),
        F.col(region) == F.col("_policy_region"),
        "left",
    )
    names = ("in_range", "local", "national", "imported")

    def marked(df: DataFrame, **marks: Column) -> DataFrame:
        return df.select(region, entity, *(marks.get(n, F.lit(0)).alias(n) for n in names))

    one = F.lit(1)
    stacked = reduce(
        DataFrame.unionByName,
        [
            marked(range_, in_range=one),
            marked(local, local=one),
            marked(ruled, national=one, imported=F.when(chosen, 1).otherwise(0)),
        ],
    )
    return stacked.groupBy(region, entity).agg(*(F.sum(n).alias(n) for n in names))


def policy_change_by_region(
    marks: DataFrame, *, regions: DataFrame | None = None, region: str = REGION
) -> DataFrame:
    """Per region: range rows on either list before, on the reduced local list after, and the loss."""
    known = F.col(region).isNotNull()
    before = known & ((F.col("local") > 0) | (F.col("national") > 0))
    after = known & (F.col("local") > 0) & (F.col("imported") == 0)
    counts = (
        marks.where("in_range > 0")
        .groupBy(region)
        .agg(
            F.sum(F.when(after, F.col("in_range")).otherwise(0)).alias("after"),
            F.sum(F.when(before, F.col("in_range")).otherwise(0)).alias("before"),
        )
    )
    if regions is not None:
        counts = attach(regions, counts, region, null_safe=()).fillna(0, ["after", "before"])
    return _with_loss(counts)


def policy_change_by_group(
    marks: DataFrame, attrs: DataFrame, group: str, *, entity: str = ENTITY
) -> DataFrame:
    """Per group of range entities: those on the local list before and after, and the loss."""
    left = (F.col("local") > 0) & (F.col("imported") == 0)
    entities = marks.groupBy(entity).agg(
        F.max((F.col("in_range") > 0).cast("int")).alias("_in_range"),
        F.max((F.col("local") > 0).cast("int")).alias("_before"),
        F.max(left.cast("int")).alias("_after"),
    )
    typed = attach(entities.where("_in_range = 1"), attrs, entity, null_safe=())
    counts = typed.groupBy(group).agg(F.sum("_after").alias("after"), F.sum("_before").alias("before"))
    return _with_loss(counts)


def coverage_delta(
    before: DataFrame,
    after: DataFrame,
    *,
    keys: str = REGION,
    before_col: str = "listed",
    after_col: str = "listed",
) -> DataFrame:
    """Per key of ``after``: count before, count after, rows lost and the share lost in percent."""
    left = after.select(keys, F.col(after_col).alias("after"))
    right = before.select(keys, F.col(before_col).alias("before"))
    joined = attach(left, right, keys, null_safe=())
    return _with_loss(joined)


def coverage_change(
    range_: DataFrame,
    before: Listing,
    after: Listing,
    *,
    regions: DataFrame | None = None,
    region: str = REGION,
    entity: str = ENTITY,
) -> DataFrame:
    """Per region: range rows covered before and after, rows lost and the share lost in percent.

    The same numbers as ``coverage_delta`` of two coverage tables, from one shuffle of the range
    and both listings instead of two and a join.
    """
    keys = [region, entity]
    status = membership(
        range_, {"_before": any_of(before, keys), "_after": any_of(after, keys)}, keys
    )

    def rows_on(mark: str) -> Column:
        listed = (F.col(mark) > 0) & F.col(region).isNotNull()
        return F.sum(F.when(listed, F.col("in_range")).otherwise(0))

    counts = (
        status.where("in_range > 0")
        .groupBy(region)
        .agg(rows_on("_after").alias("after"), rows_on("_before").alias("before"))
    )
    if regions is not None:
        counts = attach(regions, counts, region, null_safe=()).fillna(0, ["after", "before"])
    return _with_loss(counts)


def _with_loss(counts: DataFrame) -> DataFrame:
    return counts.withColumn("lost", F.col("before") - F.col("after")).withColumn(
        "percent_lost", ratio("lost", "before") * 100
    )


def policy_from_flags(
    flags: DataFrame,
    flag: str,
    exceptions: Mapping[str, str],
    *,
    region: str = REGION,
    yes: str = "Y",
) -> DataFrame:
    """A policy table: ALL where flagged, unless ``exceptions`` names another rule; else NONE."""
    named: Column | None = None
    for key, name in exceptions.items():
        arm = (F.col(region) == F.lit(key), F.lit(name))
        named = F.when(*arm) if named is None else named.when(*arm)
    ruled = F.lit("ALL") if named is None else named.otherwise(F.lit("ALL"))
    return flags.select(
        region, F.when(F.col(flag) == F.lit(yes), ruled).otherwise(F.lit("NONE")).alias("rule")
    )
