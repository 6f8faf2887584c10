"""Coverage of a range list by other lists: overall, by group, by region and per entity.

The summaries never join. The range and the listings are stacked with 0/1 marks and grouped by
key once. That is one shuffle, combined on the map side so that a hot key arrives as one row per
map task, and null keys group together as the list semantics want.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.numeric import ratio
from rollcall.operators.keys import (
    ENTITY,
    REGION,
    Keys,
    any_of,
    as_list,
    attach,
    covered,
    unique_side,
)

Listing = DataFrame | Sequence[DataFrame]


def membership(
    range_: DataFrame,
    listings: Mapping[str, DataFrame],
    keys: Keys = ENTITY,
    *,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per key of any input, with row counts ``in_range`` and one count per listing.

    ``carry`` columns are taken together from one range row, the smallest by these columns.
    """
    keys = as_list(keys)
    names = ["in_range", *listings]

    def marked(df: DataFrame, name: str) -> DataFrame:
        marks = [F.lit(1 if n == name else 0).alias(n) for n in names]
        kept = [
            F.col(c) if name == "in_range" else F.lit(None).cast(range_.schema[c].dataType).alias(c)
            for c in carry
        ]
        return df.select(*keys, *kept, *marks)

    stacked = reduce(
        DataFrame.unionByName,
        [marked(range_, "in_range"), *(marked(df, name) for name, df in listings.items())],
    )
    sums = [F.sum(n).alias(n) for n in names]
    if len(carry) < 2:
        return stacked.groupBy(*keys).agg(*(F.min(c).alias(c) for c in carry), *sums)
    row = F.min(F.when(F.col("in_range") == 1, F.struct(*carry))).alias("_row")
    picked = stacked.groupBy(*keys).agg(row, *sums)
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in carry), *names)


def entity_status(
    range_: DataFrame, listing: Listing, entity: str = ENTITY, *, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per range entity: its number of range rows and ``is_listed`` 0/1."""
    status = membership(range_, {"on_list": any_of(listing, entity)}, entity, carry=carry)
    return status.where("in_range > 0").select(
        entity,
        *carry,
        F.col("in_range").alias("n_rows"),
        F.when(F.col("on_list") > 0, 1).otherwise(0).alias("is_listed"),
    )


def summarise(status: DataFrame, group: Keys = ()) -> DataFrame:
    """Totals per group of a 0/1 ``is_listed`` table."""
    return _proportions(
        status.groupBy(*as_list(group)).agg(
            F.count(F.lit(1)).alias("total"),
            F.coalesce(F.sum(1 - F.col("is_listed")), F.lit(0)).alias("not_listed"),
            F.coalesce(F.sum("is_listed"), F.lit(0)).alias("listed"),
        )
    )


def _proportions(df: DataFrame) -> DataFrame:
    return df.withColumn("proportion_not_listed", ratio("not_listed", "total"))


def coverage_by(
    range_: DataFrame,
    listing: Listing,
    group: Keys,
    *,
    attrs: DataFrame | None = None,
    entity: str = ENTITY,
    where: Column | str | None = None,
    min_total: int = 0,
    compat: bool = False,
) -> DataFrame:
    """total, not_listed, listed and proportion_not_listed of range entities per group.

    An entity counts once. The group comes from ``attrs`` (one row per entity) or else from the
    range rows. ``where`` restricts the entities, ``min_total`` the groups. ``compat`` leaves out
    groups without any uncovered entity, as a join that starts from the uncovered side does.
    """
    group = as_list(group)
    if attrs is None:
        status = entity_status(range_, listing, entity, carry=group)
    else:
        status = attach(entity_status(range_, listing, entity), attrs, entity, null_safe=())
    if where is not None:
        status = status.where(where)
    out = summarise(status, group)
    if compat:
        out = out.where("not_listed > 0")
    return out.where(F.col("total") >= min_total) if min_total else out


def rollup_groups(
    coverage: DataFrame,
    group: str,
    mapping: Mapping[str, Sequence[str]],
    *,
    min_total: int = 0,
    compat: bool = False,
) -> DataFrame:
    """Merge fine groups into coarse ones, add up their counts and recompute the proportion.

    ``mapping`` is coarse name to fine names. With ``compat`` a fine group that is fully listed
    does not add to the coarse total.
    """
    coarse: Column | None = None
    for name, members in mapping.items():
        arm = (F.col(group).isin(list(members)), F.lit(name))
        coarse = F.when(*arm) if coarse is None else coarse.when(*arm)
    source = coverage.where("not_listed > 0") if compat else coverage
    if coarse is not None:
        source = source.withColumn(group, coarse.otherwise(F.col(group)))
    out = _proportions(
        source.groupBy(group).agg(
            *(F.sum(c).alias(c) for c in ("total", "not_listed", "listed")),
        )
    )
    return out.where(F.col("total") >= min_total) if min_total else out


def covered_by_region(
    range_: DataFrame, listing: DataFrame, *, region: str = REGION, entity: str = ENTITY
) -> DataFrame:
    """Range rows that are on the listing of their own region."""
    return covered(range_, listing, [region, entity], region=region)


def coverage_by_region(
    range_: DataFrame,
    listing: Listing,
    *,
    regions: DataFrame | None = None,
    small_listing: bool = False,
    region: str = REGION,
    entity: str = ENTITY,
) -> DataFrame:
    """Per region: range rows, those on the region's own listing, and both proportions.

    ``regions`` (one row per region) adds regions without range rows. A region without any
    range or listed row gets proportion_listed 0 and proportion_not_listed 1.

    ``small_listing`` marks the range rows by a join. If Spark finds the listing small enough to
    broadcast, the range is not shuffled at all; if not, the join is a sorted one and the result
    is the same. Leave it off for listings of the range's own size.
    """
    keys = [region, entity]
    if small_listing:
        marks = unique_side(any_of(listing, keys), keys, [F.lit(1).alias("_on_list")])
        counts = (
            attach(range_.select(*keys), marks, keys, null_safe=[entity])
            .groupBy(region)
            .agg(F.count(F.lit(1)).alias("total"), F.count("_on_list").alias("listed"))
        )
    else:
        status = membership(range_, {"on_list": any_of(listing, keys)}, keys)
        on_list = (F.col("on_list") > 0) & F.col(region).isNotNull()
        counts = (
            status.where("in_range > 0")
            .groupBy(region)
            .agg(
                F.sum("in_range").alias("total"),
                F.sum(F.when(on_list, F.col("in_range")).otherwise(0)).alias("listed"),
            )
        )
    if regions is not None:
        counts = attach(regions, counts, region, null_safe=()).fillna(0, ["total", "listed"])
    return counts.withColumns(
        {
            "proportion_listed": F.coalesce(ratio("listed", "total"), F.lit(0.0)),
            "proportion_not_listed": F.coalesce(
                ratio(F.col("total") - F.col("listed"), "total"), F.lit(1.0)
            ),
        }
    )


def range_coverage(
    range_: DataFrame,
    listing: DataFrame,
    *,
    entity: str = ENTITY,
    region: str = REGION,
    within_range: bool = False,
) -> DataFrame:
    """Per entity on both lists: regions it occurs in, regions that list it, and their ratio.

    Rows are counted, so a repeated row or a listing in a region outside the entity's range
    counts too and the ratio may exceed 1; ``within_range`` counts every region once and only
    regions on both lists.
    """
    if within_range:
        pairs = membership(range_, {"on_list": listing.select(region, entity)}, [region, entity])
        occurs = F.col("in_range") > 0
        both = occurs & (F.col("on_list") > 0) & F.col(region).isNotNull()
        counts = pairs.groupBy(entity).agg(
            F.count_if(occurs).alias("regions_occur"),
            F.count_if(both).alias("regions_listed"),
            F.sum("on_list").alias("_anywhere"),
        )
        counts = counts.where("regions_occur > 0 and _anywhere > 0").drop("_anywhere")
    else:
        counts = (
            membership(range_, {"on_list": listing}, entity)
            .where("in_range > 0 and on_list > 0")
            .withColumnsRenamed({"in_range": "regions_occur", "on_list": "regions_listed"})
        )
    return counts.withColumn("proportion_listed", ratio("regions_listed", "regions_occur"))


def fully_covered(coverage: DataFrame) -> DataFrame:
    """Entities listed in at least as many regions as they occur in."""
    return coverage.where("proportion_listed >= 1")


def endemics(coverage: DataFrame) -> DataFrame:
    """Entities that occur in one region only."""
    return coverage.where("regions_occur = 1")


def single_region(listing: DataFrame, *, entity: str = ENTITY) -> DataFrame:
    """Entities with exactly one row on a list."""
    return listing.groupBy(entity).agg(F.count(F.lit(1)).alias("regions_occur")).where(
        "regions_occur = 1"
    )


def single_region_detail(listing: DataFrame, *, entity: str = ENTITY) -> DataFrame:
    """The rows of entities with exactly one row, with that count.

    The only row of such an entity is also its smallest, so no join back is needed.
    """
    rest = [c for c in listing.columns if c != entity]
    return (
        listing.groupBy(entity)
        .agg(F.count(F.lit(1)).alias("regions_occur"), F.min(F.struct(*rest)).alias("_row"))
        .where("regions_occur = 1")
        .select(entity, "_row.*", "regions_occur")
    )


def counts_by_region(
    listing: DataFrame,
    regions: DataFrame,
    *,
    region: str = REGION,
    where: Column | str | None = None,
    out: str = "n",
) -> DataFrame:
    """Rows per region, zero for regions without any."""
    rows = listing if where is None else listing.where(where)
    counts = rows.groupBy(region).agg(F.count(F.lit(1)).alias(out))
    return attach(regions, counts, region, null_safe=()).fillna(0, [out])


def split_counts_by_region(
    listing: DataFrame,
    regions: DataFrame,
    condition: Column,
    names: tuple[str, str],
    *,
    region: str = REGION,
) -> DataFrame:
    """Zero-filled rows per region in two classes, in one pass over the list.

    A row whose condition is null belongs to neither class.
    """
    counts = listing.groupBy(region).agg(
        F.count_if(condition).alias(names[0]), F.count_if(~condition).alias(names[1])
    )
    return attach(regions, counts, region, null_safe=()).fillna(0, list(names))


def placeholder_counts_by_region(
    listing: DataFrame,
    placeholders: DataFrame,
    *,
    region: str = REGION,
    out: str = "n",
    as_zero: bool = False,
) -> DataFrame:
    """Counts after adding one empty row per placeholder region and blanking every count of 1.

    Kept for comparison with published figures: a region with one true row is blanked too, and
    a placeholder region with rows is counted one too high. Use ``counts_by_region`` otherwise.
    """
    rows = listing.select(region).unionByName(placeholders.select(region))
    blank = F.lit(0) if as_zero else F.lit(None)
    return (
        rows.groupBy(region)
        .agg(F.count(F.lit(1)).alias(out))
        .withColumn(out, F.when(F.col(out) == 1, blank).otherwise(F.col(out)))
    )


def headline(coverage: DataFrame, *, region: str = REGION) -> DataFrame:
    """One row about a per-region coverage table. Ties for the top go to the largest key."""
    return coverage.agg(
        F.count(F.lit(1)).alias("n_regions"),
        F.max_by(region, F.struct("proportion_listed", region)).alias("top_region"),
        F.max("proportion_listed").alias("top_proportion_listed"),
        F.count_if(F.col("proportion_listed") > 0.5).alias("n_above_half"),
        F.count_if(F.col("proportion_listed") <= 0.5).alias("n_half_or_less"),
        F.count_if(F.col("proportion_listed") < 1 / 3).alias("n_below_third"),
        F.avg("proportion_not_listed").alias("mean_not_listed"),
    )


def share_uncovered(range_: DataFrame, listing: Listing, entity: str = ENTITY) -> DataFrame:
    """One row: range entities, those on no listing, and their share."""
    return summarise(entity_status(range_, listing, entity))


def composition(entities: DataFrame, category: Keys, *, entity: str | None = None) -> DataFrame:
    """Rows, or distinct entities, of a set per category."""
    category = as_list(category)
    rows = entities.select(*category, entity).distinct() if entity else entities
    return rows.groupBy(*category).agg(F.count(F.lit(1)).alias("n"))


def not_on(listing: DataFrame, other: Listing, entity: str = ENTITY) -> DataFrame:
    """Distinct entities of a list that are on none of the others."""
    return entity_status(listing, other, entity).where("is_listed = 0").select(entity)


def on_any(listing: DataFrame, other: Listing, entity: str = ENTITY) -> DataFrame:
    """Distinct entities of a list that are on at least one of the others."""
    return entity_status(listing, other, entity).where("is_listed = 1").select(entity)
