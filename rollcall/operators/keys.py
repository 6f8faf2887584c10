"""Key matching: null-safe joins, first rows and per-key totals that hold under hot keys.

Two plan facts shape this module (both have plan tests):

* The adaptive planner splits a hot partition of a join only where each side of the join is a
  bare shuffle. A side that was made unique by the join keys already sits in the join's
  partitioning, so Spark skips that shuffle, and the split with it. ``unique_side`` groups by a
  hash next to the keys, which leaves the join's own shuffle in place. It costs one more shuffle
  of the unique keys and lets the big side be split however hot one key is.
* ``row_number() = 1`` over a window is cut down to one row per key in every map task before the
  shuffle, so a hot key never reaches a single task whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION = "region_key"
ENTITY = "entity_key"

Keys = str | Sequence[str]


def as_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def unique_side(df: DataFrame, keys: Keys, aggregates: Iterable[Column] = ()) -> DataFrame:
    """One row per key, grouped so that a join on the keys can still be split by skew."""
    keys = as_list(keys)
    hashed = df.withColumn("_spread", F.xxhash64(*keys))
    aggregates = list(aggregates)
    if aggregates:
        return hashed.groupBy("_spread", *keys).agg(*aggregates).drop("_spread")
    return hashed.select("_spread", *keys).distinct().drop("_spread")


def attach(
    left: DataFrame,
    unique: DataFrame,
    keys: Keys,
    how: str = "left",
    *,
    null_safe: Iterable[str] | None = None,
) -> DataFrame:
    """Join rows to a side that is unique on ``keys``.

    ``null_safe`` names the keys where null matches null (default: all of them). The key columns
    of the unique side are dropped from the result.
    """
    keys = as_list(keys)
    twice = (set(left.columns) & set(unique.columns)) - set(keys)
    if twice and how not in ("left_semi", "left_anti"):
        raise ValueError(f"both sides have {sorted(twice)}")
    safe = set(keys if null_safe is None else null_safe)
    renamed = unique.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(
        Column.__and__,
        (
            F.col(k).eqNullSafe(F.col(f"_right_{k}"))
            if k in safe
            else F.col(k) == F.col(f"_right_{k}")
            for k in keys
        ),
    )
    return left.join(renamed, condition, how).drop(*(f"_right_{k}" for k in keys))


def _default_null_safe(keys: list[str], region: str) -> list[str]:
    return [k for k in keys if k != region]


def covered(
    range_: DataFrame, listing: DataFrame, keys: Keys = ENTITY, *, region: str = REGION
) -> DataFrame:
    """Rows of ``range_`` whose key is on ``listing``.

    Null entities match null; null regions match nothing.
    """
    keys = as_list(keys)
    return attach(
        range_,
        unique_side(listing, keys),
        keys,
        "left_semi",
        null_safe=_default_null_safe(keys, region),
    )


def uncovered(
    range_: DataFrame,
    listings: DataFrame | Sequence[DataFrame],
    keys: Keys = ENTITY,
    *,
    region: str = REGION,
) -> DataFrame:
    """Rows of ``range_`` whose key is on none of the listings."""
    keys = as_list(keys)
    return attach(
        range_,
        unique_side(any_of(listings, keys), keys),
        keys,
        "left_anti",
        null_safe=_default_null_safe(keys, region),
    )


def covered_any(
    range_: DataFrame, listings: Sequence[DataFrame], keys: Keys = ENTITY, *, region: str = REGION
) -> DataFrame:
    """Rows of ``range_`` whose key is on at least one of the listings."""
    return covered(range_, any_of(listings, keys), keys, region=region)


def any_of(listings: DataFrame | Sequence[DataFrame], keys: Keys) -> DataFrame:
    """The key columns of one or several listings, stacked."""
    keys = as_list(keys)
    several = [listings] if isinstance(listings, DataFrame) else list(listings)
    return reduce(DataFrame.unionByName, (listing.select(*keys) for listing in several))


def _has_order(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_order(t.elementType)
    if isinstance(t, T.StructType):
        return all(_has_order(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def first_by(df: DataFrame, keys: Keys, order: Sequence[Column | str]) -> DataFrame:
    """The first row per key in a stated order, all columns kept.

    Rows that tie on ``order`` are told apart by their other columns, so a rerun after a lost
    executor picks the same row.
    """
    keys = as_list(keys)
    ties = [f.name for f in df.schema.fields if f.name not in keys and _has_order(f.dataType)]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def merge_lists(
    lists: Sequence[DataFrame],
    keys: Keys = (REGION, ENTITY),
    *,
    order: Sequence[Column | str] = (),
    priority: str = "list_priority",
) -> DataFrame:
    """Stack lists by column name, missing columns as null; the earliest list wins on a key."""
    return first_by(stack_lists(lists, priority=priority), keys, [priority, *order])


def stack_lists(lists: Sequence[DataFrame], *, priority: str = "list_priority") -> DataFrame:
    """Stack lists by column name with missing columns filled by null, numbered from 1."""
    numbered = (df.withColumn(priority, F.lit(i)) for i, df in enumerate(lists, start=1))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def with_group_total(df: DataFrame, group: Keys, value: str, out: str) -> DataFrame:
    """Every row with the sum of ``value`` over its group.

    Summed before the shuffle and joined back, so a group of any size is never in one task.
    """
    totals = unique_side(df, group, [F.sum(value).alias(out)])
    return attach(df, totals, group)


def with_group_count(df: DataFrame, keys: Keys, out: str = "n") -> DataFrame:
    """Every row with the number of rows that share its key."""
    return attach(df, unique_side(df, keys, [F.count(F.lit(1)).alias(out)]), keys)


def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """The columns from ``first`` to ``last`` in table order."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    if start > stop:
        raise ValueError(f"{first!r} comes after {last!r}")
    return df.select(*names[start : stop + 1])
