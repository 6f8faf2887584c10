"""Cleaning a raw list: keys lowered, repaired, filtered and reduced to two-word names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import (
    UNRESOLVABLE,
    binomial,
    fix_values,
    name_ok,
    not_in,
    remove_first,
)
from rollcall.operators.keys import first_by


def exclude(df: DataFrame, *conditions: Column) -> DataFrame:
    """Drop the rows where any condition holds or is unknown.

    Comparisons with a null are unknown; list membership by ``is_in`` never is.
    """
    for condition in conditions:
        df = df.where(~condition)
    return df


def clean_list(
    df: DataFrame,
    order: Sequence[Column | str],
    *,
    region: str = "state",
    name: str = "species",
    fixes: Mapping[str, str] | None = None,
    drop_regions: Sequence[str] = (),
    exclusions: Sequence[Column] = (),
    first_on_raw: bool = True,
    first_on_clean: bool = False,
) -> DataFrame:
    """Clean one list of (region, name) rows.

    In order: lower-case region; first row per raw key; drop missing regions; repair and drop
    regions; apply exclusion rules; cut names to two words; first row per clean key. ``order``
    says which row of a repeated key is first.
    """
    out = df.withColumn(region, F.lower(region))
    if first_on_raw:
        out = first_by(out, [region, name], order)
    out = out.where(F.col(region).isNotNull())
    if fixes:
        out = out.withColumn(region, fix_values(region, fixes))
    if drop_regions:
        out = out.where(not_in(region, drop_regions))
    out = exclude(out, *exclusions).withColumn(name, binomial(name))
    return first_by(out, [region, name], order) if first_on_clean else out


def repair_accepted(
    df: DataFrame,
    *,
    name: str = "species",
    accepted: str = "accepted_name",
    drop: Sequence[str] = UNRESOLVABLE,
    strip: Sequence[str] = (r"\?", r"\."),
) -> DataFrame:
    """Give rows without an accepted name their own, tidied; drop those that name no species."""
    tidy = F.col(name)
    for pattern in strip:
        tidy = remove_first(tidy, pattern)
    missing = F.col(accepted).isNull()
    kept = df if not drop else df.where(~missing | name_ok(name, drop))
    return kept.withColumn(accepted, F.when(missing, tidy).otherwise(F.col(accepted)))
