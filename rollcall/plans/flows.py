"""The four end-to-end studies, each as a set of lazy DataFrames over shared inputs.

Nothing runs until a result is written. Write cleaned lists out (``write_list``) before running
several studies on them: each result otherwise recomputes its inputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from rollcall.functions.text import fix_values
from rollcall.operators import clean, contingency, coverage, linear, resolve, scenario
from rollcall.operators.keys import ENTITY, REGION, first_by, merge_lists

CELLS = ("not_listed", "listed")


def prepare_list(
    raw: DataFrame,
    names: DataFrame,
    order: Sequence[Column | str],
    *,
    region: str = "state",
    name: str = "species",
    raw_name: str = "scientific_name",
    standard: str = "standard_name",
    accepted: str = "accepted_name",
    drop: Sequence[str] = (),
    strip: Sequence[str] = (),
    late_fixes: Mapping[str, str] | None = None,
    extra: DataFrame | None = None,
    **cleaning,
) -> DataFrame:
    """Clean a raw list, resolve its names and make it unique on (region, accepted name).

    ``drop`` and ``strip`` say which unresolved names to discard and what to delete from the
    others. ``extra`` rows (same key columns) complete the list where it has no row.
    """
    cleaned = clean.clean_list(raw, order, region=region, name=name, **cleaning)
    resolved = resolve.resolve_names(
        cleaned, names, name=name, raw=raw_name, standard=standard, out=accepted
    )
    repaired = clean.repair_accepted(resolved, name=name, accepted=accepted, drop=drop, strip=strip)
    if late_fixes:
        repaired = repaired.withColumn(region, fix_values(region, late_fixes))
    if extra is None:
        return first_by(repaired, [region, accepted], order)
    merged = merge_lists([repaired, extra], [region, accepted], order=order)
    return merged.drop("list_priority")


def coverage_study(
    range_: DataFrame,
    listing: coverage.Listing,
    group: str,
    *,
    attrs: DataFrame | None = None,
    mapping: Mapping[str, Sequence[str]] | None = None,
    min_total: int = 10,
    regions: DataFrame | None = None,
    region: str = REGION,
    entity: str = ENTITY,
) -> dict[str, DataFrame]:
    """Coverage by group with its G-tests, coverage by region, and the headline row."""
    groups = coverage.rollup_groups(
        coverage.coverage_by(range_, listing, group, attrs=attrs, entity=entity),
        group,
        mapping or {},
        min_total=min_total,
    )
    by_region = coverage.coverage_by_region(
        range_, listing, regions=regions, region=region, entity=entity
    )
    return {
        "by_group": groups,
        "g_test": contingency.g_test(groups, CELLS),
        "pairwise": contingency.pairwise_g_test(groups, group, CELLS),
        "by_region": by_region,
        "headline": coverage.headline(by_region, region=region),
        "uncovered": coverage.share_uncovered(range_, listing, entity),
    }


def what_if_study(
    range_: DataFrame,
    local: DataFrame,
    national: DataFrame,
    policy: DataFrame,
    group: str,
    *,
    rules: Mapping[str, Column] | None = None,
    regions: DataFrame | None = None,
    region: str = REGION,
    entity: str = ENTITY,
    **options,
) -> dict[str, DataFrame]:
    """The coverage study once more on the local list without imported rows, and the difference."""
    left = scenario.apply_policy(
        local, national, policy, rules=rules, region=region, entity=entity
    )
    again = coverage_study(
        range_, left, group, regions=regions, region=region, entity=entity, **options
    )
    return again | {
        "local_left": left,
        "change": scenario.coverage_change(
            range_, [local, national], left, regions=regions, region=region, entity=entity
        ),
        "national_by_region": coverage.coverage_by_region(
            national, left, regions=regions, region=region, entity=entity
        ),
        "single_region_kept": coverage.on_any(
            coverage.single_region(national, entity=entity), left, entity
        ),
    }


def model_study(
    facts: DataFrame,
    y: str,
    candidates: Sequence[str],
    *,
    correlate: Sequence[str] = (),
    penalty: float | None = 2.0,
) -> dict[str, DataFrame]:
    """Correlations, the full fit, and the backward, forward and two-way searches."""
    return {
        "correlations": linear.corr_matrix(facts, list(correlate) or list(candidates)),
        "full": linear.ols(facts, y, candidates),
        "backward": linear.step_aic(
            facts, y, candidates, direction="backward", penalty=penalty
        ),
        "forward": linear.step_aic(facts, y, candidates, direction="forward", penalty=penalty),
        "both": linear.step_aic(facts, y, candidates, direction="both", penalty=penalty),
        "chosen": linear.step_fit(
            facts, y, candidates, direction="forward", penalty=penalty
        ),
    }
