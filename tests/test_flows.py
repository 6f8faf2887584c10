"""Cleaning steps and the end-to-end studies."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollcall.functions.text import NATIONAL_REGION_FIXES, REGION_FIXES, UNRESOLVABLE
from rollcall.operators import clean
from rollcall.plans import flows
from rollcall.plans.driver_lists import ROLLUP, Lists

RAW = "state string, species string, ranking string, at int"


def test_clean_list_steps(spark):
    raw = spark.createDataFrame(
        [
            ("Tennesee", "Aa bb cc", "E", 2),
            ("tennesee", "Aa bb cc", "T", 1),
            ("Tennessee", "Aa bb dd", "T", 3),
            (None, "Aa bb", "E", 4),
            ("Navajo Nation", "Aa bb", "E", 5),
            ("Utah", "Aa", "E", 6),
            ("New York", "Aa bb", "SC", 7),
            ("New York", "Cc dd", None, 8),
            ("Ohio", "Cc dd", "PRNG", 9),
        ],
        RAW,
    )
    rules = [
        F.coalesce(F.col("ranking").isin("PRNG", "X"), F.lit(False)),
        (F.col("state") == "new york") & (F.col("ranking") == "SC"),
    ]
    got = clean.clean_list(
        raw,
        ["at"],
        fixes=REGION_FIXES,
        drop_regions=["navajo nation"],
        exclusions=rules,
        first_on_clean=True,
    )
    # The unranked New York row is dropped: whether the second rule holds for it is unknown.
    assert rows(got) == [("tennessee", "Aa bb", "T", 1), ("utah", None, "E", 6)]


def test_repair_accepted(spark):
    df = spark.createDataFrame(
        [("Aa bb?.?.", None), ("Aa new", None), ("Aa new", "Xx yy"), ("Aa bb", "Xx yy"), (None, None)],
        "species string, accepted_name string",
    )
    got = rows(clean.repair_accepted(df))
    assert got == sorted(
        [("Aa bb?.?.", "Aa bb?."), ("Aa new", "Xx yy"), ("Aa bb", "Xx yy")], key=repr
    )
    assert clean.repair_accepted(df, drop=()).count() == 5


def test_prepare_list(spark):
    raw = spark.createDataFrame(
        [
            ("Conneticut", "Aa bb x", "E", 1),
            ("Connecticut", "Aa bb y", "T", 2),
            ("Ohio", "Old name", "E", 3),
            ("Ohio", "New name", "T", 4),
            ("Ohio", "Zz d.", "T", 5),
        ],
        RAW,
    )
    names = spark.createDataFrame(
        [("Old name", "New name"), ("Zz d.", None), ("Aa bb", "Aa bb")],
        "scientific_name string, standard_name string",
    )
    extra = spark.createDataFrame(
        [("tennessee", "Qq rr", "E", 9), ("ohio", "New name", "E", 10)],
        "state string, accepted_name string, ranking string, at int",
    )
    got = flows.prepare_list(
        raw, names, ["at"], drop=UNRESOLVABLE, late_fixes=NATIONAL_REGION_FIXES, extra=extra
    )
    assert rows(got, "state", "accepted_name", "ranking") == [
        ("connecticut", "Aa bb", "E"),
        ("ohio", "New name", "E"),
        ("tennessee", "Qq rr", "E"),
    ]
    without = flows.prepare_list(raw, names, ["at"], drop=UNRESOLVABLE)
    assert without.count() == 3


def test_coverage_and_what_if_studies_fit_together(spark, small):
    q = Lists(spark, small)
    options = {"attrs": q.types, "mapping": ROLLUP, "min_total": 1, "regions": q.regions}
    before = flows.coverage_study(q.range_, q.local, "p_type", **options)
    after = flows.what_if_study(
        q.range_, q.local, q.national_typed, q.policy, "p_type", rules=q.rules, **options
    )
    total = before["uncovered"].first()
    assert before["by_group"].agg(F.sum("total")).first()[0] == total.total
    assert before["by_region"].agg(F.sum("total")).first()[0] == q.range_.count()
    k = before["by_group"].count()
    assert before["pairwise"].count() == k * (k - 1) // 2
    assert before["g_test"].first().df == k - 1
    assert after["uncovered"].first().not_listed >= total.not_listed
    assert after["local_left"].count() <= q.local.count()
    assert after["change"].where("lost < 0").count() == 0
    assert after["national_by_region"].count() == after["headline"].first().n_regions == 25
    assert after["single_region_kept"].count() <= q.national.count()


def test_model_study(spark):
    data = [(float(i), float((i * 7) % 11), float(i) * 2 + ((i * 5) % 3)) for i in range(60)]
    df = spark.createDataFrame(data, "a double, b double, y double")
    got = flows.model_study(df, "y", ["a", "b"])
    finals = {
        name: set(got[name].where("is_final = 1").first().terms)
        for name in ("backward", "forward", "both")
    }
    assert all("a" in terms for terms in finals.values())
    assert {r.term for r in got["chosen"].collect()} == {"(Intercept)", *finals["forward"]}
    assert got["correlations"].count() == 1
    assert got["full"].where("term = 'a'").first().estimate == pytest.approx(2, abs=0.05)
