"""Published study values, recomputed from the study's own tables.

The tables are not part of this repository. Set ROLLCALL_STUDY_DATA to a directory that holds
them; each is found by its header line. Without it these tests are skipped.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollcall.functions.numeric import with_transforms
from rollcall.functions.text import REGION_FIXES
from rollcall.operators import clean, linear, scenario
from rollcall.sources.lists import read_list

STUDY = os.environ.get("ROLLCALL_STUDY_DATA")
pytestmark = pytest.mark.skipif(not STUDY, reason="ROLLCALL_STUDY_DATA is not set")


def find(*columns: str) -> tuple[str, list[str]]:
    """The CSV whose header has these columns, and that header."""
    for path in sorted(Path(STUDY).glob("*.csv")):
        header = [c.strip('"') for c in path.read_text().splitlines()[0].split(",")]
        if set(columns) <= set(header):
            return str(path), header
    pytest.skip(f"no table with {columns}")


@pytest.fixture(scope="module")
def facts(spark):
    path, header = find("party_trend_rank", "totalProtectedSpecies")
    schema = ", ".join(f"{c} {'string' if c == 'state' else 'double'}" for c in header)
    table = read_list(spark, path, schema)
    return with_transforms(
        table,
        log10p1=["totalProtectedSpecies", "endemic_sp"],
        log10=[
            "percent_atrisk", "percent_plants", "percent_birds", "area_sqkm", "total_sp", "popDensity",
            "percent_HuntFish", "percent_FedLand", "Income_2019", "totalImperiled",
        ],
        sqrt=["totalProtectedSpecies", "percent_Farmland"],
        names={
            "log10p1_totalProtectedSpecies": "logTotalProtected",
            "log10p1_endemic_sp": "logEndemic",
            "log10_percent_plants": "logPlants",
            "log10_area_sqkm": "logArea",
            "log10_total_sp": "logTotal_sp",
            "log10_popDensity": "logPop_density",
            "log10_percent_HuntFish": "logHunt_fish",
            "log10_percent_FedLand": "logFedland",
            "log10_Income_2019": "logIncome",
            "log10_totalImperiled": "logTotalImperiled",
            "sqrt_percent_Farmland": "sqrtFarmland",
        },
    )


# The candidate terms of the study's full model.
FULL = [
    "party_trend_rank", "logTotal_sp", "percent_mammals", "percent_reptiles", "percent_amphib",
    "logPlants", "logPop_density", "logArea", "logHunt_fish", "sqrtFarmland", "logFedland",
    "logIncome", "logTotalImperiled",
]


def last(df):
    return df.where("is_final = 1").first()


def test_stepwise_searches(facts):
    y = "logTotalProtected"
    back = last(linear.step_aic(facts, y, FULL, direction="backward"))
    five = {"party_trend_rank", "logArea", "logTotal_sp", "percent_reptiles", "logPop_density"}
    assert set(back.terms) == five and back.criterion == pytest.approx(-47.418561, abs=1e-5)
    both = last(linear.step_aic(facts, y, FULL, direction="both"))
    assert set(both.terms) == five
    one = last(linear.step_aic(facts, y, FULL, direction="both", penalty=1.0))
    assert set(one.terms) == five | {"logPlants"}
    assert one.criterion == pytest.approx(-54.164828, abs=1e-5)
    forward = linear.step_aic(facts, y, FULL, direction="forward")
    assert last(forward).criterion == pytest.approx(-46.211697, abs=1e-5)
    assert last(forward).terms == ["logPop_density", "party_trend_rank", "logArea"]
    assert min(forward.collect()).criterion == pytest.approx(-16.761007, abs=1e-5)
    full = min(linear.step_aic(facts, y, FULL, direction="backward").collect())
    assert full.criterion == pytest.approx(-34.671130, abs=1e-5)


def test_leaving_the_outlier_out(facts):
    rest = facts.where("state <> 'hawaii'")
    wide = [FULL[0], FULL[1], "coast", "log10_percent_birds", *FULL[2:]]
    found = last(linear.step_aic(rest, "logTotalProtected", wide, direction="both"))
    assert len(found.terms) == 11 and found.n == 49
    assert found.criterion == pytest.approx(-43.589724, abs=1e-5)


def test_chosen_coefficients(facts):
    got = {
        r.term: r
        for r in linear.step_fit(facts, "logTotalProtected", FULL, direction="forward").collect()
    }
    # Estimate, standard error, t, p, 2.5% and 97.5% bounds as published.
    want = {
        "(Intercept)": (-3.141356, 1.548633, -2.028, 0.0483, -6.2585929, -0.02412000),
        "logPop_density": (0.949014, 0.212463, 4.467, 5.13e-05, 0.5213478, 1.37668061),
        "party_trend_rank": (-0.017363, 0.006859, -2.532, 0.0148, -0.0311691, -0.00355717),
        "logArea": (0.617591, 0.247580, 2.495, 0.0163, 0.1192378, 1.11594462),
    }
    assert set(got) == set(want)
    for term, (b, se, t, p, low, high) in want.items():
        r = got[term]
        assert (r.estimate, r.std_error) == (pytest.approx(b, abs=1e-6), pytest.approx(se, abs=1e-6))
        assert (r.t, r.p) == (pytest.approx(t, abs=6e-4), pytest.approx(p, rel=5e-3))
        assert (r.ci_low, r.ci_high) == (pytest.approx(low, abs=1e-7), pytest.approx(high, abs=1e-7))


# X, y, n, r, r2, slope, intercept of the study's scatter figures.
LINES = [
    ("totalImperiled", "totalProtectedSpecies", 50, 0.334079, 0.111609, 0.8412441486, 120.9893031449),
    ("party_trend_rank", "totalProtectedSpecies", 50, -0.417385, 0.174210, -5.8458823530, 196.92),
    ("party_trend_rank", "logTotalProtected", 50, -0.541806, 0.293553, -0.0302112976, 1.8496874998),
    ("logArea", "logTotalProtected", 50, -0.244675, 0.059866, -0.4253746442, 4.0117456500),
    ("logPop_density", "totalProtectedSpecies", 50, 0.543055, 0.294909, 187.1318598730, -168.2683039068),
]


@pytest.mark.parametrize("x, y, n, r, r2, slope, intercept", LINES)
def test_lines(facts, x, y, n, r, r2, slope, intercept):
    row = linear.fit_line(facts, x, y).first()
    assert row.n == n
    assert (row.r, row.r2) == (pytest.approx(r, abs=1e-6), pytest.approx(r2, abs=1e-6))
    assert row.slope == pytest.approx(slope, abs=1e-10)
    assert row.intercept == pytest.approx(intercept, abs=1e-10)


def test_line_without_the_outlier(facts):
    rest = linear.leave_out(facts, "hawaii", region="state")
    row = linear.fit_line(rest, "totalImperiled", "totalProtectedSpecies").first()
    assert (row.n, row.slope) == (49, pytest.approx(1.2393737884, rel=1e-9))


def test_all_pairwise_correlations(facts):
    columns = [c for c, t in facts.dtypes if c != "state" and not c.endswith("TotalProtected")]
    columns = [c for c in columns if "totalProtectedSpecies" not in c]
    got = linear.corr_matrix(facts, columns)
    assert got.count() == len(columns) * (len(columns) - 1) // 2
    assert got.where("n <> 50 or abs(r) > 1 or p < 0 or p > 1").count() == 0


def test_cleaning_counts(spark):
    path, header = find("state", "species", "source")
    schema = "state string, species string, source string"
    raw = read_list(spark, path, schema, drop_index=len(header) == 4)
    assert raw.count() == 471
    dropped = ["all oceanic states", "navajo nation", "district of columbia"]
    got = clean.clean_list(raw, ["source"], fixes=REGION_FIXES, drop_regions=dropped)
    assert got.count() == 440
    assert got.select("state").distinct().count() == 51
    assert got.select("species").distinct().count() == 226
    assert got.distinct().select("state", "species").distinct().count() == 440
    assert got.where("species is null").count() == 0
    assert clean.clean_list(raw, ["source"]).count() == 444


def test_policy_groups(spark):
    path, header = find("state", "ESA_included")
    flags = read_list(spark, path, ", ".join(f"{c} string" for c in header), multi_line=True)
    flags = flags.withColumn("region_key", F.lower("state"))
    assert flags.count() == 50
    exceptions = dict.fromkeys(["kentucky", "mississippi", "new jersey", "south carolina"], "E_ONLY")
    exceptions |= {"nevada": "NON_PLANT", "texas": "E_NON_PLANT"}
    policy = scenario.policy_from_flags(flags, "ESA_included", exceptions)
    counts = {r.rule: r["count"] for r in policy.groupBy("rule").count().collect()}
    assert counts == {"ALL": 26, "E_ONLY": 4, "NON_PLANT": 1, "E_NON_PLANT": 1, "NONE": 18}
