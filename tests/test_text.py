"""Column expressions on names: null rules, first matches, word splitting."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollcall.functions import numeric, text


def values(spark, data, expr, schema="s string"):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], f"i int, {schema}")
    return [r[1] for r in sorted(df.select("i", expr.alias("v")).collect())]


def test_binomial_edges(spark):
    data = ["Canis lupus baileyi", "Canis lupus", "Canis", "Canis  lupus", "", None, " Canis lupus"]
    want = ["Canis lupus", "Canis lupus", None, "Canis ", None, None, " Canis"]
    assert values(spark, data, text.binomial("s")) == want


def test_remove_first_only(spark):
    data = ["a.b.c", "abc", ".", "x\ny.z.", None]
    assert values(spark, data, text.remove_first("s", r"\.")) == ["ab.c", "abc", "", "x\nyz.", None]


def test_strip_parens(spark):
    data = [
        "Heron, marsh Everywhere (Ardella (=Botaura) palustra)",
        "Seal, grey Everywhere (Halica grisea (=marina))",
        "Fox, dune Everywhere (Vulpina arenosa)",
        "no brackets",
        None,
    ]
    want = ["Ardella palustra", "Halica grisea ", "Vulpina arenosa", None, None]
    assert values(spark, data, text.strip_parens("s")) == want


def test_strip_parens_keeps_accented_synonym_whole(spark):
    assert values(spark, ["x (Aa (=Bééé) bb)"], text.strip_parens("s")) == ["Aa bb"]


@pytest.mark.parametrize("blank", [" ", " ", "\t"])
def test_name_filter_sees_every_kind_of_space(spark, blank):
    data = [f"Cicindela{blank}sp.", f"Cicindela{blank}puritana"]
    df = spark.createDataFrame([(d,) for d in data], "s string")
    assert [r.s for r in df.where(text.name_ok("s")).collect()] == [data[1]]


def test_name_filter_drops_null_and_matches_each_pattern(spark):
    data = ["Aa sp.", "Aa sp", "Aa ssp bb", "Aa var.", "Aa sp.s", "Aa spp. x", "Aa species", "Aa bb"]
    df = spark.createDataFrame([(d,) for d in [*data, None]], "s string")
    assert [r.s for r in df.where(text.name_ok("s")).collect()] == ["Aa bb"]
    bad = ["Aa new", "Box Turtle", "Aa d.", "Aa m.", "Aa [bb]"]
    df = spark.createDataFrame([(d,) for d in [*bad, "Aa bb"]], "s string")
    assert [r.s for r in df.where(text.name_ok("s", text.UNRESOLVABLE)).collect()] == ["Aa bb"]


def test_one_pattern_means_the_same_as_the_patterns(spark):
    import re

    patterns = [r"\s(sp).$", r"\s+x", r"\sa|b", r"^q", r"\s[0-9]"]
    words = ["a sp.", "a  x", "zz a", "bb", "qq", "k 7", "none", "x"]
    simple = [p.replace(r"\s", "[ ]") for p in patterns]
    want = [w for w in words if not any(re.search(p, w) for p in simple)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r.s for r in df.where(text.name_ok("s", patterns)).collect()] == want


def test_fix_values_and_negated_list_keep_nulls(spark):
    data = ["tennesee", "ohio", None]
    assert values(spark, data, text.fix_values("s", text.REGION_FIXES)) == ["tennessee", "ohio", None]
    df = spark.createDataFrame([(d,) for d in data], "s string")
    assert df.where(text.not_in("s", ["ohio"])).count() == 2


def test_if_else_is_null_on_null(spark):
    got = values(spark, ["a", "b", None], text.if_else(F.col("s") == "a", F.lit(1), F.lit(0)))
    assert got == [1, 0, None]


def test_ratio_percent_and_logs(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (0, 4), (1, 0)], "a int, b int")
    got = df.select(
        numeric.ratio("a", "b").alias("r"),
        numeric.percent_int(numeric.ratio("a", "b")).alias("p"),
        numeric.percent_int(numeric.ratio("a", "b"), zero_as_null=False).alias("q"),
        numeric.log10_of("a", 1).alias("l"),
    ).collect()
    assert [r.r for r in got] == [0.5, 1 / 3, 0.0, None]
    assert [r.p for r in got] == [50, 33, None, None]
    assert [r.q for r in got] == [50, 33, 0, None]
    assert got[0].l == pytest.approx(math.log10(2))


def test_log_of_zero_fails_instead_of_turning_null(spark):
    df = spark.createDataFrame([(0.0,)], "a double")
    with pytest.raises(Exception, match="log10 needs values above"):
        df.select(numeric.log10_of("a")).collect()


def test_with_transforms_names(spark):
    df = spark.createDataFrame([(100.0, 9)], "a double, b int")
    out = numeric.with_transforms(
        df, log10=["a"], log10p1=["b"], sqrt=["b"], names={"log10_a": "logA"}
    )
    assert out.columns == ["a", "b", "logA", "log10p1_b", "sqrt_b"]
    assert tuple(out.first()) == (100.0, 9, 2.0, 1.0, 3.0)
