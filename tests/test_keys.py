"""Joins, first rows, merging and totals, with null keys on either side."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollcall.operators import keys

SCHEMA = "region_key string, entity_key string, note string"


@pytest.fixture
def lists(spark):
    range_ = spark.createDataFrame(
        [("a", "x", "1"), ("a", None, "2"), (None, "x", "3"), ("b", "y", "4"), ("b", "z", "5")],
        SCHEMA,
    )
    listing = spark.createDataFrame(
        [("b", "x", "p"), ("b", "x", "q"), ("b", "y", "r"), ("a", None, "s"), (None, "x", "t")],
        SCHEMA,
    )
    return range_, listing


def test_null_entity_matches_null(lists):
    range_, listing = lists
    assert rows(keys.covered(range_, listing), "note") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(keys.uncovered(range_, listing), "note") == [("5",)]


def test_uncovered_keeps_null_when_the_listing_has_none(lists):
    range_, listing = lists
    known = listing.where("entity_key is not null")
    assert rows(keys.uncovered(range_, known), "note") == [("2",), ("5",)]


def test_region_matches_plainly_and_entity_null_safe(lists):
    range_, listing = lists
    both = ["region_key", "entity_key"]
    assert rows(keys.covered(range_, listing, both), "note") == [("2",), ("4",)]
    assert rows(keys.uncovered(range_, listing, both), "note") == [("1",), ("3",), ("5",)]


def test_several_listings(lists):
    range_, listing = lists
    x = listing.where("entity_key = 'x'")
    y = listing.where("entity_key = 'y'")
    assert rows(keys.uncovered(range_, [x, y]), "note") == [("2",), ("5",)]
    assert rows(keys.covered_any(range_, [x, y]), "note") == [("1",), ("3",), ("4",)]


def test_matching_never_multiplies_rows(lists):
    range_, listing = lists
    many = listing.unionByName(listing).unionByName(listing)
    assert keys.covered(range_, many).count() == 4


def test_first_by_order_and_null_keys(spark):
    df = spark.createDataFrame(
        [("a", None, 3, "late"), ("a", None, 1, "first"), ("a", "x", 2, "n"), (None, "x", 5, "m")],
        "region_key string, entity_key string, at int, note string",
    )
    both = ["region_key", "entity_key"]
    assert rows(keys.first_by(df, both, ["at"]), "note") == [("first",), ("m",), ("n",)]
    assert rows(keys.first_by(df, both, [F.desc("at")]), "note") == [("late",), ("m",), ("n",)]


def test_first_by_tie_is_settled_by_the_other_columns(spark):
    data = [("k", 1, f"n{i:03d}") for i in range(200)]
    df = spark.createDataFrame(data, "k string, at int, note string")
    for n in (1, 3, 16):
        assert rows(keys.first_by(df.repartition(n), "k", ["at"]), "note") == [("n000",)]


def test_merge_lists_priority_and_missing_columns(spark):
    first = spark.createDataFrame([("a", "x", "E")], "region_key string, entity_key string, status string")
    second = spark.createDataFrame(
        [("x", "a", "own"), ("y", "a", "own")], "entity_key string, region_key string, note string"
    )
    merged = keys.merge_lists([first, second])
    assert rows(merged, "region_key", "entity_key", "status", "note", "list_priority") == [
        ("a", "x", "E", None, 1),
        ("a", "y", None, "own", 2),
    ]
    assert merged.groupBy("region_key", "entity_key").count().where("count > 1").count() == 0
    assert keys.stack_lists([first, second]).count() == 3


def test_group_total_and_count_keep_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6), ("b", None)], "g string, v int")
    assert rows(keys.with_group_total(df, "g", "v", "t"), "g", "v", "t") == sorted(
        [("a", 1, 3), ("a", 2, 3), (None, 5, 11), (None, 6, 11), ("b", None, None)], key=repr
    )
    counted = keys.with_group_count(df, "g")
    assert rows(counted, "g", "n") == sorted(
        [("a", 2), ("a", 2), (None, 2), (None, 2), ("b", 1)], key=repr
    )


def test_select_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert keys.select_range(df, "b", "c").columns == ["b", "c"]
    with pytest.raises(ValueError):
        keys.select_range(df, "c", "b")
