"""CSV and parquet round trips with nulls, quotes, line breaks and index columns."""

from __future__ import annotations

import pytest
from conftest import rows

from rollcall.sources import lists

SCHEMA = "state string, species string, n int, share double"


def test_read_na_empty_quotes_and_spaces(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'state,species,n,share\n'
        'Ohio,"Aa ""bb"", cc",3,0.5\n'
        'NA,,NA,\n'
        ' Utah ,"",4,NA\n'
    )
    assert rows(lists.read_list(spark, str(path), SCHEMA)) == sorted(
        [("Ohio", 'Aa "bb", cc', 3, 0.5), (None, None, None, None), ("Utah", None, 4, None)], key=repr
    )


def test_index_column_is_dropped(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('"","state","species"\n"1","Ohio","Aa bb"\n"2",NA,"?"\n')
    df = lists.read_list(spark, str(path), "state string, species string", drop_index=True)
    assert df.columns == ["state", "species"]
    assert rows(df) == sorted([("Ohio", "Aa bb"), (None, "?")], key=repr)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('state,species\nOhio,"two\nlines"\n')
    df = lists.read_list(spark, str(path), "state string, species string", multi_line=True)
    assert rows(df) == [("Ohio", "two\nlines")]


def test_round_trips(spark, tmp_path):
    df = lists.inline_list(
        spark, [("Ohio", 'a, "b"', 1, 0.25), (None, None, None, None), ("Utah", "c", 2, 1.5)], SCHEMA
    )
    lists.write_list(df, str(tmp_path / "csv"), fmt="csv")
    assert rows(lists.read_list(spark, str(tmp_path / "csv"), SCHEMA)) == rows(df)
    lists.write_list(df, str(tmp_path / "t.parquet"))
    assert rows(lists.load(spark, str(tmp_path), "t")) == rows(df)
    lists.write_list(df.where("state is not null"), str(tmp_path / "parts"), partition_by=["state"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2


def test_region_dimension(spark):
    df = lists.inline_list(spark, [("a",), ("a",), (None,), ("b",)], "k string")
    assert rows(lists.region_dimension(df, "k")) == [("a",), ("b",)]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("species,note,state,n\nAa bb,x,Ohio,3\n")
    df = lists.read_list(spark, str(path), "state string, species string, n int")
    assert rows(df) == [("Ohio", "Aa bb", 3)]


def test_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("species,state\nAa bb,Ohio\n")
    with pytest.raises(ValueError, match="has no column"):
        lists.read_list(spark, str(path), "state string, n int")
    with pytest.raises(ValueError, match="not an index"):
        lists.read_list(spark, str(path), "species string", drop_index=True)


@pytest.mark.parametrize("bad", ["4.5", "x7"])
def test_bad_cell(spark, tmp_path, bad):
    path = tmp_path / "in.csv"
    path.write_text(f"state,n\nOhio,{bad}\nUtah,2\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|FAILFAST"):
        lists.read_list(spark, str(path), "state string, n int").collect()
    kept = lists.read_list(spark, str(path), "state string, n int", mode="PERMISSIVE")
    assert rows(kept) == sorted([("Ohio", None), ("Utah", 2)], key=repr)
    raw = lists.read_list(spark, str(path), "state string, n int", corrupt_column="bad")
    assert rows(raw) == sorted([("Ohio", None, f"Ohio,{bad}"), ("Utah", 2, None)], key=repr)


def test_folder_of_files_with_different_headers(spark, tmp_path):
    """Two orders, a column that only one file has, an unnamed index column, and an empty file."""
    folder = tmp_path / "a [b] c%d"
    folder.mkdir()
    (folder / "1.csv").write_text('"","state","species"\n"1","Ohio","Aa bb"\n"2",NA,"Cc"\n')
    (folder / "2.csv").write_text('"","species","note","state"\n"1","Dd","x, y","Utah"\n')
    (folder / "3.csv").write_text('"","state","species"\r\n"1","Iowa","Ee"\r\n')
    (folder / "4.csv").write_text("")
    folder = str(folder).replace("[", "\\[").replace("]", "\\]")
    df = lists.read_list(spark, folder, "species string, state string", drop_index=True)
    assert df.columns == ["species", "state"]
    want = [("Aa bb", "Ohio"), ("Cc", None), ("Dd", "Utah"), ("Ee", "Iowa")]
    assert rows(df) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="note"):
        lists.read_list(spark, folder, "species string, note string", drop_index=True)


def test_folders_named_after_values_with_different_headers(spark, tmp_path):
    for year, text in ((2001, "state,n\nOhio,1\n"), (2002, "n,state\n2,Utah\n")):
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "part.csv").write_text(text)
    df = lists.read_list(spark, str(tmp_path), "state string, n int, year int")
    assert rows(df) == [("Ohio", 1, 2001), ("Utah", 2, 2002)]


def test_headers_of_files_read_in_many_splits(spark, tmp_path, settings):
    for name, head in (("a", "state,n"), ("b", "n,state")):
        lines = [f"{'s'},{i}" if name == "a" else f"{i},s" for i in range(5000)]
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *lines]) + "\n")
    with settings(spark__sql__files__maxPartitionBytes=4000, spark__sql__files__openCostInBytes=0):
        df = lists.read_list(spark, str(tmp_path), "state string, n int")
        assert df.groupBy("state").sum("n").collect()[0][1] == 2 * sum(range(5000))
