"""Reading and writing lists."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_list(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    drop_index: bool = False,
    multi_line: bool = False,
    null_value: str = "NA",
    mode: str = "FAILFAST",
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read a headed CSV by column name; ``NA`` and empty fields become null.

    Columns are found by their names in the header, in any order; columns that ``schema`` does
    not name are left out, and a name that the header lacks is an error. ``drop_index`` says that
    the file begins with an unnamed or row-number column, which ``schema`` must not name.
    ``multi_line`` allows line breaks inside quotes, at the price of unsplittable files.

    A folder (or pattern) may hold files whose headers differ, in order or in columns left out:
    files are grouped by their header line, and each group is read by its own names. An unnamed
    column has the name ``_c`` and its place. An empty file holds no rows.

    A cell that is not of its column's type ends the read, unless ``mode`` is ``PERMISSIVE`` (it
    becomes null; with ``corrupt_column`` the raw line is kept there) or ``DROPMALFORMED``.
    """
    fields = _struct(schema)

    def reader(base: str | None = None) -> DataFrameReader:
        made = (
            spark.read.option("header", True)
            .option("nullValue", null_value)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            .option("multiLine", multi_line)
        )
        # Folders named after values are columns below this path.
        return made.option("basePath", base) if base and not re.search(r"[*?{\[]", base) else made

    declared = {f.name: f for f in fields.fields}

    def of_one_header(reader: DataFrameReader, paths: str | list[str]) -> DataFrame:
        """Files that have the same header."""
        # Without a schema Spark reads the header line only, and every column is a string.
        header = reader.csv(paths).columns
        if missing := [name for name in declared if name not in header]:
            raise ValueError(f"{paths} has no column {missing}; its header is {header}")
        if drop_index and header[0] in declared:
            raise ValueError(f"the first column of {paths} is {header[0]!r}, not an index")
        in_file = [declared.get(name, T.StructField(name, T.StringType())) for name in header]
        # Headers were compared before, and an unnamed column cannot be found by its name.
        typed = reader.option("enforceSchema", True)
        if corrupt_column:
            in_file.append(T.StructField(corrupt_column, T.StringType()))
            typed = typed.option("columnNameOfCorruptRecord", corrupt_column)
        df = typed.option("mode", "PERMISSIVE" if corrupt_column else mode).schema(T.StructType(in_file)).csv(paths)
        kept = [F.col(f"`{corrupt_column}`")] if corrupt_column else []
        return df.select(
            *(
                F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
                if isinstance(f.dataType, T.StringType)
                else F.col(f"`{f.name}`")
                for f in fields.fields
            ),
            *kept,
        )

    groups = _files_by_header(spark, path)
    if len(groups) < 2:
        return of_one_header(reader(), path)
    whole = [of_one_header(reader(path), files) for files in groups]
    return functools.reduce(DataFrame.unionByName, whole)


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under a path, one list for each different first line; one job reads them."""
    lines = spark.read.text(path)
    if len(lines.inputFiles()) < 2:
        return [[path]]
    file = F.col("_metadata.file_path")
    # The first split of a file is in one task, whose rows are numbered in the file's order.
    first = (
        lines.where(F.col("_metadata.file_block_start") == 0)
        .select(file.alias("file"), "value", F.monotonically_increasing_id().alias("row"))
        .groupBy("file")
        .agg(F.min_by("value", "row").alias("header"))
    )
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        # The path comes as a URI; in a list of paths, signs of patterns would be read as such.
        plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(row["file"]))
        found.setdefault(row["header"].rstrip("\r"), []).append(plain)
    return list(found.values())


def write_list(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Iterable[str] = (),
    null_value: str = "NA",
) -> None:
    """Write a list as parquet (default) or CSV. No row number column is added."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        (
            writer.option("header", True)
            .option("nullValue", null_value)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    else:
        writer.format(fmt).save(path)


def load(
    spark: SparkSession, directory: str, name: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One parquet table of a directory; with a schema, nothing is read until it is used."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory}/{name}.parquet")


def inline_list(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)


def region_dimension(df: DataFrame, key: str) -> DataFrame:
    """The distinct non-null region keys of a table."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()
