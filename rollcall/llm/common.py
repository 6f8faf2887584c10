"""What the operators of this subpackage share: tables, the shared folder, splits, hot joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="rollcall-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back, which ends the lineage.

    Rows that cost much or that several later steps read are kept this way: the written copy is
    complete before the next step starts and does not depend on any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, value: int) -> Column:
    """True for the rows that no model may learn from. A row without an id is not held out."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str],
    *,
    salts: int = 16,
) -> DataFrame:
    """Left join to ``lookup`` (unique on ``key``; null matches null), safe when a key is hot.

    Rows of one key are dealt to ``salts`` tasks by a hash of ``spread_by``; every lookup row is
    repeated for each salt. The lookup side holds one short row per key.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    many = lookup.withColumnRenamed(key, "_lookup_key").withColumn(
        "_lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    joined = rows.withColumn("_salt", salt).join(
        many,
        F.col(key).eqNullSafe(F.col("_lookup_key")) & (F.col("_salt") == F.col("_lookup_salt")),
        "left",
    )
    return joined.drop("_salt", "_lookup_salt", "_lookup_key")
