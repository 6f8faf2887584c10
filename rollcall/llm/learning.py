"""Labelled rows for the classifiers: a bounded sample, picked alike at every size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import held_out

FOLDS, HELD = 5, 0


def is_held_out(doc_id: str) -> Column:
    """Rows with crc32(doc_id as text) mod 5 = 0: nothing is learnt from their labels."""
    return held_out(doc_id, FOLDS, HELD)


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    text: str,
    rows: int,
    doc_id: str = "doc_id",
    *,
    measure: Callable[[Column], Column],
) -> DataFrame:
    """(label, value) of at most ``rows`` documents to learn from, in the order of a hash of the id.

    The ids are picked from the labels, so that only these documents' texts move; ``rows`` is
    thus also the bound of the broadcast side. ``measure`` makes the value of a text, and is
    applied to the picked documents only, where they were read. A document with several labels has
    the largest; null labels and null ids count for nothing. Documents that share an id share the
    label. Other columns are not read, so their names cannot clash; empty tables give no row.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~is_held_out(doc_id))
    order = F.xxhash64(F.col("_id"), F.lit(label))
    picked = (
        known.groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(order, "_id")
        .limit(rows)
    )
    # Two columns only, so that no name of the documents can clash.
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    found = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    found = found.select("_id", F.col("_label").alias("label"), measure(F.col("_text")).alias("value"))
    return found.orderBy(order, "_id", "value").limit(rows).select("label", "value")
