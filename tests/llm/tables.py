from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(rows, extra=None):
        full = [
            (row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")) for row in rows
        ]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.selectExpr("*", *extra) if extra else df

    return make
