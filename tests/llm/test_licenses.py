from __future__ import annotations

import random
import re

import pytest

from rollcall.llm import licenses
from tables import documents  # noqa: F401

TEXTS = [
    None, "", " \n", "MIT License", "the MIT  license, mit-license; MIT LICENSES", "mit license mit license",
    "GNU General\nPublic License gnu general public", "CC BY-SA 4.0 and cc  by", "é mit license é", "mitlicense",
    "Apache License, Version 2.0 " * 40, "x " * 20000 + "mit license " + "y " * 20000 + "cc by",
    "mıt license", "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "no licence",
    "SPDX-License-Identifier: (MIT AND", "Redistribution and use in source and binary forms, with",
]


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [
        (i, label)
        for phrase, label in licenses.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = sorted(i for i, _ in found)
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), at[0] if at else None, at[-1] if at else None, labels


def base_of(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def test_base_against_every_place():
    rng = random.Random(2)
    parts = "gnu general public license apache cc by mit , - \n CC-BY é".split(" ")
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        row = licenses.scan(text)
        assert base_of(row) == plain(text), text
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"].replace("spdx:invalid", ""))


@pytest.mark.parametrize(
    ("expression", "order", "freedom"),
    [
        ("MIT", "mit", 1.0),
        ("MIT OR GPL-2.0-only AND BSD-3-Clause", "mit gpl-2.0-only bsd-3-clause and or", 1.0),
        ("(MIT OR GPL-2.0) AND LGPL-2.1+", "mit gpl-2.0 or lgpl-2.1+ and", 0.5),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR Zed", "gpl-2.0 classpath-exception-2.0 with zed or", 0.5),
        ("GPL-3.0-only */ more words", "gpl-3.0-only", 0.3),
        ("((MIT))", "mit", 1.0),
    ],
)
def test_expressions(expression, order, freedom):
    tokens = licenses.postfix(expression)
    assert " ".join(tokens) == order
    assert licenses.evaluate(tokens)[1] == pytest.approx(freedom)


@pytest.mark.parametrize("expression", ["", "OR MIT", "MIT AND", "(MIT", "()", "MIT OR OR GPL", "AND"])
def test_unsound_expressions(expression):
    assert licenses.postfix(expression) is None


def test_tags():
    row = licenses.scan("a\n// SPDX-License-Identifier: MIT OR Foo-1.0\nSPDX-License-Identifier: GPL-2.0+ */")
    assert row["labels"] == "gpl,mit,spdx:foo-1.0" and row["base_labels"] == ""
    assert row["freedom"] == pytest.approx(0.3) and row["score"] > 0.99
    assert licenses.scan("SPDX-License-Identifier: MIT AND (")["labels"] == "spdx:invalid"


@pytest.mark.parametrize(
    ("text", "labels", "freedom"),
    [
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only", "gpl,mit", 0.3),
        ("x SPDX-License-Identifier: MIT OR GPL-2.0 x SPDX-License-Identifier: MPL-2.0 y", "gpl,mit,mpl", 0.6),
        ("SPDX-License-Identifier: SPDX-License-Identifier: MIT", "mit,spdx:invalid", 1.0),
        ("é SPDX-License-\n * Identifier: GPL-2.0-only", "gpl", 0.3),
        ("# SPDX-License-Identifier:\r\n#   MIT\nor not", "mit", 1.0),
        ("SPDX-License-Identifier: (MIT AND\n// GPL-2.0)\nand code", "gpl,mit", 0.3),
        ("SPDX-License-Identifier: MIT OR\n  Apache-2.0\nand code", "apache,mit", 1.0),
        ("MPL-2.0 SPDX-License-Identifier:", "spdx:invalid", None),
    ],
)
def test_every_tag_has_its_expression(text, labels, freedom):
    row = licenses.scan(text)
    assert row["labels"] == labels and row["freedom"] == (freedom if freedom is None else pytest.approx(freedom))


def test_query(spark, small, documents):
    df = documents(list(enumerate(TEXTS)) + [(None, "mit license")], ["1 as n_words", "2 as score", "'l' as labels"])
    from pyspark.sql import functions as F

    got = licenses.scans(df, F.col("text")).selectExpr("_row.doc_id", *licenses.OUT.names).collect()
    assert {r.doc_id: base_of(r) for r in got if r.doc_id is not None} == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert licenses.scans(df.limit(0), F.col("text")).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = licenses.op4_licenses(spark, small).collect()
    assert len(rows) == len(docs) and all(base_of(r) == plain(docs[r.doc_id]) for r in rows)
    assert any(r.n_base for r in rows)
