from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from rollcall.llm import language_id as li
from rollcall.llm.common import table

PIECES = {"x": ["abcab", "bca", "abcab", "zz"], "y": ["aaab", "ba ca", "b"], "z": ["é"]}


def plain_phrases(text: str, pieces: list[str]) -> int:
    """The longest match from each phrase's begin, by looking into the pieces."""
    letters = {c for p in pieces for c in p}
    phrases, i = 0, 0
    while i < len(text):
        phrases += 1
        i += text[i] not in letters
        n = 0
        while i + n < len(text) and any(text[i : i + n + 1] in p for p in pieces):
            n += 1
        i += n
    return phrases


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=6))
def test_automaton_accepts_what_occurs(pieces):
    moves = li.suffix_automaton(pieces)
    seen = {p[i:j] for p in pieces for i in range(len(p)) for j in range(i, len(p) + 1)} | {""}
    accepted, open_ = set(), [("", 0)]
    while open_:
        word, state = open_.pop()
        accepted.add(word)
        assert len(word) <= 12
        open_ += [(word + c, to) for c, to in moves[state].items()]
    assert accepted == seen
    assert len(moves) <= 2 * sum(map(len, pieces)) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcz é?", max_size=40), max_size=8), st.integers(1, 50))
def test_phrases_against_plain(texts, segment):
    languages = li.Languages(PIECES)
    old, li.SEGMENT = li.SEGMENT, segment
    try:
        found = languages.phrases(pa.array(texts, pa.large_string()))
    finally:
        li.SEGMENT = old
    for i, name in enumerate(languages.names):
        assert found[i].tolist() == [
            sum(plain_phrases(t[at : at + segment], PIECES[name]) for at in range(0, len(t), segment)) for t in texts
        ]


def test_verdict_and_score():
    languages = li.Languages(PIECES)
    texts = ["abcabbca", "aaab", "ééé", "qqq"]
    names, score = languages.verdicts(pa.array(texts, pa.large_string()))
    for text, name, s in zip(texts, names, score, strict=True):
        bits = sorted((plain_phrases(text, p) * np.log2(sum(map(len, p)) + 1), n) for n, p in PIECES.items())
        assert (bits[0][1], 1 - bits[0][0] / bits[1][0]) == (name, s)
    assert li.Languages({}).verdicts(pa.array(texts, pa.large_string()))[0] == [li.UNKNOWN] * 4


DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("score", T.StringType())]
)


def test_edges(spark):
    rng = random.Random(4)
    forms = {"aa": "abcd", "bb": "mnop", "cc": "uvwé"}
    learn = [
        (i, " ".join("".join(rng.choices(forms[x], k=4)) for _ in range(50)), x, "s")
        for x in forms
        for i in range(ord(x[0]) * 100, ord(x[0]) * 100 + 30)
    ]
    odd = [
        (1, None, "aa", ""), (2, "", "aa", ""), (3, "12 345 !", "bb", ""), (4, "Abcd dcba 1 " * 3000, None, ""),
        (5, "MNOP ponm", None, "x"), (5, "MNOP ponm", None, "x"), (None, "vwu wvé", "aa", ""), (6, "Ж字", None, ""),
    ]
    docs = spark.createDataFrame(learn + odd, DOCS).repartition(4)
    got = sorted(map(tuple, li.identified(docs, li.learned(docs)).collect()), key=repr)
    by_id = {r[0]: r for r in got}
    assert len(got) == len(learn) + len(odd)
    assert [by_id[i][2] for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "bb", "cc"]
    assert sum(r[0] == 5 for r in got) == 2 and by_id[6][2] in forms
    assert all(by_id[i][2] == x for i, _, x, _ in learn)
    assert all(0 <= r[3] <= 1 for r in got) and all(by_id[i][3] == 0 for i in (1, 2, 3))
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in got)
    # Held-out labels and rows without a language teach nothing.
    turned = [(i, t, "qq" if zlib.crc32(str(i).encode()) % 3 == 1 else x, s) for i, t, x, s in learn]
    assert li.learned(spark.createDataFrame(turned, DOCS)).names == sorted(forms)
    empty = spark.createDataFrame([], DOCS)
    assert li.identified(empty, li.learned(empty)).collect() == []
    assert {r[2] for r in li.identified(docs, li.learned(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark, small):
    docs = table(spark, small, "documents")
    found = li.identified(docs, li.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_pieces_come_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(li, "OF_ONE", 20 * li.PIECE)
    text = "a" * (li.PIECE * 400) + "b" * (li.PIECE * 400)
    docs = spark.createDataFrame([(i, text, "aa", "") for i in (1, 2, 3, 4)], DOCS)
    made = li.learned(docs)
    assert made.numbers[ord("a")] and made.numbers[ord("b")] and made.sizes.tolist() == [20 * li.PIECE]
