"""Licence scans: phrases and tags by Aho-Corasick, licence expressions by a shunting yard.

A text becomes its words (lower case, no punctuation) with single spaces. One automaton over it
finds every phrase at word borders, however they overlap, in one pass over the whole text. Wherever
it meets the words of an SPDX tag, one expression is read from the raw text between this tag and the
next. It may begin on a later line than the tag and goes on over line ends that leave an operator or
a bracket open. It is brought into postfix order and evaluated: ``or`` is the licensee's choice (the freer side),
``and`` binds to both (the stricter side), ``with`` adds an exception and binds strongest.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import table
from rollcall.llm.registry import query

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
# Starts of SPDX identifiers, their label and how free the licence is (0 to 1).
FAMILIES = {
    "mit": ("mit", 1.0),
    "apache": ("apache", 1.0),
    "bsd": ("bsd", 1.0),
    "isc": ("isc", 1.0),
    "cc0": ("cc0", 1.0),
    "unlicense": ("unlicense", 1.0),
    "cc-by-nc": ("cc-by", 0.2),
    "cc-by": ("cc-by", 0.8),
    "mpl": ("mpl", 0.6),
    "epl": ("epl", 0.6),
    "lgpl": ("lgpl", 0.5),
    "agpl": ("agpl", 0.2),
    "gpl": ("gpl", 0.3),
}
UNKNOWN_FREEDOM, EXCEPTION_BONUS = 0.1, 0.2
#: What a base phrase, a tag with a sound expression, and another notice are worth as evidence.
PHRASE_WEIGHT, TAG_WEIGHT, NOTICE_WEIGHT = 0.7, 0.95, 0.5
#: Binding strength of the operators.
BINDING = {"or": 1, "and": 2, "with": 3}

_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_BEGIN = re.compile(r"[a-z0-9(]")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")

OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("freedom", T.DoubleType()),
])


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", ("base", phrase, label))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", ("notice", phrase, label))
    found.add_word(f" {TAG} ", ("tag", TAG, None))
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str] | None:
    """Tokens in postfix order; None if the expression does not hold together.

    The expression ends where something follows that no operator ties to it, so a comment end or
    prose behind a tag does no harm.
    """
    out: list[str] = []
    waiting: list[str] = []
    after_operand = False
    for token in _TOKEN.findall(expression.lower()):
        if token in BINDING:
            if not after_operand:
                return None
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
            after_operand = False
        elif token == ")":
            if "(" not in waiting:
                break
            if not after_operand:
                return None
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif after_operand:
            break
        elif token == "(":
            waiting.append(token)
        else:
            out.append(token)
            after_operand = True
    if not after_operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def family(identifier: str) -> tuple[str, float]:
    """Label and freedom of an SPDX identifier; unknown ones keep their own name."""
    fits = [x for x in FAMILIES if identifier == x or re.match(rf"{re.escape(x)}[-.+\d]", identifier)]
    return FAMILIES[max(fits, key=len)] if fits else (f"spdx:{identifier}", UNKNOWN_FREEDOM)


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression in postfix order; None if an operator lacks a side."""
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token not in BINDING:
            label, freedom = family(token)
            stack.append(({label}, freedom))
            continue
        if len(stack) < 2:
            return None
        (more, b), (some, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((some | {"exception"}, min(1.0, a + EXCEPTION_BONUS)))
        else:
            stack.append((some | more, max(a, b) if token == "or" else min(a, b)))
    return stack[0] if len(stack) == 1 else None


def behind(text: str) -> str:
    """The expression in the text behind a tag: up to the first line end at which nothing is open."""
    text = text.lower()
    begin = _BEGIN.search(text)
    taken, depth, last = [], 0, "("
    for line in text[begin.start() :].split("\n") if begin else []:
        taken.append(line)
        for last in _TOKEN.findall(line):  # noqa: B007
            depth += (last == "(") - (last == ")")
        if depth <= 0 and last != "(" and last not in BINDING:
            break
    return "\n".join(taken)


def tagged(raw: bytes, places: list[int]) -> list[tuple[set[str], float | None]]:
    """What the expression of each tag says; ``places`` are the numbers of the tags' first words."""
    spans = [x.span() for x in re.finditer(rb"[^ ]+", raw.translate(_WORD_TABLE))]
    ends = [*(spans[x][0] for x in places[1:]), len(raw)]
    out = []
    for place, end in zip(places, ends, strict=True):
        tokens = postfix(behind(raw[spans[place + TAG.count(" ")][1] : end].decode(errors="replace")))
        result = evaluate(tokens) if tokens else None
        out.append(result or ({"spdx:invalid"}, None))
    return out


def scan(text: str | None) -> dict:
    """All counts and labels of one whole text. Null and empty texts have none and score 0."""
    raw = (text or "").encode()
    words = raw.translate(_WORD_TABLE).split()
    base, notices, tags = [], set(), []
    if words:
        joined = b" " + b" ".join(words) + b" "
        counted = at = 0
        starts = []
        for end, (kind, phrase, label) in automaton().iter(joined.decode("latin-1")):
            if kind == "base":
                starts.append((end - len(phrase) - 1, label))
            elif kind == "notice":
                notices.add(label)
            else:
                tags.append(end - len(phrase) - 1)
        for start, label in sorted(starts):
            counted += joined.count(b" ", at, start)
            at = start
            base.append((counted, label))
        counted = at = 0
        for i, start in enumerate(tags):
            counted += joined.count(b" ", at, start)
            at = start
            tags[i] = counted
    expressions = tagged(raw, tags) if tags else []
    base_labels = {label for _, label in base}
    own = notices.union(*(x for x, _ in expressions))
    doubt = (1 - PHRASE_WEIGHT) ** len(base_labels)
    doubt *= (1 - NOTICE_WEIGHT) ** len(notices)
    doubt *= (1 - TAG_WEIGHT) ** sum(f is not None for _, f in expressions)
    freedoms = [f for _, f in expressions if f is not None]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | own)),
        "score": 1 - doubt,
        "freedom": min(freedoms) if freedoms else None,
    }


@F.arrow_udf(OUT)
def _scans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("freedom", pa.float64()),
    ])
    for batch in batches:
        yield pa.array([scan(x.as_py()) for x in batch], kind)


def scans(docs: DataFrame, text: Column, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns (in ``_row``) and what the scan found."""
    both = docs.select(F.struct(*carry).alias("_row"), _scans(text).alias("_scan"))
    return both.select("_row", "_scan.*")


@query("op4_licenses")
def op4_licenses(spark, sf_dir):
    return scans(table(spark, sf_dir, "documents"), F.col("text")).select("_row.doc_id", *OUT.names)
