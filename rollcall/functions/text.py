"""Column expressions for cleaning names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s and \w are ASCII only; names scraped from the web hold other spaces and letters.
SPACE = r"[\t\n\f\r\p{Z}]"
WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]"

# Patterns that mark a name as genus-only or a placeholder.
GENUS_ONLY = [r"\s(sp).$", r"\s(sp)$"]
PLACEHOLDER = [
    r"\s(sp).$",
    r"\s(sp)$",
    r"\s(ssp)",
    r"\s(var).$",
    r"\s(sp.s)",
    r"\s(spp.)",
    r"\s(species)",
]
NATIONAL_PLACEHOLDER = [r"\s(sp.)$", r"\s(spp.)"]
RANGE_PLACEHOLDER = [r"\s(sp.)$"]
UNRESOLVABLE = [r"\s(new)$", r"Turtle", r"\s(d.)$", r"\s(m.)$", r"\["]

# Misspelt region names and their repair.
REGION_FIXES = {
    "new mex": "new mexico",
    "tennesee": "tennessee",
    "louisianna": "louisiana",
    "massachusettes": "massachusetts",
    "virgina": "virginia",
}
NATIONAL_REGION_FIXES = {"conneticut": "connecticut"}


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_classes(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\w`` widened to all spaces and word characters."""
    return pattern.replace(r"\s", SPACE).replace(r"\w", WORD)


def one_pattern(patterns: Sequence[str]) -> str:
    """All patterns as one alternation, so a name is scanned once.

    Patterns that begin with a space share that test, which most positions of a text fail.
    """
    shared = [p for p in patterns if re.match(r"\\s[^*+?{]", p) and "|" not in p]
    spaced = "|".join(unicode_classes(p[2:]) for p in shared)
    other = [f"(?:{unicode_classes(p)})" for p in patterns if p not in shared]
    return "|".join(([f"{SPACE}(?:{spaced})"] if shared else []) + other)


def name_ok(c: Column | str, patterns: Sequence[str] = PLACEHOLDER) -> Column:
    """True where no pattern matches; null for a null name, which a filter then drops."""
    return ~col_of(c).rlike(one_pattern(patterns))


def binomial(c: Column | str) -> Column:
    """The first two words, split at every single space; null with fewer than two."""
    c = col_of(c)
    return F.when(c.contains(" "), F.substring_index(c, " ", 2))


def remove_first(c: Column | str, pattern: str) -> Column:
    """Delete the first match of a regular expression only."""
    return F.regexp_replace(col_of(c), rf"(?s)\A(.*?)(?:{unicode_classes(pattern)})", "$1")


def strip_parens(c: Column | str) -> Column:
    """The name inside the trailing parenthesis, without brackets and ``=synonym`` marks.

    Null when there is no parenthesis.
    """
    c = col_of(c)
    inner = F.regexp_replace(F.regexp_extract(c, r"\(.*", 0), r"[()]", "")
    return F.when(c.contains("("), F.regexp_replace(inner, unicode_classes(r"=\w+ *"), ""))


def fix_values(c: Column | str, fixes: Mapping[str, str]) -> Column:
    """Replace known misspellings and keep every other value, nulls included."""
    c = col_of(c)
    repaired = None
    for wrong, right in fixes.items():
        arm = (c == F.lit(wrong), F.lit(right))
        repaired = F.when(*arm) if repaired is None else repaired.when(*arm)
    return c if repaired is None else repaired.otherwise(c)


def is_in(c: Column | str, values: Sequence[object]) -> Column:
    """Literal list membership that is never null: a null value is in no list."""
    return F.coalesce(col_of(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Sequence[object]) -> Column:
    """Literal negated list that keeps nulls."""
    return ~is_in(c, values)


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no``, and null where the condition is null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)
