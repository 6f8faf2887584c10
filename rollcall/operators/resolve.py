"""Resolving names against a table of standard names, exactly and within an edit distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.text import name_ok
from rollcall.operators.keys import attach, first_by, unique_side


def resolve_names(
    df: DataFrame,
    names: DataFrame,
    *,
    name: str = "species",
    raw: str = "scientific_name",
    standard: str = "standard_name",
    out: str = "accepted_name",
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Add the standard name of every row: the table's (possibly null) on a match, else its own.

    ``order`` says which entry of a repeated raw name wins; without it the smallest standard name
    does, and null only where no entry has one.
    """
    entries = names if order is None else first_by(names, raw, order)
    unique = unique_side(
        entries.select(F.col(raw).alias(name), F.col(standard).alias("_entry")),
        name,
        [F.min("_entry").alias("_standard"), F.lit(1).alias("_hit")],
    )
    joined = attach(df, unique, name)
    return joined.withColumn(
        out, F.when(F.col("_hit").isNotNull(), F.col("_standard")).otherwise(F.col(name))
    ).drop("_standard", "_hit")


def unresolved(
    df: DataFrame,
    names: DataFrame,
    *,
    name: str = "species",
    raw: str = "scientific_name",
    patterns: Sequence[str] = (),
) -> DataFrame:
    """Distinct names that the table does not hold, without those a pattern marks as no species."""
    rows = df.select(name)
    if patterns:
        rows = rows.where(name_ok(name, patterns))
    known = names.select(F.col(raw).alias(name)).distinct()
    return attach(rows.distinct(), known, name, "left_anti")


#: Base of the polynomial hashes and its inverse, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Keys that a task makes at a time.
KEYS_AT_ONCE = 1 << 18


def _mixed(points: np.ndarray) -> np.ndarray:
    """A 64-bit number for every code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _deletion_hashes(names: list[str], max_dist: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the name, key) of all strings left by up to ``max_dist`` deletions.

    The hash of a string is the sum of c_j B^j over its characters. With the sums up to every
    place of a name, a deletion moves what follows it down by one power, so a key takes one step
    per deletion however long the name is, and no shorter string is made.
    """
    lengths = np.array([len(x) for x in names], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    ends = starts + lengths
    powers = np.ones(int(lengths.max(initial=0)) + 1, np.uint64)
    powers[1:] = np.uint64(_BASE)
    powers = np.cumprod(powers)
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points) * powers[place])])
    # Of a run of equal characters any one leaves the same string; the first stands for all.
    begins = np.concatenate([[True], points[1:] != points[:-1]]) if len(points) else np.zeros(0, bool)

    def keys(row: np.ndarray, at: np.ndarray, done: np.ndarray, deleted: int) -> Iterator:
        """For names read up to ``at``, of which the hash so far is ``done``."""
        shift = np.uint64(pow(_INVERSE, deleted, 1 << 64))
        yield row, done + shift * (sums[ends[row]] - sums[at])
        if deleted == max_dist:
            return
        open_places = ends[row] - at
        reached = np.cumsum(open_places)
        first = 0
        while first < len(row):
            before = reached[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(reached, before + KEYS_AT_ONCE, "right")))
            some = np.repeat(np.arange(first, last), open_places[first:last])
            gone = at[some] + np.arange(len(some)) - (reached[some] - open_places[some] - before)
            kept = (gone == at[some]) | begins[gone]
            some, gone = some[kept], gone[kept]
            if len(some):
                yield from keys(row[some], gone + 1, done[some] + shift * (sums[gone] - sums[at[some]]), deleted + 1)
            first = last

    yield from keys(np.arange(len(names)), starts, np.zeros(len(names), np.uint64), 0)


def deletion_keys(names: DataFrame, name: str, max_dist: int, out: str = "_key") -> DataFrame:
    """The hash of each name, with hashes of itself and of all strings left by deleting up to
    ``max_dist`` of its characters.

    Two strings within that edit distance always share one: delete the substituted and inserted
    characters on either side. Deletions go from left to right, so every set of places is made
    once. Names travel as hashes: a name of L characters costs L to the power of the distance
    steps and bytes, not L times as many.
    """
    # The adaptive planner packs small names into few tasks by their size before expansion, and
    # drops a repartition by the column they are already hashed on; a hash of it is neither.
    partitions = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = names.select(F.xxhash64(name).alias(name), F.col(name).alias("_name")).repartition(partitions, name)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, key in _deletion_hashes(batch.column(1).to_pylist(), max_dist):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(key.view(np.int64))], [name, out])

    return rows.mapInArrow(expand, f"`{name}` bigint, `{out}` bigint")


#: Names above this length are compared along diagonals instead of cell by cell.
LONG_NAME = 400


def _alike(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree from places ``i`` and ``j`` on, by comparing ever longer slices."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = min(most, n + step), 2 * step
    while step := step // 2:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return n


def near_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, -1 if it is above ``most``.

    For every number of edits and every diagonal, the furthest place reached; equal stretches are
    passed slice by slice, so the work grows with the length and not with its square.
    """
    gap = len(b) - len(a)
    reached = {0: _alike(a, 0, b, 0)}
    for edits in range(most + 1):
        if reached.get(gap, -1) >= len(a):
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            # A character replaced, one of ``b`` put in, one of ``a`` left out.
            ways = (reached.get(k, -2) + 1, reached.get(k - 1, -2), reached.get(k + 1, -2) + 1)
            i = min(max(ways), len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                further[k] = i + _alike(a, i, b, i + k)
        reached = further
    return -1


def _distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, -1 above ``most``; only long names leave the JVM."""

    @F.arrow_udf(T.IntegerType())
    def along_diagonals(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None else near_distance(x, y, most) for x, y in pairs], pa.int32())

    long = F.greatest(F.length(a), F.length(b)) > LONG_NAME
    short = F.when(~long, F.levenshtein(a, b, most))
    return F.coalesce(short, along_diagonals(F.when(long, a), F.when(long, b)))


def _of_like_length(
    names: DataFrame, name: str, other: DataFrame, other_name: str, max_dist: int
) -> DataFrame:
    """The names whose length is among the other side's lengths, widened by the distance."""
    reach = F.explode(F.sequence(F.lit(-max_dist), F.lit(max_dist)))
    near = other.select(F.length(other_name).alias("_length")).distinct()
    near = near.select("_length", reach.alias("_step"))
    near = near.select((F.col("_length") + F.col("_step")).alias("_length"))
    return names.join(unique_side(near, "_length"), F.length(name) == F.col("_length"), "left_semi")


def fuzzy_resolve(
    df: DataFrame,
    backbone: DataFrame,
    *,
    name: str = "species",
    standard: str = "standard_name",
    max_dist: int = 1,
    min_similarity: float = 0.0,
) -> DataFrame:
    """The nearest backbone name of every distinct non-null name, ties to the smallest name.

    Returns name, standard name, edit distance and match type (exact, fuzzy or none); names
    without a match are kept. ``min_similarity`` is a confidence floor on
    1 - distance / length of the longer name.

    Every pair within ``max_dist`` is found: names that close differ in length by no more, so only
    names of a length that the other side has, give or take the distance, are expanded at all, and
    names are compared only when they share a deletion key. All names that share one are within twice
    the distance of each other, so no common prefix, genus or word makes a hot group. Distinct names
    are expanded, not rows, and only hashes of them are joined by key.
    """
    wanted = df.select(name).where(F.col(name).isNotNull()).distinct()
    known = backbone.select(F.col(standard).alias("_known")).where("_known is not null").distinct()
    exact = attach(wanted, known.select(F.col("_known").alias(name), F.lit(1).alias("_hit")), name)
    open_names = exact.where("_hit is null").select(name)
    left = deletion_keys(_of_like_length(open_names, name, known, "_known", max_dist), name, max_dist)
    right = _of_like_length(known, "_known", open_names, name, max_dist)
    right = deletion_keys(right, "_known", max_dist, "_known_key")
    pairs = (
        # Size estimates ignore the expansion; without the hint Spark would broadcast it.
        left.hint("merge")
        .join(right, F.col("_key") == F.col("_known_key"))
        .select(F.col(name).alias("_left"), F.col("_known").alias("_right"))
        .distinct()
    )
    distance = _distance(F.col(name), F.col("_known"), max_dist)
    similarity = 1 - F.col("_distance") / F.greatest(F.length(name), F.length("_known"))
    # Different names with one hash are all compared, so a clash of hashes loses and adds nothing.
    near = (
        pairs.join(open_names.withColumn("_left", F.xxhash64(name)), "_left")
        .join(known.withColumn("_right", F.xxhash64("_known")), "_right")
        .select(name, "_known", distance.alias("_distance"))
        .where((F.col("_distance") >= 0) & (similarity >= min_similarity))
        .select(name, F.struct("_distance", "_known").alias("_match"))
    )
    itself = F.struct(F.lit(0).alias("_distance"), F.col(name).alias("_known"))
    every = exact.select(name, F.when(F.col("_hit") == 1, itself).alias("_match"))
    best = every.unionByName(near).groupBy(name).agg(F.min("_match").alias("_match"))
    return best.select(
        name,
        F.col("_match._known").alias(standard),
        F.col("_match._distance").alias("distance"),
        F.when(F.col("_match").isNull(), "none")
        .when(F.col("_match._distance") == 0, "exact")
        .otherwise("fuzzy")
        .alias("match_type"),
    )


def extend_names(
    names: DataFrame,
    df: DataFrame,
    backbone: DataFrame,
    *,
    name: str = "species",
    raw: str = "scientific_name",
    standard: str = "standard_name",
    patterns: Sequence[str] = (),
    max_dist: int = 1,
    min_similarity: float = 0.0,
) -> DataFrame:
    """The name table with entries for names of ``df`` it lacks, looked up in ``backbone`` again.

    Names without a match stay out of the table, so ``resolve_names`` leaves them as they are and
    ``unresolved`` reports them.
    """
    missing = unresolved(df, names, name=name, raw=raw, patterns=patterns)
    found = fuzzy_resolve(
        missing,
        backbone,
        name=name,
        standard=standard,
        max_dist=max_dist,
        min_similarity=min_similarity,
    )
    entries = found.where(F.col(standard).isNotNull()).select(F.col(name).alias(raw), standard)
    return names.select(raw, standard).unionByName(entries)
