"""Periodic runs of words: a phrase that stands four times or more in a row.

A run is a stretch of words with smallest period q and length >= max(6, 4 q) that no neighbouring
word extends with that period.

**Grammar.** The words of many texts stand in one string, each text closed by a symbol of its own.
Recompression turns the string into a run-length grammar: in turn, every block of equal symbols
becomes one symbol, and then, with the symbols dealt to a left and a right half, every left symbol
that a right one follows becomes one symbol with it. How a place is cut depends on its neighbours
only, so equal stretches are cut alike but for their edges. Rounds end when every symbol is
different, since nothing longer is then equal.

**Extensions.** How far two places of the string read alike, to either side, takes a walk up the
rounds while whole symbols agree, and down again into the first that differ; at each round at most
a few symbols are compared, blocks by their lengths. All questions take the walk side by side.

**Candidates.** A run with period q and four periods covers a multiple of 3 q with the place q after
it, so for every q only these places are asked: n log n / 3 for a text of n words. Of those
that carry the same word as their partner the grammar tells how far the period holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import table
from rollcall.llm.registry import query

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of texts that share a grammar (a longer text has its own), places asked side by side.
GRAMMAR_WORDS, ASKED = 400_000, 1 << 20


# -- grammar -----------------------------------------------------------------------------------


@dataclass
class Round:
    """The string before one round, and how the round cuts it."""

    symbols: np.ndarray
    blocks: bool
    parent: np.ndarray
    #: Places of the first and of the last symbol of each parent.
    first: np.ndarray
    last: np.ndarray


class Grammar:
    """Recompression of a string whose first and last symbols occur once."""

    def __init__(self, symbols: np.ndarray):
        self.rounds: list[Round] = []
        s, distinct = self._numbered(symbols)
        blocks, idle = True, 0
        while distinct < len(s):
            starts = self._block_starts(s) if blocks else self._pair_starts(s, distinct, len(self.rounds) + idle)
            if starts.all():
                # Nothing to join this time: there are no blocks, or no left symbol before a right one.
                blocks, idle = not blocks, idle + 1
                continue
            first = np.flatnonzero(starts).astype(np.int32)
            last = np.append(first[1:], len(s)).astype(np.int32) - 1
            parent = np.cumsum(starts, dtype=np.int32) - 1
            self.rounds.append(Round(s, blocks, parent, first, last))
            # A block is its symbol and its length, a pair its two symbols, any other symbol itself.
            more = (last - first) if blocks else np.where(last > first, s[last].astype(np.int64) + 1, 0)
            s, distinct = self._numbered(s[first] * (np.int64(more.max()) + 1) + more)
            blocks = not blocks
        self.top = s

    @staticmethod
    def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
        codes, distinct = pd.factorize(values)
        return codes.astype(np.int64), len(distinct)

    @staticmethod
    def _block_starts(s: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], s[1:] != s[:-1]])

    @staticmethod
    def _pair_starts(s: np.ndarray, distinct: int, seed: int) -> np.ndarray:
        """Symbols are dealt to the halves by a hash; of the two ways, the one that joins more."""
        mixed = (np.arange(distinct, dtype=np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left = ((mixed >> np.uint64(40)) & np.uint64(1)).astype(bool)[s]
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        joined = one if one.sum() >= other.sum() else other
        return np.concatenate([[True], ~joined])

    def agree(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from places ``i`` and ``j`` on, forwards (1) or backwards (-1).

        ``i`` and ``j`` differ, both are places before the last and after the first symbol.
        """
        at, other = i.astype(np.int64), j.astype(np.int64)
        #: The round in whose string the two places were found to differ.
        stopped = np.full(len(at), len(self.rounds))
        going = np.arange(len(at))
        for level, r in enumerate(self.rounds):
            a, b = at[going], other[going]
            near, far = (r.first, r.last) if step == 1 else (r.last, r.first)
            for _ in range(2):
                same = r.symbols[a] == r.symbols[b]
                # Where both begin a parent there is nothing to compare below it.
                inside = same & ~((near[r.parent[a]] == a) & (near[r.parent[b]] == b))
                if not inside.any():
                    break
                x, y = a[inside], b[inside]
                moved = self._advance(r, x, y, far, step)
                a[inside], b[inside] = x + step * moved, y + step * moved
            same = r.symbols[a] == r.symbols[b]
            at[going], other[going] = a, b
            stopped[going[~same]] = level
            going, a, b = going[same], a[same], b[same]
            at[going], other[going] = r.parent[a], r.parent[b]
        for level in range(len(self.rounds) - 1, -1, -1):
            r = self.rounds[level]
            down = np.flatnonzero(stopped > level)
            near, far = (r.first, r.last) if step == 1 else (r.last, r.first)
            a, b = near[at[down]].astype(np.int64), near[other[down]].astype(np.int64)
            same = r.symbols[a] == r.symbols[b]
            moved = self._advance(r, a[same], b[same], far, step)
            a[same] += step * moved
            b[same] += step * moved
            at[down], other[down] = a, b
        return step * (at - i)

    @staticmethod
    def _advance(r: Round, a: np.ndarray, b: np.ndarray, far: np.ndarray, step: int):
        """Over equal symbols: one in a round of pairs, as far as both blocks go in one of blocks."""
        if not r.blocks:
            return 1
        return np.minimum(step * (far[r.parent[a]] - a), step * (far[r.parent[b]] - b)) + 1


# -- runs of many texts ------------------------------------------------------------------------


def candidates(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, text) of all places to ask: the multiples of 3 q of each text, for every q."""
    step = LEAST_PERIODS - 1
    most = np.where(lengths >= LEAST_WORDS, lengths // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # Places g * 3 q with a partner q later inside the text.
    places = (lengths[text] - period - 1) // (step * period) + 1
    reached = np.cumsum(places)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + ASKED, "right")))
        n = places[at:end]
        rows = np.repeat(np.arange(at, end), n)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        yield starts[text[rows]] + turn * step * period[rows], period[rows], text[rows]
        at = end


def runs_of(ids: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    """(text, start, length, period) of all runs; ``ids`` are the numbered words of all texts in a row."""
    texts = len(lengths)
    ends = np.cumsum(lengths)
    # Each text begins after a symbol that no other place has, and so does the end.
    string = np.insert(ids, np.append(ends - lengths, ends[-1] if texts else 0), -1 - np.arange(texts + 1))
    starts = ends - lengths + np.arange(texts) + 1
    grammar = None
    found = []
    for place, period, text in candidates(lengths, starts):
        same = string[place] == string[place + period]
        place, period, text = place[same], period[same], text[same]
        if not len(place):
            continue
        grammar = grammar or Grammar(string)
        after = grammar.agree(place, place + period, 1)
        before = grammar.agree(place - 1, place + period - 1, -1)
        length = before + after + period
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([text, place - before - starts[text], length, period])[:, keep])
    columns = ["text", "start", "length", "period"]
    whole = pd.DataFrame(np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1).T, columns=columns)
    # A stretch found with several periods is a run of the smallest; the others are its multiples.
    return whole.groupby(columns[:3], as_index=False)["period"].min().sort_values(["text", "start", "period"])


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words with the repetition that the query's contract puts into every tenth text."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    phrase = words[a : a + p]
    return words[:a] + (phrase * (-(-(n - a) // p)))[: n - a]


NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """Numbers of the runs of one text, and digests of the runs and of what is left of the words."""
    if not len(runs):
        return 0, None, None, None, None, _NO_RUNS, _digest(b" ".join(words))
    best = runs[0]
    for run in runs[1:]:
        # Exact comparison of length / period; the first of equal ones has the smaller start.
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, period = best
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join([words[i] for i in kept.tolist()])
    return len(runs), start, length, period, 1000 * length // period, _digest(listed.encode()), _digest(left)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_NO_RUNS = _digest(b"")


def summarised(texts: list[list[bytes]]) -> list[tuple]:
    """``described`` for texts that share one grammar."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ids, _ = pd.factorize(np.array([w for x in texts for w in x], object))
    runs = runs_of(ids.astype(np.int64), lengths).to_numpy(np.int64)
    cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).tolist()
    return [
        described(words, runs[cuts[i] : cuts[i + 1], 1:].tolist()) for i, words in enumerate(texts)
    ]


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in NUMBERS]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def run_summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, plant: bool = False) -> DataFrame:
    """Per document doc_id, n_runs, the run with most periods, and digests of runs and collapsed text.

    ``plant`` repeats words as the query's contract says; without it texts are taken as they are.
    A null or blank text has no words and no runs. Documents without an id and rows that repeat
    are described each. Other columns are not read, so their names cannot clash; an empty table
    gives no row. Nothing is shuffled: a text is described by itself.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *SCHEMA.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, size, at = batch.column(0), [], 0, 0
            for row in range(batch.num_rows):
                some = (batch.column(1)[row].as_py() or "").encode().split()
                if words and size + len(some) > GRAMMAR_WORDS:
                    yield finished(ids.slice(at, len(words)), words)
                    words, size, at = [], 0, row
                words.append(planted(some, ids[row].as_py()) if plant else some)
                size += len(some)
            if words:
                yield finished(ids.slice(at, len(words)), words)

    def finished(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        columns = list(zip(*summarised(words), strict=True))
        arrays = [pa.array(c, pa.int64() if i < len(NUMBERS) else pa.string()) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *SCHEMA.names])

    return rows.mapInArrow(work, kind)


@query("op11_runs")
def op11_runs(spark, sf_dir):
    return run_summary(table(spark, sf_dir, "documents"), plant=True)
