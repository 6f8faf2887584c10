"""Quality of texts: a generalised additive model with pairwise interactions.

The log odds of a good text are a sum of one function per feature and of functions of a few pairs
of features. Every function is a look-up table over bins. Training goes around the features and
adds to each table a small part of a shallow tree that is fitted to what the sum so far leaves
unexplained; the pairs that explain most of the rest are then treated alike. Scoring is bin
search, look-up and addition for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import table
from rollcall.llm.learning import is_held_out, labelled
from rollcall.llm.registry import query

#: At most so many labelled rows are learnt from.
TRAIN_ROWS = 20_000
#: Bins of a feature alone and in a pair; rounds for features and pairs; pairs that are kept.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS = 32, 8, 150, 60, 6
RATE, SHRINK, LEAST_ROWS = 0.15, 2.0, 10
CUT = 0.3

_SYMBOLS = b"#*$%&|<>~^@_=+{}[]\\"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ENDS = frozenset(b".,;:!?\"')")
FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "shout_share", "digit_share",
    "distinct_share", "adjacent_equal", "equal_lines", "words_per_line", "open_ends", "odd_ends",
    "bars", "longest_word", "repeated_triples", "foreign_share", "capital_words", "marks_share",
)


def features(text: str | None) -> list[float]:
    """Numbers in the order of ``FEATURES``; a null or blank text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))

    def share(characters: bytes) -> int:
        return len(raw) - len(raw.translate(None, characters))

    upper, lower = share(_UPPER), share(_LOWER)
    folded = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    last = bytes(w[-1] for w in words)
    ends = sum(map(last.count, _ENDS))
    letters = len(last) - len(last.translate(None, _UPPER + _LOWER + bytes(range(128, 256))))
    triples = set(zip(folded, folded[1:], folded[2:], strict=False))
    first = bytes(w[0] for w in words)
    return [
        float(np.log1p(n)),
        size / n,
        upper / max(1, upper + lower),
        share(_SYMBOLS) / size,
        share(b"!?") / n,
        share(b"0123456789") / size,
        len(set(folded)) / n,
        sum(map(bytes.__eq__, folded, folded[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        letters / n,
        (n - letters - ends) / n,
        share(b"|") / n,
        float(np.log1p(max(map(len, words)))),
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        share(bytes(range(128, 256))) / size,
        (n - len(first.translate(None, _UPPER))) / n,
        share(b".,;:") / n,
    ]


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal counts; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; no allowed cut: gain 0."""
    if len(g) < 2:
        return 0.0, 0
    a, b, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    gain[(c < LEAST_ROWS) | (n.sum() - c < LEAST_ROWS)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value per bin of a tree with a few leaves: the run with the best cut is cut first."""
    runs = [(0, len(g))]
    for _ in range(leaves - 1):
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in runs]
        gain, at, a, b = max(cuts)
        if gain <= 0:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree on a grid: one cut in one direction, one more in each half."""
    best, values = 0.0, np.zeros_like(g)
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        for at in range(1, len(a)):
            gain, out = 0.0, np.zeros_like(a)
            for part in (slice(0, at), slice(at, None)):
                p, q, r = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                _, cut = _best_cut(p, q, r)
                for s in (slice(0, cut), slice(cut, None)):
                    if r[s].sum():
                        gain += _gain(p[s].sum(), q[s].sum())
                        out[part, s] = p[s].sum() / (q[s].sum() + SHRINK)
            if gain > best:
                best, values = gain, out.T if turn else out
    return best, values


class Gam:
    """Cuts and tables; ``score`` needs nothing else."""

    def __init__(self):
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        if not len(y):
            return self
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        self.edges = [_edges(c, BINS) for c in x.T]
        self.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        odds = np.full(len(y), self.base)
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables, strict=True)]

        def left(bin_of, size):
            p = 1 / (1 + np.exp(-odds))
            return np.bincount(bin_of, y - p, size), np.bincount(bin_of, p * (1 - p), size)

        for _ in range(ROUNDS):
            for b, t, n in zip(bins, self.tables, counts, strict=True):
                step = RATE * _tree(*left(b, len(t)), n)
                t += step
                odds += step[b]
        coarse = [np.searchsorted(e, c, "right") for e, c in zip(self.pair_edges, x.T, strict=True)]
        sizes = [len(e) + 1 for e in self.pair_edges]
        ranked = []
        for i, j in combinations(range(x.shape[1]), 2):
            cell, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
            n = np.bincount(cell, minlength=sizes[i] * sizes[j])
            g, h = left(cell, sizes[i] * sizes[j])
            gain, _ = _pair_tree(g.reshape(shape), h.reshape(shape), n.reshape(shape))
            ranked.append((-gain, i, j, cell, n.reshape(shape)))
        chosen = sorted(ranked, key=lambda r: r[:3])[:PAIRS]
        grids = [np.zeros(n.shape) for *_, n in chosen]
        for _ in range(PAIR_ROUNDS):
            for (_, _, _, cell, n), grid in zip(chosen, grids, strict=True):
                g, h = left(cell, grid.size)
                _, step = _pair_tree(g.reshape(n.shape), h.reshape(n.shape), n)
                grid += RATE * step
                odds += RATE * step.ravel()[cell]
        self.pairs = [(i, j, grid) for (_, i, j, _, _), grid in zip(chosen, grids, strict=True)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            odds += t[np.searchsorted(e, x[:, k], "right")]
        for i, j, grid in self.pairs:
            a = np.searchsorted(self.pair_edges[i], x[:, i], "right")
            b = np.searchsorted(self.pair_edges[j], x[:, j], "right")
            odds += grid[a, b]
        return 1 / (1 + np.exp(-odds))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(x.as_py()) for x in texts]).reshape(-1, len(FEATURES))


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Gam:
    """A model from at most ``TRAIN_ROWS`` labelled documents; no labels: every score is 0.5.

    Only the picked documents are measured. Which rows count, also with null or repeated ids,
    several labels or empty tables, is said at ``labelled``.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(texts)), pa.list_(pa.float64()))

    sample = labelled(docs, labels, "quality", text, TRAIN_ROWS, doc_id, measure=measured).toArrow()
    x = sample["value"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return Gam().fit(x, np.minimum(sample["label"].to_numpy().astype(float), 1))


def score(docs: DataFrame, model: Gam, text: Column) -> Column:
    """Probability of a good text, for every row by itself; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(_matrix(batch)))

    return scores(text)


@query("op6_quality_gam")
def op6_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), score(docs, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
