"""Toxicity of texts: a convolutional network over hashed words, with thresholds by language.

A word is the sum of two embedding rows, picked by the hashes of the word and of its first four
bytes, so that unseen endings of a known stem still count. Filters of several widths slide over the whole
text, each keeps its largest answer, and a logistic layer weighs the answers. The network is
trained in numpy on a bounded sample of labelled rows. For scoring, embeddings times filters are
tables, so a text costs look-ups, sums and maxima.

The share of toxic words that tips the scale differs by language, so each language has its own
threshold. The language is guessed from the text's function words; the column ``lang`` is not
read. Answers are scaled so that the threshold of the text's language becomes 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import table
from rollcall.llm.learning import is_held_out, labelled
from rollcall.llm.registry import query

#: At most so many labelled rows are learnt from; every fourth of them sets the thresholds.
TRAIN_ROWS = 12000
BITS, STEM = 15, 4
BUCKETS, DIM, FILTERS, WIDTHS = 1 << BITS, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: A language with fewer toxic rows than this uses the threshold of all.
LEAST_TOXIC = 25
#: Words whose bucket a worker remembers.
REMEMBERED = 100_000
#: Words of a long text that are looked up at once.
PART = 1 << 14

# Frequent function words that few other languages share.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was are with this by from be",
    "de": "der die und den von das mit ist zu für auf ein im dem nicht",
    "fr": "le les des et est une pour dans qui sur du au pas par plus",
    "es": "el los las y del una por con para se su al lo como más",
}
LANGUAGES = (*FUNCTION_WORDS, "other")

_UPPER_TO_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_WORD_BYTES = {*range(48, 58), *range(97, 123), *range(128, 256)}
_TABLE = bytes(
    c if c in _WORD_BYTES else 32 for c in bytes(range(256)).translate(bytes.maketrans(*_UPPER_TO_LOWER))
)


class Buckets(dict):
    """Buckets of a word and, in the upper bits, of its stem: XXH32 modulo their number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        stem = xxhash.xxh32_intdigest(word[:STEM], 1) % BUCKETS
        self[word] = both = xxhash.xxh32_intdigest(word) % BUCKETS | stem << BITS
        return both


_buckets = Buckets()


def hashed(text: str | None) -> np.ndarray:
    """Buckets of all words of a text (letters and digits, lower case, no punctuation)."""
    words = (text or "").encode().translate(_TABLE).split()
    return np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words))


def _rows(ids: np.ndarray) -> np.ndarray:
    """Rows of the embeddings: words come first, then stems, then two rows of zeros."""
    pad = ids < 0
    both = np.stack([ids & (BUCKETS - 1), (ids >> BITS) + BUCKETS])
    both[:, pad] = 2 * BUCKETS
    return both


def _language_table() -> np.ndarray:
    """For each bucket the language whose function words it holds, else the last one."""
    found = np.full(BUCKETS, len(LANGUAGES) - 1, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for word in words.split():
            found[xxhash.xxh32_intdigest(word.encode()) % BUCKETS] = i
    return found


_OF_LANGUAGE = _language_table()


def language(ids: np.ndarray) -> int:
    """The language with most function words in the text; none: other; a tie: the first."""
    seen = np.bincount(_OF_LANGUAGE[ids & (BUCKETS - 1)], minlength=len(LANGUAGES))[:-1]
    return int(seen.argmax()) if seen.any() else len(LANGUAGES) - 1


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with room for the widest filter between them, and their starts."""
    gap = np.full(max(WIDTHS), -1, np.int32)
    lengths = np.array([len(x) + len(gap) for x in texts])
    whole = np.concatenate([y for x in texts for y in (x, gap)])
    return whole, np.concatenate(([0], np.cumsum(lengths)[:-1]))


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.1, (2 * BUCKETS + 1, DIM)).astype(np.float32)
        self.words[-1] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shifts = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.weights = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.float32(-1.0)
        self.thresholds = np.full(len(LANGUAGES), 0.5)

    def start_from(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Begin with what each word says alone: how often it is in toxic texts, against chance."""
        seen, toxic = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
        for ids, label in zip(texts, labels, strict=True):
            once = np.unique(_rows(ids))
            seen[once] += 1
            toxic[once] += label
        base = labels.mean()
        z = (toxic - seen * base) / np.sqrt(seen * base * (1 - base) + 1)
        self.words[:-1, 0] = np.clip(z / 4, -1, 2)
        for w in WIDTHS:
            self.filters[w][:, 0, :] = np.abs(self.filters[w][:, 0, :]) + 0.3

    def _answers(self, ids: np.ndarray, starts: np.ndarray):
        """Largest answer of every filter in every text, and where it was."""
        rows = self.words[ids[0]] + self.words[ids[1]]
        best, places = [], []
        ends = np.append(starts[1:], len(rows)) - max(WIDTHS)
        for w in WIDTHS:
            sums = np.zeros((len(rows), FILTERS), np.float32)
            for k in range(w):
                sums[: len(rows) - k] += rows[k:] @ self.filters[w][k]
            at = np.array(
                [s + (sums[s:e].argmax(0) if e > s else np.zeros(FILTERS, int)) for s, e in zip(starts, ends, strict=True)]
            )
            found = np.take_along_axis(sums, at, 0) + self.shifts[w]
            found[ends <= starts] = 0
            places.append(at)
            best.append(found)
        return rows, np.maximum(np.concatenate(best, 1), 0), places

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 6) -> None:
        """Stochastic gradients with per-weight rates (Adagrad); toxic rows weigh more."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, min(5.0, (1 - labels.mean()) / max(labels.mean(), 1e-3)) ** 0.5, 1.0)
        state: dict = {}

        def move(name, value, slope, rows=None):
            kept = state.setdefault(name, np.full(value.shape, 0.1, np.float32))
            if rows is None:
                kept += slope * slope
                value -= RATE * slope / np.sqrt(kept)
            else:
                kept[rows] += slope * slope
                value[rows] -= RATE * slope / np.sqrt(kept[rows])

        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                ids, starts = _padded([texts[i] for i in some])
                ids = _rows(ids)
                rows, answers, places = self._answers(ids, starts)
                odds = answers @ self.weights + self.bias
                slope = (1 / (1 + np.exp(-odds)) - labels[some]) * weight[some] / len(some)
                slope = slope.astype(np.float32)
                back = slope[:, None] * self.weights * (answers > 0)
                touched, moves = [], []
                for i, w in enumerate(WIDTHS):
                    own, where = back[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                    change = np.zeros_like(self.filters[w])
                    for k in range(w):
                        near = rows[where + k]
                        change[k] = np.einsum("bf,bfd->df", own, near)
                        step = (own[:, :, None] * self.filters[w][k].T[None]).reshape(-1, DIM)
                        touched += [ids[0][where + k].ravel(), ids[1][where + k].ravel()]
                        moves += [step, step]
                    move(("f", w), self.filters[w], change)
                    move(("s", w), self.shifts[w], own.sum(0))
                move("out", self.weights, answers.T @ slope)
                self.bias -= np.float32(RATE * slope.sum())
                which, back_to = np.unique(np.concatenate(touched), return_inverse=True)
                summed = np.zeros((len(which), DIM), np.float32)
                np.add.at(summed, back_to, np.concatenate(moves))
                real = which < 2 * BUCKETS
                move("words", self.words, summed[real], which[real])

    def table(self) -> np.ndarray:
        """Embeddings times all filters: one row of answers for each bucket."""
        parts = [self.words @ self.filters[w][k] for w in WIDTHS for k in range(w)]
        return np.concatenate(parts, 1)

    def raw(self, texts: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
        """Probability before calibration. A text without words is judged by the bias alone."""
        table = self.table() if table is None else table
        out = np.full(len(texts), self.bias, np.float64)
        widest = max(WIDTHS)
        for i, ids in enumerate(texts):
            if not len(ids):
                continue
            ids = np.append(ids, np.full(widest, -1, np.int32))
            best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
            # Long texts in overlapping parts, so that memory is bounded.
            for at in range(0, len(ids) - widest, PART):
                part = _rows(ids[at : at + PART + widest])
                rows = table[part[0]]
                rows += table[part[1]]
                n, column = len(rows) - widest, 0
                for j, w in enumerate(WIDTHS):
                    sums = rows[:n, column : column + FILTERS]
                    for k in range(1, w):
                        column += FILTERS
                        sums = sums + rows[k : k + n, column : column + FILTERS]
                    column += FILTERS
                    own = slice(j * FILTERS, (j + 1) * FILTERS)
                    np.maximum(best[own], sums.max(0), out=best[own])
            shifts = np.concatenate([self.shifts[w] for w in WIDTHS])
            out[i] += np.maximum(best + shifts, 0) @ self.weights
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def calibrate(self, raw: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> None:
        """For every language the threshold with the best F1; few toxic rows: that of all."""

        def best(p, y):
            if not y.any() or y.all():
                return 0.5
            order = np.argsort(-p, kind="stable")
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
            at = int(f1.argmax())
            below = p[order[at + 1]] if at + 1 < len(p) else 0.0
            return float(np.clip((p[order[at]] + below) / 2, 0.02, 0.98))

        self.thresholds[:] = best(raw, labels)
        for i in range(len(LANGUAGES)):
            own = languages == i
            if labels[own].sum() >= LEAST_TOXIC:
                self.thresholds[i] = best(raw[own], labels[own])

    def scaled(self, raw: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """Straight lines from 0 over the threshold (0.5) to 1."""
        t = self.thresholds[languages]
        return np.where(raw < t, 0.5 * raw / t, 0.5 + 0.5 * (raw - t) / (1 - t))


def fitted(texts: list[np.ndarray], y: np.ndarray) -> Network:
    """A network from hashed texts and their labels; without a toxic one all scores are low."""
    y = np.minimum(y.astype(np.float64), 1)
    net = Network()
    if not y.any():
        net.weights[:] = 0
        return net
    aside = np.arange(len(texts)) % 4 == 3
    if not y[aside].any() or not y[~aside].any():
        aside[:] = False
    learn = [x for x, a in zip(texts, aside, strict=True) if not a]
    net.start_from(learn, y[~aside])
    net.fit(learn, y[~aside])
    tests = [x for x, a in zip(texts, aside, strict=True) if a] if aside.any() else learn
    net.calibrate(net.raw(tests), y[aside] if aside.any() else y, np.array([language(x) for x in tests]))
    return net


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network:
    """A network from at most ``TRAIN_ROWS`` labelled documents; without labels all scores are low.

    The bounded sample is gathered and learnt from in a task; the driver sees the weights only.
    Which rows count, also with null or repeated ids, several labels or empty tables, is said at
    ``labelled``.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def as_buckets(texts: pa.Array) -> pa.Array:
        return pa.array([hashed(x.as_py()) for x in texts], pa.list_(pa.int32()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            y.append(batch.column(0).to_numpy())
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            texts += np.split(batch.column(1).flatten().to_numpy(), np.cumsum(lengths)[:-1]) if len(lengths) else []
        net = fitted(texts, np.concatenate(y) if y else np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(net))], pa.binary())], ["net"])

    sample = labelled(docs, labels, "toxic", text, TRAIN_ROWS, doc_id, measure=as_buckets)
    # The limit has left one partition.
    row = sample.coalesce(1).mapInArrow(learn, "net binary").first()
    if row is None:
        return fitted([], np.zeros(0))
    net = Network.__new__(Network)
    vars(net).update(pickle.loads(row["net"]))
    return net


def score(docs: DataFrame, net: Network, text: Column) -> Column:
    """Toxicity from 0 to 1 for every row by itself; 0.5 is the threshold of the text's language.

    Null and empty texts are scored by the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.table(), net.shifts, net.weights, net.bias, net.thresholds))

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Network.__new__(Network)
        table_, own.shifts, own.weights, own.bias, own.thresholds = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for at in range(0, len(batch), 256):
                texts = [hashed(x.as_py()) for x in batch.slice(at, 256)]
                languages = np.array([language(x) for x in texts])
                out[at : at + 256] = own.scaled(own.raw(texts, table_), languages)
            yield pa.array(out)

    return scores(text)


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their columns. Null and empty texts stay."""
    net = trained(docs, labels, text=text)
    # A name that no column of the documents has.
    name = "_".join(["toxic", *docs.columns])
    return docs.withColumn(name, score(docs, net, F.col(text))).filter(F.col(name) < 0.5).drop(name)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = trained(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), score(docs, net, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
