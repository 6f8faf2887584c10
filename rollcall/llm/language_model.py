"""Log-likelihood of whole texts under a gated recurrent language model.

**Words.** Counts of all words of the training texts are a table; nothing of it is cut. The most
frequent words are predicted one by one; every other word belongs to a class by its form (its
end, its first foreign letter), and within its class its probability follows its count, with one
added, so that a word that was never seen has a probability too. The probabilities of all words
and one unseen word per class add up to one.

**Model.** A gated recurrent unit reads the words; a softmax over classes and, for the frequent
words, a softmax within the class give the next word. Training cuts the backpropagation after
``WINDOW`` words while the state goes on through the text. A bounded sample starts the weights;
then every task reads all training texts of its partition, takes gradients in every window, and
the tasks' weights are averaged.

**Scoring** carries the state through the whole text, many texts side by side. Counts of words
outside a bounded table of known words are joined afterwards.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import held_out, table, written
from rollcall.llm.registry import query

FOLDS, HELD = 7, 2
#: Stands for the end of a text; no word is empty.
END = ""
#: Frequent words with a softmax of their own, and classes of them.
HEAD, HEAD_CLASSES = 1024, 16
#: At most so many words (the most frequent) go to the tasks with their counts.
KNOWN = 1 << 18
HIDDEN, WINDOW = 16, 16
#: Texts that start the weights, and how often they are read.
WARM_ROWS, WARM_EPOCHS, WARM_SIDE_BY_SIDE = 600, 2, 48
RATE = 0.1
#: Bytes of text, or of coded words, that a task holds at once; texts side by side in scoring and in training.
CHUNK_BYTES, SIDE_BY_SIDE, TRAIN_SIDE_BY_SIDE = 9 << 20, 1024, 256
#: Words that a counting task holds, floats in a block of weights, partial means of a block.
COUNTED, BLOCK, SLOTS = 1_000_000, 1 << 14, 256

LN10 = float(np.log(10))


# -- words -------------------------------------------------------------------------------------


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only), then the end."""
    return [*(text or "").encode().lower().split(), END.encode()]


_KINDS = {c: i + 1 for i, c in enumerate(b".,!|#*$%&:")}
_ENDINGS, _FOREIGN = 16, 8
FORMS = _ENDINGS + _FOREIGN + 2 * (len(_KINDS) + 2)


def form(word: bytes) -> int:
    """Class of a word by its form. The end of a text is in the first class like no other word."""
    if not word:
        return 0
    last = word[-1]
    foreign = None if word.isascii() else next((b for a, b in zip(word, word[1:], strict=False) if a >= 0xC0), None)
    if 97 <= last <= 122 or last >= 128:
        if foreign is not None:
            return _ENDINGS + (foreign & 0x1F) // 4
        return (last * 7 + (word[-2] if len(word) > 1 else 0)) % _ENDINGS
    kind = len(_KINDS) + 1 if 48 <= last <= 57 else _KINDS.get(last, 0)
    return _ENDINGS + _FOREIGN + 2 * kind + (foreign is not None)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) of all texts, the end included; written. Tasks add up what they have read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in _slices(batches, 0):
            found = pc.value_counts(split_words(batch.column(0))[0])
            ends = pa.table({"token": [END], "n": pa.array([batch.num_rows], pa.int64())})
            held += [pa.table({"token": found.field("values"), "n": found.field("counts")}), ends]
            words += len(found)
            if words > COUNTED:
                # What has come together so far; passed on where it is still much.
                held, words = [added()], 0
                if held[0].num_rows > COUNTED // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    partial = docs.select(text).mapInArrow(count, "token string, n bigint")
    return written(partial.groupBy("token").agg(F.sum("n").alias("n")), "counts")


class Vocabulary:
    """What tasks know about words: counts of the frequent ones and totals of the others."""

    def __init__(self, known: dict[bytes, int], total: int, distinct: int, forms: dict[int, tuple[int, int]]):
        """``forms``: per form the sum and the number of all training words outside the head."""
        self.total, self.distinct = total, distinct
        ranked = sorted(known, key=lambda w: (-known[w], w))
        self.head = ranked[:HEAD]
        if END.encode() in known and END.encode() not in self.head:
            self.head[-1] = END.encode()
        in_head = set(self.head)
        order = [*self.head, *(w for w in ranked if w not in in_head)]
        self.place = {w: i for i, w in enumerate(order)}
        counts = np.array([known[w] for w in order], np.float64)
        self.counts = counts
        size = max(1, -(-HEAD // HEAD_CLASSES))
        kinds = np.array([form(w) for w in order[len(self.head) :]], np.int32)
        head = np.arange(len(self.head))
        #: Row of the input table, class, and place in the class, by place of the word.
        self.inputs = np.concatenate([head, HEAD + kinds]).astype(np.int32)
        self.classes = np.concatenate([head // size, HEAD_CLASSES + kinds]).astype(np.int32)
        self.inner = (head % size).astype(np.int32)
        #: Input row by place; an unknown word of form k is the k-th from the end.
        self.rows = np.concatenate([self.inputs, HEAD + np.arange(FORMS)[::-1]]).astype(np.int16)
        #: By input row: class, and for the head the place in the class; first rows of the head classes.
        row = np.arange(HEAD + FORMS)
        self.row_classes = np.where(row < HEAD, row // size, HEAD_CLASSES + row - HEAD)
        self.row_inner = row % size
        self.bounds = np.minimum(np.arange(HEAD_CLASSES + 1) * size, HEAD)
        self.set_forms(forms)

    def set_forms(self, forms: dict[int, tuple[int, int]]) -> None:
        self.within = np.zeros(FORMS)
        for k in range(FORMS):
            n, v = forms.get(k, (0, 0))
            self.within[k] = -np.log10(n + v + 1)
        kinds = self.classes[len(self.head) :] - HEAD_CLASSES
        #: log10 of the probability in the class (head: 0, the model says), and by counts alone.
        self.inner_score = np.concatenate(
            [np.zeros(len(self.head)), np.log10(self.counts[len(self.head) :] + 1) + self.within[kinds]]
        )
        self.base = np.log10(self.counts + 1) - np.log10(self.total + self.distinct + 1)

    @functools.cached_property
    def listed(self) -> pa.Array:
        """The known words by place."""
        return pa.array([w.decode() for w in self.place], pa.string())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
        """Places of the words, those of unknown words as -1 - form, and counts of these words."""
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        rare: dict[bytes, int] = {}
        for at in np.flatnonzero(ids < 0).tolist():
            word = words[at]
            rare[word] = rare.get(word, 0) + 1
            ids[at] = -1 - form(word)
        return ids, rare

    def input_rows(self, ids: np.ndarray) -> np.ndarray:
        """Input rows of encoded words; small numbers, which are sorted by their digits."""
        return self.rows[ids]

    def coded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input rows and classes of encoded words."""
        rows = self.input_rows(ids).astype(np.int32)
        return rows, self.row_classes[rows].astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the whole count table. The driver gets its totals and at most ``KNOWN`` words."""

    @F.arrow_udf(T.IntegerType())
    def form_of(words: pa.Array) -> pa.Array:
        return pa.array([form(w.as_py().encode()) for w in words], pa.int32())

    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Words at least as frequent as a step of a fine scale; the steps are few at every size.
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, held = float("inf"), 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        if held + row["words"] > KNOWN:
            break
        least, held = row["step"], held + row["words"]
    known = counts.filter((step >= F.lit(least)) | (F.col("token") == END)).toArrow()
    words = {w.encode(): n for w, n in zip(known["token"].to_pylist(), known["n"].to_pylist(), strict=True)}
    made = Vocabulary(words, total, distinct, {})
    forms = counts.groupBy(form_of("token").alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    sums = {r["form"]: [r["n"], r["v"]] for r in forms}
    for w in made.head:
        sums[form(w)][0] -= words[w]
        sums[form(w)][1] -= 1
    made.set_forms({k: tuple(x) for k, x in sums.items()})
    return made


# -- network -----------------------------------------------------------------------------------


class Network:
    """Input table, recurrent weights, and the two softmax layers."""

    SHAPES = {
        "inputs": (HEAD + FORMS, 3 * HIDDEN),
        "gates": (HIDDEN, 2 * HIDDEN),
        "fresh": (HIDDEN, HIDDEN),
        "shift": (HIDDEN,),
        "classes": (HIDDEN, HEAD_CLASSES + FORMS),
        "class_bias": (HEAD_CLASSES + FORMS,),
        "words": (HEAD_CLASSES, HIDDEN, -(-HEAD // HEAD_CLASSES)),
        "word_bias": (HEAD_CLASSES, -(-HEAD // HEAD_CLASSES)),
    }

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 0.15, s).astype(np.float32) for k, s in self.SHAPES.items()}
        for k in ("shift", "class_bias", "word_bias"):
            self.p[k][:] = 0
        self.state = {k: np.full(s, 0.05, np.float32) for k, s in self.SHAPES.items()}

    def start_from(self, vocabulary: Vocabulary) -> None:
        """Begin with how often each class, and each word in its class, is met at all."""
        weight = np.zeros(HEAD_CLASSES + FORMS)
        n = len(vocabulary.head)
        np.add.at(weight, vocabulary.classes[:n], vocabulary.counts[:n])
        weight[HEAD_CLASSES:] += 10.0 ** -vocabulary.within
        self.p["class_bias"][:] = np.log(weight + 1) - np.log(weight.sum() + len(weight))
        # No word is in the last classes of a short head.
        self.p["class_bias"][:HEAD_CLASSES][weight[:HEAD_CLASSES] == 0] = -30
        bias = np.full(self.p["word_bias"].shape, -30.0)
        bias[vocabulary.classes[:n], vocabulary.inner[:n]] = np.log(vocabulary.counts[:n])
        top = bias.max(1, keepdims=True)
        self.p["word_bias"][:] = bias - top

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.p[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return self

    def read(self, h: np.ndarray, group: Group, places: list[range]):
        """Read the words of a window; ``h`` are the states before it.

        Returns the states before each word; its reset gate, update gate and fresh state, one table
        for each, so that what a step works on lies side by side; what the reset gate multiplies; and
        the states after the window.
        """
        first, size = places[0].start, places[-1].stop - places[0].start
        # The gates' sums are negative throughout, as the exponential wants them.
        inputs = np.stack(np.split(self.p["inputs"], 3, axis=1))
        np.negative(inputs[:2], out=inputs[:2])
        weights = -np.stack(np.split(self.p["gates"], 2, axis=1))
        shift = np.tile(self.p["shift"], (len(places[0]), 1))
        x = inputs.take(group.inputs[first : first + size], axis=1)
        states, inner = np.empty((2, size, HIDDEN), x.dtype)
        states[: len(places[0])] = h
        for step, some in enumerate(places):
            at, n = slice(some.start - first, some.stop - first), len(some)
            now = states[at]
            gates, fresh, through = x[:2, at], x[2, at], inner[at]
            gates += now @ weights
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.matmul(now, self.p["fresh"], out=through)
            through += shift[:n]
            fresh += gates[0] * through
            np.tanh(fresh, out=fresh)
            more = step + 1 < len(places)
            after = states[at.stop : at.stop + len(places[step + 1])] if more else np.empty_like(now)
            n = len(after)
            np.subtract(now[:n], fresh[:n], out=after)
            after *= gates[1, :n]
            after += fresh[:n]
        return states, x, inner, after

    def _bounded(self) -> None:
        """Keep every logit under 80, so that its exponential needs no look at the largest.

        States lie between -1 and 1; a column of weights that could pass the bound is scaled down.
        """
        for layer, bias in (("classes", "class_bias"), ("words", "word_bias")):
            most = np.abs(self.p[layer]).sum(-2) + np.abs(self.p[bias])
            if most.max() > 80:
                scale = np.minimum(1, 80 / most).astype(np.float32)
                self.p[layer] *= scale[..., None, :]
                self.p[bias] *= scale

    def outputs(self, states: np.ndarray, rows: np.ndarray, vocabulary: Vocabulary):
        """Exponentials of the logits of all classes, and of the words in the class of each frequent word.

        Words come in the order of their input rows, so that a class's words lie side by side. Also
        returns the states with a one at their end, which the biases multiply, and each head class's
        part of the words. Logits are small (see ``_bounded``).
        """
        ends = np.searchsorted(rows, vocabulary.bounds).tolist()
        parts = [(c, slice(at, end)) for c, (at, end) in enumerate(zip(ends, ends[1:], strict=False)) if end > at]
        with_one = np.ones((len(states), HIDDEN + 1), states.dtype)
        with_one[:, :HIDDEN] = states
        of_class = with_one @ np.concatenate([self.p["classes"], self.p["class_bias"][None]])
        np.exp(of_class, out=of_class)
        weights = np.concatenate([self.p["words"], self.p["word_bias"][:, None]], axis=1)
        of_word = np.empty((ends[-1], weights.shape[2]), states.dtype)
        for c, some in parts:
            np.matmul(with_one[some], weights[c], out=of_word[some])
        np.exp(of_word, out=of_word)
        return with_one, of_class, of_word, parts

    @staticmethod
    def _sums(exps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each row, and one place of each row in the flat array."""
        size = exps.shape[1]
        return exps @ np.ones(size, exps.dtype), np.arange(0, exps.size, size) + at[: len(exps)]

    def scores(self, states: np.ndarray, rows: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Natural log of P(class) P(word in class); words outside the head: P(class)."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        _, of_class, of_word, _ = self.outputs(states.take(order, axis=0), rows, vocabulary)
        found = []
        for exps, place in ((of_class, vocabulary.row_classes), (of_word, vocabulary.row_inner)):
            sums, at = self._sums(exps, place[rows])
            found.append(np.log(exps.reshape(-1)[at] / sums))
        found[0][: len(found[1])] += found[1]
        score = np.empty_like(found[0])
        score[order] = found[0]
        return score

    def _move(self, name: str, slope: np.ndarray, rows=None) -> None:
        """One step with a rate for every weight (Adagrad)."""
        np.minimum(slope, 1, out=slope)
        np.maximum(slope, -1, out=slope)
        at = ... if rows is None else rows
        state = slope * slope
        state += self.state[name][at]
        self.state[name][at] = state
        np.sqrt(state, out=state)
        slope /= state
        slope *= RATE
        self.p[name][at] -= slope

    def learn(self, h: np.ndarray, group: Group, places: list[range], vocabulary: Vocabulary) -> np.ndarray:
        """Backpropagation through one window; returns the state after it."""
        first = places[0].start
        states, x, inner, h = self.read(h, group, places)
        rows = group.inputs[first : places[-1].stop]
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        self._bounded()
        with_one, of_class, of_word, parts = self.outputs(states.take(order, axis=0), rows, vocabulary)
        # One text-step counts as one; the mean keeps the rate alike for all sizes.
        scale = np.float32(1 / len(rows) * 8)
        for exps, place in ((of_class, vocabulary.row_classes), (of_word, vocabulary.row_inner)):
            # From here on the slopes of the logits.
            sums, at = self._sums(exps, place[rows])
            exps.reshape(-1)[at] -= sums
            exps *= (scale / sums)[:, None]
        slope = with_one.T @ of_class
        slopes = {"classes": slope[:HIDDEN], "class_bias": slope[HIDDEN]}
        slope = np.zeros((HEAD_CLASSES, HIDDEN + 1, of_word.shape[1]), of_word.dtype)
        inside = np.empty((len(of_word), HIDDEN), of_word.dtype)
        for c, some in parts:
            np.matmul(with_one[some].T, of_word[some], out=slope[c])
            np.matmul(of_word[some], self.p["words"][c].T, out=inside[some])
        slopes |= {"words": slope[:, :HIDDEN], "word_bias": slope[:, HIDDEN]}
        sorted_back = of_class @ self.p["classes"].T
        sorted_back[: len(inside)] += inside
        back = np.empty_like(sorted_back)
        back[order] = sorted_back

        # What a step multiplies by, for the whole window at once; the steps make it the slopes of
        # what the reset gate multiplies, reset gate, update gate and fresh state.
        r, z, fresh = x
        moves = np.empty((4, *states.shape), back.dtype)
        to_inner, to_reset, to_update, to_fresh = moves
        stay = 1 - z
        np.multiply(fresh, fresh, out=to_fresh)
        np.subtract(1, to_fresh, out=to_fresh)
        to_fresh *= stay
        np.subtract(states, fresh, out=to_update)
        to_update *= z
        to_update *= stay
        np.multiply(to_fresh, r, out=to_inner)
        np.subtract(1, r, out=to_reset)
        to_reset *= to_inner
        to_reset *= inner
        weights = np.stack([self.p["fresh"].T, *np.split(self.p["gates"].T, 2)])
        carried = np.zeros((0, HIDDEN), back.dtype)
        for some in reversed(places):
            n, at = len(some), slice(some.start - first, some.stop - first)
            # What later steps say about the state after this one.
            ahead = carried
            if len(carried) < n:
                ahead = np.zeros((n, HIDDEN), back.dtype)
                ahead[: len(carried)] = carried
            part = moves[:, at]
            part *= ahead
            carried = ahead
            carried *= z[at]
            for more in part[:3] @ weights:
                carried += more
            carried += back[at]
        to_fresh, to_reset, to_update = states.T @ moves[:3]
        slopes |= {"gates": np.concatenate([to_reset, to_update], axis=1), "fresh": to_fresh, "shift": moves[0].sum(0)}
        for name, slope in slopes.items():
            self._move(name, slope)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        of_rows = np.add.reduceat(moves[1:].take(order, axis=1), starts, axis=1)
        self._move("inputs", np.concatenate(of_rows, axis=1), rows[starts].astype(np.intp))
        return h


class Group:
    """Texts of like length, the longest first, read in step: the first words of all, then the second."""

    def __init__(self, vocabulary: Vocabulary, texts: list[np.ndarray]):
        lengths = np.array([len(x) for x in texts])
        most = int(lengths.max(initial=0))
        #: How many texts reach each step, and where the step begins.
        self.sizes = np.searchsorted(-lengths, -np.arange(most), "left")
        self.starts = np.cumsum(self.sizes) - self.sizes
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # Small numbers are sorted by their digits.
        order = np.argsort(step.astype(np.uint16) if most < 1 << 16 else step, kind="stable")
        self.inputs = vocabulary.input_rows(np.concatenate(texts))[order]

    @staticmethod
    def all(vocabulary: Vocabulary, texts: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, Group]]:
        order = np.argsort(-np.array([len(x) for x in texts]), kind="stable")
        for at in range(0, len(order), width):
            some = order[at : at + width]
            yield some, Group(vocabulary, [texts[i] for i in some])

    def windows(self) -> Iterator[list[range]]:
        """For each step of a window, the places of its words."""
        steps = [range(at, at + n) for at, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)]
        for start in range(0, len(steps), WINDOW):
            yield steps[start : start + WINDOW]


def train(net: Network, vocabulary: Vocabulary, texts: list[np.ndarray], width: int) -> None:
    """Read the texts once, with gradients in every window; the state goes on through the text."""
    for some, group in Group.all(vocabulary, texts, width):
        h = np.zeros((len(some), HIDDEN), np.float32)
        for places in group.windows():
            h = net.learn(h[: len(places[0])], group, places, vocabulary)


def log_likelihoods(net: Network, vocabulary: Vocabulary, texts: list[np.ndarray], width: int = SIDE_BY_SIDE) -> np.ndarray:
    """Natural log of the model's part of the probability of every encoded text."""
    out = np.zeros(len(texts))
    net._bounded()
    for some, group in Group.all(vocabulary, texts, width):
        h = np.zeros((len(some), HIDDEN), np.float32)
        sums = np.zeros(len(some))
        for places in group.windows():
            first = places[0].start
            states, _, _, h = net.read(h[: len(places[0])], group, places)
            score = net.scores(states, group.inputs[first : places[-1].stop], vocabulary)
            for step in places:
                sums[: len(step)] += score[step.start - first : step.stop - first]
        out[some] = sums
    return out


@dataclass
class Chunk:
    """Rows of a batch with their coded texts, and what unknown words they have."""

    rows: pa.RecordBatch
    texts: list[np.ndarray]
    #: For every unknown word of a text: the text, the word's place in ``words``, how often.
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]
    words: pa.Array
    forms: np.ndarray


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts in a row, and the text of each."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten()
    owner = pc.list_parent_indices(parts).to_numpy()
    # White space at either end of a text leaves empty strings.
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def _slices(batches: Iterator[pa.RecordBatch], column: int, width: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows that hold about ``CHUNK_BYTES`` together: of text, or of lists of ``width`` bytes a word."""
    for batch in batches:
        sizes = (pc.list_value_length if width else pc.binary_length)(batch.column(column))
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) * max(1, width)
        total = int(sizes.sum())
        each = max(1, -(-total // max(1, -(-total // CHUNK_BYTES))))
        chunk = (np.cumsum(sizes) - sizes) // each
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            if end > at:
                yield batch.slice(at, end - at)


def coded(batch: pa.RecordBatch, vocabulary: Vocabulary, column: int) -> Chunk:
    """All texts of a batch coded at once; every text ends with the end."""
    flat, owner = split_words(batch.column(column))
    size = batch.num_rows
    found = pc.index_in(flat, value_set=vocabulary.listed)
    unknown = found.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(found, -1).to_numpy().astype(np.int32)
    listed = flat.filter(pa.array(unknown)).dictionary_encode()
    words, code = listed.dictionary, listed.indices.to_numpy()
    forms = np.array([form(w.encode()) for w in words.to_pylist()], np.int32)
    if len(code):
        ids[unknown] = -1 - forms[code]
    pairs, often = np.unique(owner[unknown].astype(np.int64) * max(1, len(words)) + code, return_counts=True)
    rare = [(pairs // max(1, len(words))), pairs % max(1, len(words)), often]
    # Room for the end after each text's words.
    lengths = np.bincount(owner, minlength=size)
    last = np.cumsum(lengths + 1) - 1
    end = vocabulary.place.get(END.encode())
    if end is None:
        end = -1 - form(END.encode())
        # Without training texts the end is a word like any other.
        words, forms = pa.concat_arrays([words.cast(pa.string()), pa.array([END])]), np.append(forms, form(END.encode()))
        rare = [np.concatenate(x) for x in zip(rare, (np.arange(size), np.full(size, len(words) - 1), np.ones(size, np.int64)), strict=True)]
    whole = np.full(len(ids) + size, end, np.int32)
    whole[np.arange(len(ids)) + owner] = ids
    return Chunk(batch, np.split(whole, last[:-1] + 1) if size else [], tuple(rare), words, forms)


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: int) -> Iterator[Chunk]:
    for part in _slices(batches, column):
        yield coded(part, vocabulary, column)


def _lists(ids: pa.Array) -> list[np.ndarray]:
    """The coded texts of a column."""
    lengths = pc.list_value_length(ids).to_numpy()
    return np.split(ids.flatten().to_numpy(), np.cumsum(lengths)[:-1]) if len(ids) else []


def rare_words(chunk: Chunk, words: Vocabulary) -> pa.Array:
    """For every text its unknown words, how often each occurs, and the class's share of it."""
    text, word, often = chunk.rare
    order = np.argsort(text, kind="stable")
    text, word, often = text[order], word[order], often[order]
    within = words.within[chunk.forms]
    parts = [
        chunk.words.take(pa.array(word, pa.int64())).cast(pa.string()), pa.array(often, pa.int64()),
        pa.array(within[word] if len(word) else [], pa.float64()),
    ]
    ends = np.searchsorted(text, np.arange(chunk.rows.num_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["token", "n", "within"]))


def coded_texts(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """The rows with ``ids`` (the coded text) and ``rare`` (unknown words) in the place of ``text``.

    Each text is split and coded once; training and scoring read the numbers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in rows.columns if c != "text"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for chunk in _chunks(batches, words, len(kept)):
            ends = np.cumsum([0, *map(len, chunk.texts)]).astype(np.int32)
            flat = np.concatenate(chunk.texts) if chunk.texts else np.zeros(0, np.int32)
            columns = [*chunk.rows.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), rare_words(chunk, words)]
            # Small batches: the session's side takes a whole one at a time.
            yield from pa.Table.from_arrays(columns, names=[*kept, "ids", "rare"]).to_batches(max_chunksize=1000)

    fields = [
        *(rows.schema[c] for c in kept),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        *T.StructType.fromDDL("rare array<struct<token string, n bigint, within double>>"),
    ]
    return rows.select(*kept, "text").mapInArrow(code, T.StructType(fields))


# -- training and scoring over tables ----------------------------------------------------------


def trained(
    learn: DataFrame, words: Vocabulary, doc_id: str = "doc_id", text: str = "text", ids: DataFrame | None = None
) -> Network:
    """Weights from all training texts; ``ids`` are the same texts coded, where they are at hand."""
    ids = coded_texts(learn.select(F.col(text).alias("text")), words) if ids is None else ids
    spark = learn.sparkSession
    # The texts with the smallest hashes; only hashes are ordered, so that no task gathers texts.
    place = F.xxhash64(F.col(doc_id), F.lit(FOLDS))
    last = learn.select(place.alias("place")).orderBy("place").limit(WARM_ROWS).agg(F.max("place")).first()[0]
    first = learn.filter(place <= last).select(place.alias("place"), text).orderBy("place", text).limit(WARM_ROWS)
    sample = [words.encode(tokens(x))[0] for x in first.toArrow()[text].to_pylist()] if last is not None else []
    net = Network()
    if not sample:
        return net
    net.start_from(words)
    for _ in range(WARM_EPOCHS):
        train(net, words, sample, WARM_SIDE_BY_SIDE)
    shared = spark.sparkContext.broadcast((words, net.flat()))

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        own, size = Network().load(flat), 0
        for batch in _slices(batches, 0, 4):
            texts = _lists(batch.column(0))
            train(own, words, texts, TRAIN_SIDE_BY_SIDE)
            size += sum(map(len, texts))
        if size:
            yield blocks(own.flat().astype(np.float64), float(size))

    def blocks(flat: np.ndarray, weight: float) -> pa.RecordBatch:
        parts = [flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts)), pa.array([x.tobytes() for x in parts], pa.binary())],
            names=["block", "weight", "part"],
        )

    def mean(group: pa.Table) -> pa.Table:
        total, weight = None, 0.0
        for w, x in zip(group["weight"].to_pylist(), group["part"], strict=True):
            part = np.frombuffer(x.as_py()) * w
            total = part if total is None else total + part
            weight += w
        block = group["block"][0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "weight": [weight], "part": [(total / weight).tobytes()]})

    kind = "block int, weight double, part binary"
    partial = ids.select("ids").mapInArrow(one_task, kind).withColumn("slot", F.spark_partition_id() % SLOTS)
    some = partial.groupBy("block", "slot").applyInArrow(lambda g: mean(g), kind)
    whole = some.groupBy("block").applyInArrow(lambda g: mean(g), kind).orderBy("block").toArrow()
    shared.unpersist()
    return Network().load(np.concatenate([np.frombuffer(x.as_py()) for x in whole["part"]]))


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) mod 7 is 2 are not learnt from; a text without an id is. A null or
    empty text is its end alone. Rows that repeat are counted and scored each.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, HELD).alias("held_out"), F.col(text).alias("text")
    )
    learn = rows.filter(~F.col("held_out"))
    counts = count_words(learn)
    words = vocabulary(counts)
    coded = coded_texts(rows, words).withColumn("row", F.monotonically_increasing_id())
    coded = written(coded, "coded")
    net = trained(learn, words, ids=coded.filter(~F.col("held_out")))
    shared = spark.sparkContext.broadcast((words, net.flat()))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        own = Network().load(flat)
        for batch in _slices(batches, 3, 4):
            texts = _lists(batch.column(3))
            model = log_likelihoods(own, words, texts) / LN10
            known = [x[x >= 0] for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([len(x) for x in known], pa.int64()),
                    pa.array([float(words.base[x].sum()) for x in known]),
                    pa.array(model + [float(words.inner_score[x].sum()) for x in known], pa.float64()),
                ],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "model"],
            )

    kind = f"doc_id {id_type}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, model double"
    done = written(coded.select("doc_id", "held_out", "row", "ids").mapInArrow(score, kind), "scored")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    # Every word that is not known to the tasks gets its count by a join.
    found = rare.join(counts.withColumnRenamed("n", "c"), "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    share = F.log10(c + 1)
    outside = float(np.log10(words.total + words.distinct + 1))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * (share - F.lit(outside))).alias("more_base"),
        F.sum(F.col("n") * (share + F.col("within"))).alias("more_model"),
    )
    both = done.join(sums, "row", "left")

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return both.select(
        "doc_id", "held_out", "n_tokens", plus("known", "more").cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"),
        plus("model", "more_model").alias("score"),
    )


@query("op3_language_model")
def op3_language_model(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
