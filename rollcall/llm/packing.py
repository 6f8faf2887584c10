"""Packing documents into sequences of a fixed length by non-negative least squares.

Only the histogram of piece lengths (at most ``length`` numbers) decides how pieces are put
together, so the plan is made on the driver whatever the number of documents, and the pieces
follow it in tasks:

1. Texts become token ids; longer documents are cut into whole sequences and a rest.
2. Lengths are grouped into steps of ``GRID`` tokens. Patterns of up to three grid lengths fill
   a sequence. Repeat counts x >= 0 that reproduce the histogram (least squares with a weight on
   missed lengths) are found by an active-set method. What these patterns cannot reproduce, as
   where most pieces are short, is met by patterns of more pieces: the one that lowers the squares
   fastest fills a sequence with the largest sum of missed counts, and is added until none does.
   Counts are rounded down to whole patterns. A pattern takes pieces of its cells, the last two so
   that the sequence is full; what is left is fitted again until hardly any sequence gets full.
3. What remains is placed best fit first, longest pieces first, again with counts of equal
   sequences instead of single ones.
4. Piece number r of a length takes the r-th place that the plan has for that length. The numbers
   come from counts per task, so no task sees all pieces of one length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import table, written
from rollcall.llm.registry import query

LENGTH = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Grid of the patterns: LENGTH / GRID lengths.
GRID = 32
#: Words whose ids a task remembers; a full memory is dropped and filled again.
REMEMBERED = 400_000
#: Bytes of text that a task codes at once; a longer text is coded alone.
CODED_BYTES = 4 << 20
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
#: Letters that every Unicode rule of the vocabulary keeps or lower-cases one by one.
LATIN = "".join(
    chr(c) for c in range(0xC0, 0x17F) if chr(c).isalpha() and len(chr(c).lower()) == 1 and c != 0x149
)
PLAIN = f"^[!-~{LATIN}]+$"
#: The split pattern of the vocabulary, for lower-case text of these characters.
PARTS = f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+"

PLACE = T.StructType(
    [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
)
OUT = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
PIECES = "piece int, start bigint, length int, ids_crc32 bigint, ids binary, place bigint"


# -- tokens ------------------------------------------------------------------------------------


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's rules never look across ASCII white space, so a chunk between white space
    has the same ids in every text. The chunks of a batch are brought together, each different one
    is coded once, and ids are put in their places by Arrow. Chunks of printable ASCII and plain
    Latin letters are taken apart by the vocabulary's own pattern, and only words that are new go
    to its merges; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        # Spark already runs a task per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        # How the byte-level rule spells each character.
        self.spelling = {
            ord(c): "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
            for c in PRINTABLE + LATIN.lower()
        }
        # What has been met, and its ids.
        self.words, self.ids = pa.array([], pa.string()), _lists([])

    def _words(self, words: pa.Array) -> pa.ListArray:
        """The ids of different words; those that are new are remembered."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(place.is_null())
        spelt = [x.translate(self.spelling) for x in new.to_pylist()]
        known = pa.concat_arrays([self.words, new])
        ids = pa.concat_arrays([self.ids, _lists([[x.id for x in self.model.tokenize(w)] for w in spelt])])
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        found = ids.take(pa.array(place))
        # A full memory keeps what is in use.
        self.words, self.ids = (known, ids) if len(known) <= REMEMBERED else (words, found)
        return found

    def _others(self, chunks: pa.Array) -> pa.ListArray:
        encode = self.tokenizer.encode
        return _lists([encode(x, add_special_tokens=False).ids for x in chunks.to_pylist()])

    def _chunks(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of every chunk."""
        plain = pc.and_not(pc.match_substring_regex(chunks, PLAIN), pc.match_substring(chunks, "<|"))
        lower = pc.utf8_lower(pc.if_else(plain, chunks, ""))
        # A mark after each match, and a chunk that is not plain as one part.
        marked = pc.replace_substring_regex(lower, PARTS, "\\0\x1f")
        split = pc.split_pattern(pc.utf8_rtrim(marked, "\x1f"), "\x1f")
        parts = split.flatten().dictionary_encode()
        found = self._words(parts.dictionary).take(parts.indices)
        lists = pa.ListArray.from_arrays(found.offsets.take(split.offsets), found.values)
        others = pc.invert(plain)
        if not pc.any(others).as_py():
            return lists
        # Their ids stand behind those of the plain chunks.
        more = self._others(chunks.filter(others))
        place = np.arange(len(chunks))
        place[others.to_numpy(zero_copy_only=False)] = len(chunks) + np.arange(len(more))
        return pa.concat_arrays([lists, more]).take(pa.array(place))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        # White space at either end of a text leaves empty strings, which have no ids.
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        found = self._chunks(words.dictionary).take(words.indices)
        ends = found.offsets.take(split.offsets).to_numpy()
        ids = memoryview(np.ascontiguousarray(found.values.to_numpy(), "<u4")).cast("B")
        return [bytes(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    """Ids as Arrow lists."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One per Python worker, so that what a task has learnt serves the next one."""
    return Encoder(vocabulary)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in a row whose texts in ``column`` have up to ``size`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        held = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, held + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def cut(ids: bytes, length: int, end: int) -> list[tuple[int, bytes]]:
    """(start, ids) of a document's pieces; the end token is added first."""
    ids += end.to_bytes(4, "little")
    return [(at // 4, ids[at : at + 4 * length]) for at in range(0, len(ids), 4 * length)]


def pieces(
    docs: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    *,
    vocabulary: str | None = None,
    length: int = LENGTH,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents, written once.

    Columns: ``_row`` (struct of ``carry``), piece, start, length, ids_crc32, ids (null unless
    ``keep_ids``), and ``part`` and ``place``: the place-th piece of its length in that part of
    the written table. A null or empty text is one piece that holds the end token.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, places = encoder(path), np.zeros(length + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1, CODED_BYTES):
                cuts = [cut(x, length, end) for x in coder.encode(part.column(1))]
                who = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts])
                flat = [x for one in cuts for x in one]
                sizes = np.array([len(x) // 4 for _, x in flat], np.int64)
                place = np.empty(len(flat), np.int64)
                for i, n in enumerate(sizes.tolist()):
                    place[i] = places[n]
                    places[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(who)),
                        pa.array([k for one in cuts for k in range(len(one))], pa.int32()),
                        pa.array([s for s, _ in flat], pa.int64()),
                        pa.array(sizes.astype(np.int32)),
                        pa.array([zlib.crc32(x) for _, x in flat], pa.int64()),
                        pa.array([x if keep_ids else None for _, x in flat], pa.binary()),
                        pa.array(place),
                    ],
                    names=["_row", "piece", "start", "length", "ids_crc32", "ids", "place"],
                )

    kind = rows.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, " + PIECES
    return written(rows.mapInArrow(coded, schema).withColumn("part", F.spark_partition_id()), "pieces")


# -- plan --------------------------------------------------------------------------------------


def patterns(cells: int) -> np.ndarray:
    """All ways to fill ``cells`` by one to three lengths, as a matrix of lengths by patterns."""
    found = [(cells,)]
    found += [(a, cells - a) for a in range(1, cells // 2 + 1)]
    found += [
        (a, b, cells - a - b) for a in range(1, cells // 3 + 1) for b in range(a, (cells - a) // 2 + 1)
    ]
    matrix = np.zeros((cells, len(found)))
    for k, lengths in enumerate(found):
        for x in lengths:
            matrix[x - 1, k] += 1
    return matrix


def least_squares(a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active sets, Lawson and Hanson), sought from ``start``."""
    x = np.zeros(a.shape[1]) if start is None else start.copy()
    active = x > 0
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    error = np.inf
    while True:
        left = b - a @ x
        slope = a.T @ left
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        # Each round lowers the squares until digits run out.
        if slope[best] <= tolerance or left @ left >= error:
            return x
        error = left @ left
        active[best] = True
        while active.any():
            on = np.flatnonzero(active)
            inner = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if inner.min() > 0:
                x[:] = 0
                x[on] = inner
                break
            bad = inner <= 0
            step = (x[on][bad] / np.maximum(x[on][bad] - inner[bad], 1e-300)).min()
            x[on] += step * (inner - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0


def fullest(worth: np.ndarray) -> np.ndarray:
    """How often to take each length 1, 2, ... so that they fit the longest and are worth most."""
    cells = len(worth)
    value, last = np.zeros(cells + 1), np.zeros(cells + 1, int)
    for room in range(1, cells + 1):
        total = value[room - 1 :: -1][:room] + worth[:room]
        best = int(np.argmax(total))
        value[room], last[room] = max((total[best], best + 1), (value[room - 1], 0))
    taken, room = np.zeros(cells), cells
    while room:
        if last[room]:
            taken[last[room] - 1] += 1
        room -= last[room] or 1
    return taken


def fitted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (lengths by patterns) and how often each is repeated, to reproduce ``counts``."""
    cells = len(counts)
    # Missing a long piece costs more room than missing a short one.
    weight = np.sqrt(np.arange(1, cells + 1) / cells)
    target = counts * weight
    matrix = patterns(cells)
    matrix = matrix[:, ~matrix[counts == 0].any(0)]
    repeats = least_squares(matrix * weight[:, None], target) if matrix.size else np.zeros(0)
    error = np.inf
    while True:
        matrix, repeats = matrix[:, repeats > 0], repeats[repeats > 0]
        left = target - (matrix @ repeats) * weight
        if left @ left >= error * (1 - 1e-9) or np.abs(left / weight).max() < 0.5:
            return matrix, repeats
        error = left @ left
        more = fullest(np.where(counts > 0, left * weight, -1.0))
        if not more.any():
            return matrix, repeats
        matrix = np.column_stack([matrix, more])
        repeats = least_squares(matrix * weight[:, None], target, np.append(repeats, 0.0))


class Bins:
    """Groups of equal sequences: how much room is left, how many, their numbers and contents."""

    def __init__(self, length: int):
        self.length, self.next = length, 0
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first, count)
        self.rooms: list[int] = []
        self.plan: list[tuple[int, int, int, int, int]] = []  # length, rank, sequence, count, offset
        self.ranks: dict[int, int] = defaultdict(int)

    def _keep(self, room: int, first: int, count: int) -> None:
        if room not in self.groups or not self.groups[room]:
            if room not in self.rooms:
                bisect.insort(self.rooms, room)
        self.groups[room].append((first, count))

    def put(self, size: int, first: int, count: int, room: int) -> None:
        """A piece of ``size`` into each of ``count`` sequences that have ``room``."""
        self.plan.append((size, self.ranks[size], first, count, self.length - room))
        self.ranks[size] += count

    def new(self, sizes: list[int], count: int) -> None:
        first, self.next = self.next, self.next + count
        room = self.length
        for size in sizes:
            self.put(size, first, count, room)
            room -= size
        if room:
            self._keep(room, first, count)

    def fill(self, size: int, count: int) -> None:
        """Place ``count`` pieces, each where the least room is left."""
        while count:
            at = bisect.bisect_left(self.rooms, size)
            if at == len(self.rooms):
                # As many as fit into one new sequence, as often as that is full.
                each = min(self.length // size, count)
                whole = count // each
                self.new([size] * each, whole)
                count -= each * whole
                continue
            room = self.rooms[at]
            first, there = self.groups[room].pop()
            if not self.groups[room]:
                self.rooms.pop(at)
            # Fill one sequence with several where they fit, so that few groups arise.
            each = min(room // size, max(1, count // there))
            used = min(there, count // each)
            left = room
            for _ in range(each):
                self.put(size, first, used, left)
                left -= size
            if left:
                self._keep(left, first, used)
            if used < there:
                self._keep(room, first + used, there - used)
            count -= each * used


def _exact(cells: list[int], of_cell: dict, there: list, left: dict, length: int, grid: int) -> list | None:
    """Lengths for a pattern, near those of its cells, that fill the sequence; None where there are none.

    Each is the longest of its cell that keeps the sum on the pattern's course. The last two make
    the sequence full; they come from other cells where their own have no such two.
    """
    used: Counter = Counter()
    room, rest = length, grid * sum(cells)
    for c in cells[:-2]:
        rest -= grid * c
        some = of_cell[c]
        free = [x for x in some if left[x] > used[x]]
        at = bisect.bisect_right(free, room - rest)
        # All may be longer.
        size = free[max(0, at - 1)] if free else room
        if size >= room:
            return None
        used[size] += 1
        room -= size
    for a in (*reversed(of_cell[cells[-2:][0]]), *reversed(there)):
        b = room - a
        if left[a] > used[a] and left.get(b, 0) > used[b] + (a == b):
            return [*used.elements(), a, b]
    return None


def plan_sequences(histogram: dict[int, int], length: int = LENGTH, grid: int = GRID) -> list[tuple]:
    """(length, first rank, first sequence, count, offset) so that every piece has a place.

    A piece of that length with a rank from ``first rank`` on goes to the sequence as many
    numbers on, at ``offset``. The rows grow with the number of lengths, not of pieces.
    """
    left = dict(sorted(histogram.items()))
    bins = Bins(length)
    if left.get(length):
        bins.new([length], left.pop(length))
    left = follow_patterns(bins, left, grid)
    for size in sorted(left, reverse=True):
        bins.fill(size, left[size])
    return bins.plan


def follow_patterns(bins: Bins, left: dict[int, int], grid: int = GRID) -> dict[int, int]:
    """Put pieces (count of each length) into full sequences that repeat patterns; returns the others.

    What rounding and missing lengths leave is fitted again, as long as that places a hundredth of it.
    """
    before = np.inf
    while left and sum(left.values()) <= 0.99 * before:
        before = sum(left.values())
        _follow(bins, left, grid)
        left = {s: n for s, n in left.items() if n}
    return left


def _follow(bins: Bins, left: dict[int, int], grid: int) -> None:
    of_cell: dict[int, list[int]] = defaultdict(list)
    for size in left:
        of_cell[max(1, round(size / grid))].append(size)
    counts = np.array([sum(left[s] for s in of_cell[c + 1]) for c in range(bins.length // grid)], float)
    matrix, repeats = fitted(counts)
    repeats = np.floor(repeats + 1e-6).astype(int)
    there = list(left)
    for k in np.argsort(-repeats, kind="stable"):
        cells = [c + 1 for c in range(len(counts)) for _ in range(int(matrix[c, k]))][::-1]
        todo = int(repeats[k])
        while todo:
            # A run of equal sequences ends where one of its lengths is used up.
            seen = _exact(cells, of_cell, there, left, bins.length, grid)
            if seen is None:
                break
            times = min([todo, *(left[s] // n for s, n in Counter(seen).items())])
            bins.new(seen, times)
            for s in seen:
                left[s] -= times
            for s in set(seen):
                if not left[s]:
                    there.remove(s)
                    of_cell[max(1, round(s / grid))].remove(s)
            todo -= times


# -- placing -----------------------------------------------------------------------------------


def ranked(cut_up: DataFrame) -> DataFrame:
    """Add ``rank``: a number from 0 within the pieces of a length."""
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return cut_up.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))


def placed(cut_up: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ids are gapless from 0 in every sequence."""
    spark = cut_up.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(sorted(plan_sequences(histogram, length)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)

    @F.arrow_udf(PLACE)
    def look_up(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        plan = shared.value
        # One sorted key per plan row: length, then first rank.
        wide = np.int64(1) << np.int64(48)
        keys = plan[:, 0] * wide + plan[:, 1]
        ranks = ranks.to_numpy()
        at = np.searchsorted(keys, sizes.to_numpy().astype(np.int64) * wide + ranks, "right") - 1
        sequence = plan[at, 2] + ranks - plan[at, 1]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(plan[at, 4])], ["sequence_id", "offset"])

    both = ranked(cut_up).withColumn("_at", look_up("length", "rank"))
    return both.select(
        *(c for c in cut_up.columns if c not in ("part", "place")),
        F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces that kept their ids; a sequence is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x.ids)).alias("ids")
    )


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    rows = placed(pieces(docs, text, (doc_id,)))
    long = ("length", "offset", "sequence_id", "start", "ids_crc32")
    columns = (F.col(c).cast("long").alias(c) if c in long else F.col(c) for c in OUT)
    return rows.select(F.col("_row")[doc_id].alias("doc_id"), *columns)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
