"""Which tokens of two tokenizers end together, and how often each pair does in the corpus.

A reads a space and the text with a byte-level vocabulary, B reads the text with a vocabulary of
pieces, which puts the space there itself; so both cover the same bytes. Where a token of A and a
token of B end at the same byte they are linked, and these bytes cut both streams into groups.

**Tokens.** Neither vocabulary has a token that goes from another character over to a space, so
single spaces inside a text part what can be encoded alone. Texts are split there, and each
different word of a chunk is encoded once; a text with a run of spaces, or a space at either end,
is encoded in one piece.

**Links.** All steps of a chunk are Arrow operations: words and tokens are flattened lists with
their parent indices, byte ends are cumulative sums less the sum before the text, links are a hash
join on (document, end), and pairs are counted by grouping the links. A chunk holds whole texts of
some megabytes together; a longer text is a chunk of its own.

**Counts.** Spark adds up the counts of all chunks. A chunk's links are numbers in the chunk's own
list of pairs, so only the pairs of a chunk, not its links, are joined to the counts; they come
back to the chunk by its number.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import table, written
from rollcall.llm.registry import query

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that a task works on at once (a longer text: by itself).
CHUNK_BYTES = 2 << 20
#: Strings below this character have the same ids in both libraries for A.
PLAIN = "\u0250"
#: An id pair as one number: A's id in the upper half.
B_BITS = 32

NUMBERS = ("n_a", "n_b", "n_groups")


# -- vocabularies ------------------------------------------------------------------------------


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from
    256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def large(separator: str) -> pa.Scalar:
    return pa.scalar(separator, pa.large_string())


class Side:
    """One tokenizer: ids of many strings, and the bytes of every id."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes = pa.array(bytes_of, pa.large_binary())
        self.lengths = pc.binary_length(self.bytes)
        self.names = pa.array([str(i) for i in range(len(bytes_of))], pa.large_string())

    def encode(self, strings: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def lists(self, strings: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of each string, and whether their bytes are a space and the string."""
        ids = self.encode(strings.to_pylist())
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
        given = pc.binary_join(pa.ListArray.from_arrays(ends, self.bytes.take(flat)), pa.scalar(b"", pa.large_binary()))
        wanted = pc.binary_join_element_wise(large(" "), strings, large("")).cast(pa.large_binary())
        return pa.ListArray.from_arrays(ends, flat), pc.equal(given, wanted).to_numpy(zero_copy_only=False)


class ByteLevel(Side):
    """A: a space is put before the string.

    Strings of characters under ``PLAIN`` are encoded by the same vocabulary as ranks, where every
    merge makes the next id; the character classes that part a string are the same in both
    libraries there (a test goes through all of them). All others go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        # The strings of special tokens are plain text here.
        self.model.encode_special_tokens = True
        symbols = byte_symbols()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.model.get_added_tokens_decoder().values()}
        bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            bytes_of[number] = token.encode() if token in special else bytes(symbols[c] for c in token)
        super().__init__(bytes_of)
        self.ranked = None
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        made = [vocabulary.get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in merges]
        if made == list(range(256, 256 + len(merges))):
            ranks = {b: i for i, b in enumerate(bytes_of[: 256 + len(merges)])}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, strings: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return self.exact(strings)
        one = self.ranked.encode_ordinary
        ids = [None if max(s, default="") >= PLAIN else one(" " + s) for s in strings]
        others = [i for i, some in enumerate(ids) if some is None]
        for i, some in zip(others, self.exact([strings[i] for i in others]), strict=True):
            ids[i] = some
        return ids

    def exact(self, strings: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast([" " + s for s in strings], add_special_tokens=False)
        return [x.ids for x in found]


class Pieces(Side):
    """B: the model puts the space there itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = self.model.id_to_piece(list(ids))
        super().__init__(
            [
                bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
                for i, piece in zip(ids, pieces, strict=True)
            ]
        )

    def encode(self, strings: list[str]) -> list[list[int]]:
        return self.model.encode(strings, num_threads=1) if strings else []


@functools.lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return ByteLevel(path_a), Pieces(path_b)


# -- one chunk of texts ------------------------------------------------------------------------


def units(text: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """Which texts (null and empty ones are left out), and for each what is encoded alone."""
    text = text.cast(pa.large_string())
    full = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
    split = pc.and_(full, pc.invert(pc.fill_null(pc.match_substring_regex(text, "^ | $|  "), True)))
    whole = pc.and_(full, pc.invert(split))
    parted = pc.split_pattern(text.filter(split), " ")
    kept = text.filter(whole)
    single = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32), kept)
    rows = [np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (split, whole)]
    return np.concatenate(rows), pa.concat_arrays([parted, single])


class Stream:
    """The tokens of all texts of a chunk in one tokenizer: ids, document and byte end of each."""

    def __init__(self, side: Side, lists: pa.ListArray, words: pa.Array, owner: np.ndarray, documents: int):
        tokens = lists.take(words)
        self.ids = tokens.flatten()
        self.document = owner[pc.list_parent_indices(tokens).to_numpy()]
        reached = pc.cumulative_sum(side.lengths.take(self.ids)).to_numpy()
        self.counts = np.bincount(self.document, minlength=documents)
        # The sum before a document's first token is taken away from all of its tokens.
        first = np.cumsum(self.counts) - self.counts
        before = np.concatenate([np.zeros(1, np.int64), reached])[first]
        self.ends = reached - before[self.document]

    def keys(self, name: str) -> pa.Table:
        return pa.table({"document": self.document, "end": self.ends, name: np.arange(len(self.ids))})


def joined_groups(side: Side, ids: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The ids between cuts, comma-joined."""
    ends = np.concatenate([np.zeros(1, np.int64), cuts + 1])
    return pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), side.names.take(ids)), large(","))


def aligned(a: Side, b: Side, text: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array, list[pa.Array], pa.Table]:
    """Per text: its numbers, its digest and its links (places in the list of pairs); (pair, n)."""
    size = len(text)
    which, lists = units(text)
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary
    lists_a, exact_a = a.lists(words)
    lists_b, exact_b = b.lists(words)
    owner = which[pc.list_parent_indices(lists).to_numpy()]
    # No tokens for a text where the bytes of either side are not the space and the text.
    bad = np.zeros(size, bool)
    word = encoded.indices.to_numpy()
    bad[owner[~(exact_a & exact_b)[word]]] = True
    good = ~bad[owner]
    word, owner = pa.array(word[good]), owner[good]
    # Documents in the order of the streams.
    order = which[~bad[which]]
    number = np.zeros(size, np.int64)
    number[order] = np.arange(len(order))
    owner = number[owner]
    left, right = (Stream(s, x, word, owner, len(order)) for s, x in ((a, lists_a), (b, lists_b)))

    links = left.keys("a").join(right.keys("b"), ["document", "end"], join_type="inner", use_threads=False)
    links = links.sort_by([("a", "ascending"), ("b", "ascending")]).combine_chunks()
    at_a, at_b = links["a"].to_numpy(), links["b"].to_numpy()
    pair = pa.array(left.ids.to_numpy()[at_a].astype(np.int64) << B_BITS | right.ids.to_numpy()[at_b])
    pairs = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    # The commonest pairs first: their numbers are small.
    pairs = pairs.rename_columns(["pair", "n"]).sort_by([("n", "descending"), ("pair", "ascending")]).combine_chunks()
    linked = pc.index_in(pair, value_set=pairs["pair"].combine_chunks())

    cuts_a, cuts_b = (np.flatnonzero(np.bincount(at)) for at in (at_a, at_b))
    groups = pc.binary_join_element_wise(joined_groups(a, left.ids, cuts_a), joined_groups(b, right.ids, cuts_b), large("|"))
    per_document = np.bincount(left.document[cuts_a], minlength=len(order))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_document)]).astype(np.int32)
    strings = pc.binary_join(pa.ListArray.from_arrays(ends, groups), large(";"))

    def spread(values) -> np.ndarray:
        out = np.zeros(size, np.int64)
        out[order] = values
        return out

    digests = [""] * size
    for row, string in zip(order.tolist(), strings, strict=True):
        digests[row] = hashlib.sha256(string.as_buffer()).hexdigest()
    n_links = np.bincount(left.document[at_a], minlength=len(order))
    numbers = {"n_a": spread(left.counts), "n_b": spread(right.counts), "n_groups": spread(per_document)}
    # Links come document by document in the order of the streams; the texts in their own order.
    stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_links)]).astype(np.int32)
    of_order = pa.ListArray.from_arrays(stops, linked.cast(pa.int32()))
    place = np.where(bad | ~np.isin(np.arange(size), which), -1, number)
    links_of = of_order.take(pa.array(place, pa.int64(), mask=place < 0))
    return numbers, pa.array(digests, pa.string()), links_of, pairs


# -- all texts ---------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows that hold about ``CHUNK_BYTES`` of text together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    chunk = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    starts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
    for at, end in zip(starts, starts[1:], strict=False):
        if end > at:
            yield batch.slice(at, end - at)


def linked_chunks(rows: DataFrame, path_a: str, path_b: str, doc_type: str) -> DataFrame:
    """Rows of two kinds, by chunk: texts with their links, and the pairs of the chunk (pair, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices(batch):
                numbers, digests, links, pairs = aligned(a, b, part.column(1))
                size, chunk = part.num_rows, chunk + 1
                empty = pa.array([None], pa.list_(pa.int64()))

                def whole(column: str, pairs: pa.Table = pairs) -> pa.ListArray:
                    return pa.ListArray.from_arrays([0, pairs.num_rows], pairs[column].combine_chunks().cast(pa.int64()))

                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * size, pa.int64()), part.column(0), *map(pa.array, numbers.values()), digests,
                     links, empty.take(pa.array([0] * size)), empty.take(pa.array([0] * size))],
                    names=NAMES,
                )
                nothing = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.nulls(1, part.column(0).type), nothing, nothing, nothing,
                     pa.array([None], pa.string()), pa.array([None], pa.list_(pa.int32())), whole("pair"), whole("n")],
                    names=NAMES,
                )

    kind = (
        f"chunk bigint, doc_id {doc_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
        "links array<int>, pairs array<bigint>, n array<bigint>"
    )
    return rows.mapInArrow(work, kind)


NAMES = ["chunk", "doc_id", *NUMBERS, "groups_sha256", "links", "pairs", "n"]


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus; best: no pair with the same B id has a larger count."""
    each = chunks.filter(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "n")).alias("p"))
    counts = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    vocabulary_a: str | None = None,
    vocabulary_b: str | None = None,
) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one whose bytes a tokenizer does not give back (U+2581 becomes a
    space in B), has zeros and an empty digest. Rows that repeat, also with a null id, are counted
    each. Other columns are not read, so their names cannot clash. An empty table gives no row.
    """
    path_a = vocabulary_a or public_tokenizers.path(VOCABULARY_A)
    path_b = vocabulary_b or public_tokenizers.path(VOCABULARY_B)
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chunks = written(linked_chunks(rows, path_a, path_b, id_type.simpleString()), "links")
    listed = chunks.filter(F.col("pairs").isNotNull()).select("chunk", F.posexplode("pairs").alias("place", "pair"))
    counted = listed.join(pair_counts(chunks), "pair").select("chunk", "place", "count", "best")
    texts = chunks.filter(F.col("n_a").isNotNull()).drop("pairs", "n").withColumnRenamed("chunk", "of_chunk")

    def summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        documents = documents.combine_chunks()
        links = documents["links"].combine_chunks() if documents.num_rows else pa.array([], pa.list_(pa.int32()))
        lengths = pc.fill_null(pc.list_value_length(links), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, place = links.flatten().to_numpy(), pairs["place"].to_numpy()
        count, best = (np.zeros(pairs.num_rows, np.int64) for _ in range(2))
        count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)

        def total(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values[flat])])
            return pa.array(sums[ends] - sums[ends - lengths], pa.int64())

        return pa.table(
            {
                **{c: documents[c] for c in ("doc_id", *NUMBERS)},
                "n_links": pa.array(lengths), "n_best": total(best), "count_sum": total(count),
                "groups_sha256": documents["groups_sha256"],
            }
        )

    kind = (
        f"doc_id {id_type.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "n_best bigint, count_sum bigint, groups_sha256 string"
    )
    return texts.groupBy("of_chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lambda d, p: summed(d, p), kind)


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))
