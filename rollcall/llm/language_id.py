"""Language of a text by cross-parsing: in which language's sample do its phrases occur?

**Letters.** Texts are read in lower case, and everything between letters is one space; a text
without a letter has no language. Characters get a number where they occur in the samples.

**Samples.** Labelled texts are picked by a hash of the id, about as many of each language; of
their pieces of ``PIECE`` characters, wherever they stand in a text, those with the smallest hashes
are kept until a language has its share of ``SAMPLE`` characters.

**Automaton.** A suffix automaton of each language's pieces accepts exactly the strings that occur in
one of them. A text is parsed greedily: a phrase goes on while the automaton accepts it, the next
begins at the character that did not fit (one that the sample lacks begins a phrase, and the match
after it belongs to the same phrase). One table of moves holds all languages; a failed move
goes straight to the state after the failing character, and its sign counts the phrase.

**Verdict.** With c phrases in n characters against a sample of m, a character costs c log2(m) / n
bits; the language with the fewest wins. Long texts are parsed in segments, side by side with the
segments of all other texts of a chunk, so that a task's step is one operation on all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import held_out, table
from rollcall.llm.registry import query

FOLDS, HELD = 3, 1
UNKNOWN = "und"
#: Labelled texts of a language to take pieces from, as hashes fall; characters of a piece.
LEARN_ROWS, PIECE = 1_000, 256
#: Characters of all languages' samples together, and of one language's at most.
SAMPLE, OF_ONE = 1 << 18, 1 << 15
#: A phrase ends at the latest where a segment of so many characters does.
SEGMENT = 4_096
#: Characters that a task parses side by side.
CHUNK = 1 << 22

#: What is no letter, and a text without one; combining marks stay with their letters.
GAP = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"


def letters(text: pa.Array) -> pa.Array:
    """Lower case, one space for every stretch without letters."""
    text = pc.utf8_lower(text.cast(pa.large_string()))
    return pc.utf8_trim(pc.replace_substring_regex(text, GAP, " "), " ")


# -- automata ----------------------------------------------------------------------------------


def suffix_automaton(pieces: list[str]) -> list[dict[str, int]]:
    """Moves of every state; state 0 is the start. Accepts what occurs in one of the pieces."""
    moves: list[dict[str, int]] = [{}]
    longest, link = [0], [-1]
    for piece in pieces:
        last = 0
        for c in piece:
            known = moves[last].get(c)
            if known is not None and longest[known] == longest[last] + 1:
                # An earlier piece has this string, and the state ends nothing longer.
                last = known
                continue
            if known is not None:
                last = _split(moves, longest, link, last, c, known)
                continue
            state = len(moves)
            moves.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = state
                at = link[at]
            if at >= 0:
                target = moves[at][c]
                link[state] = target if longest[target] == longest[at] + 1 else _split(moves, longest, link, at, c, target)
            last = state
    return moves


def _split(moves, longest, link, at, c, target) -> int:
    """A copy of ``target`` for the strings that reach it through ``at``."""
    copy = len(moves)
    moves.append(dict(moves[target]))
    longest.append(longest[at] + 1)
    link.append(link[target])
    link[target] = copy
    while at >= 0 and moves[at].get(c) == target:
        moves[at][c] = copy
        at = link[at]
    return copy


class Languages:
    """Moves of all languages' automata in one table."""

    def __init__(self, pieces: dict[str, list[str]]):
        self.names = sorted(pieces)
        self.sizes = np.array([sum(map(len, pieces[x])) for x in self.names], np.float64)
        alphabet = sorted({c for some in pieces.values() for piece in some for c in piece})
        #: Number of every code point; 0 stands for all that no sample has.
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        width = self.width = len(alphabet) + 1
        tables, self.roots, at = [], [], 0
        for name in self.names:
            automaton = suffix_automaton(pieces[name])
            moves = np.zeros((len(automaton), width), np.int64)
            rows = np.repeat(np.arange(len(automaton)), [len(m) for m in automaton])
            letter = self.numbers[[ord(c) for m in automaton for c in m]] if len(rows) else []
            moves[rows, letter] = [x for m in automaton for x in m.values()]
            # A state is the place of its row in the table; no move leads back to the start.
            root = at
            target = moves * width + root
            failed = moves == 0
            # A letter that the sample does not have begins a phrase, which the next match goes on with.
            target[failed] = -1 - np.broadcast_to(target[0], target.shape)[failed]
            tables.append(target.astype(np.int32).ravel())
            self.roots.append(root)
            at += moves.size
        if at >= 1 << 31:
            raise ValueError("the samples have too many different characters")
        self.moves = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: pa.Array) -> np.ndarray:
        """Number of phrases of every text in every language; no text is null."""
        codes, segment_of, starts, lengths = self._segments(texts)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        roots = np.array(self.roots, np.int32)[:, None]
        states = np.repeat(roots, len(order), axis=1)
        # The last phrase of a segment is open when the segment ends.
        counts = np.repeat((lengths > 0)[None].astype(np.int32), len(self.names), axis=0)
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        states_of, counts_of = states, counts
        for t, n in enumerate(alive.tolist()):
            states_of, counts_of = states_of[:, :n], counts_of[:, :n]
            found = self.moves[states_of + codes[starts[:n] + t]]
            sign = found >> 31
            np.bitwise_xor(found, sign, out=states_of)
            # The first character of a segment that no sample has begins the open phrase.
            counts_of -= sign if t else 0
        out = np.zeros((len(self.names), len(texts)), np.int64)
        for i in range(len(self.names)):
            np.add.at(out[i], segment_of[order], counts[i])
        return out

    def _segments(self, texts: pa.Array):
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        codes = self.numbers[points]
        sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
        parts = -(-sizes // SEGMENT)
        segment_of = np.repeat(np.arange(len(sizes)), parts)
        turn = np.arange(len(segment_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = (np.cumsum(sizes) - sizes)[segment_of] + turn * SEGMENT
        return codes, segment_of, starts, np.minimum(SEGMENT, sizes[segment_of] - turn * SEGMENT)

    def verdicts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of texts that have letters; ties go to the first name.

        The score is 1 less the quotient of the best and the second-best cost, 1 if there is but
        one language.
        """
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.phrases(texts) * np.log2(self.sizes + 1)[:, None]
        best = bits.argmin(0)
        ranked = np.sort(bits, axis=0)
        score = 1 - ranked[0] / ranked[1] if len(self.names) > 1 else np.ones(len(texts))
        return [self.names[i] for i in best], score


# -- over tables -------------------------------------------------------------------------------


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Automata from a bounded sample of the labelled texts that are not held out.

    Texts without an id, a language or a letter count for nothing. Of a language with at most
    ``LEARN_ROWS`` texts all are used; rows that repeat an id are taken or left together.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col(doc_id), F.lit(lang))
    wanted = F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    known = docs.filter(wanted & ~held_out(doc_id, FOLDS, HELD)).select(
        F.col(lang).cast("string").alias("lang"), order.alias("order"), F.col(text).alias("text")
    )
    # The share of hashes that gives a language its rows; one row a language, as many as automata.
    sizes = known.groupBy("lang").count().collect()
    span = (1 << 64) - 1
    last = [(r["lang"], min(1.0, LEARN_ROWS / r["count"])) for r in sizes]
    last = [(name, int(part * span) - (1 << 63) if part < 1 else (1 << 63) - 1) for name, part in last]
    limits = F.broadcast(spark.createDataFrame(last, "of string, last bigint"))
    some = known.join(limits, (F.col("lang") == F.col("of")) & (F.col("order") <= F.col("last")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, plain in enumerate(letters(batch.column(2)).to_pylist()):
                starts = range(0, len(plain), PIECE)
                size, seed = len(starts), batch.column(1)[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * size, pa.string()),
                        pa.array([plain[at : at + PIECE] for at in starts], pa.string()),
                        pa.array([zlib.crc32(b"%d,%d" % (seed, at)) for at in starts], pa.int64()),
                    ],
                    names=["lang", "piece", "at"],
                )

    piece = some.select("lang", "order", "text").mapInArrow(cut, "lang string, piece string, at bigint")
    share = min(OF_ONE, SAMPLE // max(1, len(last)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "piece"))
    taken = piece.withColumn("place", place).filter(F.col("place") <= max(1, share // PIECE))
    pieces: dict[str, list[str]] = {}
    for row in taken.orderBy("lang", "place").select("lang", "piece").collect():
        pieces.setdefault(row["lang"], []).append(row["piece"])
    return Languages(pieces)


def identified(docs: DataFrame, languages: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    A null text, one without a letter, and any text where no language was learnt is ``und`` with
    score 0. A row without an id is not held out. Rows that repeat are judged each. Other columns
    are not read, so their names cannot clash; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, FOLDS, HELD).alias("held_out"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            chunk = (np.cumsum(sizes) - sizes) // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if end > at:
                    yield judged(own, batch.slice(at, end - at))

    def judged(own: Languages, part: pa.RecordBatch) -> pa.RecordBatch:
        text = part.column(2)
        has = pc.fill_null(pc.match_substring_regex(text, LETTER), False).to_numpy(zero_copy_only=False)
        names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
        found, score = own.verdicts(letters(text.filter(pa.array(has))))
        names[has], scores[has] = found, score
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return rows.mapInArrow(work, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs))
