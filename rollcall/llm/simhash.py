"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

A fingerprint is 64 bits; two fingerprints link if they differ in at most three. The distinct
fingerprints, not the documents, are searched:

* **Dealing out.** Of four 16-bit blocks, two linked fingerprints agree in at least one; of the
  four 12-bit parts of the other 48 bits again in at least one. So each fingerprint is dealt out
  16 times under a 28-bit key, and every link meets under some key. One 16-bit block alone would
  make hot keys where many near copies share it.
* **Index.** A task turns each code so that its key is in the upper bits, sorts the codes by their
  rank in the reflected Gray code, in which neighbours differ in few bits, and builds a tree over
  runs of the sorted list. A node holds the bits that all its members share and its parent does
  not yet hold (mask and pattern). A search walks down with all codes at once, adds up the
  differing bits of the patterns on its way, and drops a whole group once the sum passes three.
* **Links.** A pair is taken under the first key in which it agrees, so it is found once. A task
  returns a spanning forest of its links instead of all pairs: same components, at most one row
  per code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import salted_lookup, table, written
from rollcall.llm.components import components
from rollcall.llm.registry import query
from rollcall.operators.keys import unique_side

SEED = 42
SHINGLE = 3
LIMIT = 3
#: Children of an index node.
FAN_OUT = 8
#: (code, node) pairs that a search holds at once.
FRONTIER = 1 << 20
#: Codes that a task holds, unless one key has more.
HELD = 1 << 18

_KEY = np.uint64(((1 << 28) - 1) << 36)
_ALL = np.uint64((1 << 64) - 1)
_LOW48 = np.uint64((1 << 48) - 1)


# -- fingerprints ------------------------------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1
    )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in more than half of the shingle hashes; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        # Sums of 255 bits fit into a byte, which adds up far faster than wide integers.
        blocks = bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8)
        votes += blocks.sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        codes = [fingerprint(x.as_py()) for x in batch]
        yield pa.array(np.array(codes, np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long with the same bits."""
    return _fingerprints(text)


# -- index -------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray code. Codes with equal upper bits stay together."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over codes in Gray order: per node, the bits first shared at its level."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes))]
        ands, ors = [self.codes], [self.codes]
        while len(ands[-1]) > FAN_OUT:
            starts = np.arange(0, len(ands[-1]), FAN_OUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], starts))
            ors.append(np.bitwise_or.reduceat(ors[-1], starts))
        masks = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        self.patterns = ands
        # What the parent shares is already counted on the way down.
        self.masks = [
            mask & ~np.repeat(up, FAN_OUT)[: len(mask)]
            for mask, up in zip(masks, [*masks[1:], np.zeros(1, np.uint64)], strict=False)
        ]

    def pairs(self, same: np.uint64 = np.uint64(0), limit: int = LIMIT) -> Iterator[tuple]:
        """Places (i, j), i < j, of codes within ``limit`` bits that agree in the bits ``same``."""
        top = len(self.masks) - 1
        width = len(self.masks[top])
        step = max(1, FRONTIER // FAN_OUT)
        todo = []
        for at in range(0, len(self.codes), step):
            q = np.arange(at, min(at + step, len(self.codes)))
            todo.append((top, np.repeat(q, width), np.tile(np.arange(width), len(q)), None))
        while todo:
            level, q, node, sums = todo.pop()
            differs = (self.codes[q] ^ self.patterns[level][node]) & self.masks[level][node]
            counted = np.bitwise_count(differs)
            sums = counted if sums is None else sums + counted
            # The last member of the node must come after the code itself.
            kept = (sums <= limit) & ((differs & same) == 0) & ((node + 1) * FAN_OUT**level - 1 > q)
            q, node, sums = q[kept], node[kept], sums[kept]
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            below = len(self.masks[level - 1])
            for at in range(0, len(q), step):
                children = (node[at : at + step, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                inside = children < below
                todo.append((
                    level - 1,
                    np.repeat(q[at : at + step], FAN_OUT)[inside],
                    children[inside],
                    np.repeat(sums[at : at + step], FAN_OUT)[inside],
                ))


def _turned(codes: np.ndarray, block: int, part: int) -> np.ndarray:
    """The codes with block and part in the upper 28 bits."""
    b, s = np.uint64(16 * block), np.uint64(12 * part)
    if block:
        codes = (codes << b) | (codes >> np.uint64(64 - 16 * block))
    low = codes & _LOW48
    if part:
        low = ((low << s) | (low >> np.uint64(48 - 12 * part))) & _LOW48
    return (codes & ~_LOW48) | low


def _turned_back(codes: np.ndarray, block: int, part: int) -> np.ndarray:
    low = codes & _LOW48
    if part:
        low = ((low >> np.uint64(12 * part)) | (low << np.uint64(48 - 12 * part))) & _LOW48
    codes = (codes & ~_LOW48) | low
    if block:
        codes = (codes >> np.uint64(16 * block)) | (codes << np.uint64(64 - 16 * block))
    return codes


def _is_first(xor: np.ndarray, block: int, part: int) -> np.ndarray:
    """Whether the codes, turned by block and part, agree under no earlier key."""
    low = xor & _LOW48
    if part:
        low = ((low >> np.uint64(12 * part)) | (low << np.uint64(48 - 12 * part))) & _LOW48
    first = np.ones(len(xor), bool)
    for earlier in range(part):
        first &= (low >> np.uint64(36 - 12 * earlier)) & np.uint64(0xFFF) != 0
    plain = _turned_back(xor, block, part)
    for earlier in range(block):
        first &= (plain >> np.uint64(48 - 16 * earlier)) & np.uint64(0xFFFF) != 0
    return first


def _forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The component of each of n codes, given the found pairs."""
    parent = np.arange(n)
    for a, b in found:
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        up = parent.tolist()
        for x, y in set(zip(a[apart].tolist(), b[apart].tolist(), strict=True)):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        parent = np.array(up)
    while not np.array_equal(parent, up := parent[parent]):
        parent = up
    return parent


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes sorted by key in, a spanning forest of the links within each key out.

    Whole keys are worked off as soon as ``HELD`` codes have come, so that a task holds these or
    the codes of one key, however many its partition has.
    """
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size < HELD:
            continue
        rows = np.concatenate(held, 1)
        # The last key may go on.
        last = int(np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0))[-1]) + 1 if (rows[:2] != rows[:2, -1:]).any() else 0
        yield from _links_of(rows[:, :last])
        held, size = [rows[:, last:]], rows.shape[1] - last
    if size:
        yield from _links_of(np.concatenate(held, 1))


def _links_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within the keys of (k, bits, code) rows."""
    key, code = rows[0], rows[2].view(np.uint64)
    for k in np.unique(key).tolist():
        block, part = divmod(k, 4)
        index = GrayIndex(_turned(code[key == k], block, part))

        def found(index=index, block=block, part=part):
            for a, b in index.pairs(_KEY):
                first = _is_first(index.codes[a] ^ index.codes[b], block, part)
                yield a[first], b[first]

        root = _forest(len(index.codes), found())
        hung = np.flatnonzero(root != np.arange(len(root)))
        ends = [_turned_back(index.codes[x], block, part) for x in (hung, root[hung])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)) for x in ends], names=["src", "dst"]
        )


def _dealt(codes: DataFrame) -> DataFrame:
    """Each code under its 16 keys: which (0 to 15) and the 28 bits."""
    code = F.col("code")

    def bits(shift: int, width: int) -> Column:
        return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for block in range(4):
        upper = bits(48 - 16 * block, 16)
        # The other 48 bits, read on from the end of the block and around.
        turned = F.shiftleft(code, 16 * block)
        if block:
            turned = turned.bitwiseOR(F.shiftrightunsigned(code, 64 - 16 * block))
        for part in range(4):
            lower = F.shiftrightunsigned(turned, 36 - 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.struct(F.lit(4 * block + part).alias("k"), (upper * 4096 + lower).alias("bits")))
    return codes.select("code", F.explode(F.array(*keys)).alias("key"))


def links(codes: DataFrame) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs of codes within three bits.

    ``codes`` has one column ``code`` (long) of distinct fingerprints; nulls are left out.
    """
    dealt = _dealt(codes.filter("code is not null")).select("key.k", "key.bits", "code")
    dealt = dealt.repartition("k", "bits").sortWithinPartitions("k", "bits")
    return dealt.mapInArrow(_linked, "src bigint, dst bigint")


# -- documents ---------------------------------------------------------------------------------


def _labelled(prints: DataFrame) -> DataFrame:
    """Add component_id and copies to written (row, doc_id, code) rows."""
    codes = written(
        prints.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")),
        "codes",
    )
    rooted = components(links(codes.select("code"))).join(
        codes.select(F.col("code").alias("node"), "first"), "node"
    )
    least = unique_side(rooted, "root", [F.min("first").alias("component")])
    reached = rooted.join(least, "root").select(F.col("node").alias("code"), F.col("root"), "component")
    labels = codes.join(reached, "code", "left").select(
        "code", "copies", F.coalesce("component", "first").alias("component_id"), F.coalesce("root", "code").alias("root")
    )
    return salted_lookup(prints, labels, "code", ["row"])


def _prints(docs: DataFrame, doc_id: str, text: str, *carry) -> DataFrame:
    return written(
        docs.select(
            *carry,
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            fingerprint_column(F.col(text)).alias("code"),
        ),
        "fingerprints",
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every component, with its columns: that with the smallest doc_id.

    Of rows that share it the first read stays; a component without any doc_id keeps one row too.
    """
    prints = _prints(docs, doc_id, text, F.struct("*").alias("kept"))
    groups = _labelled(prints.select("row", "doc_id", "code"))
    # The least (id, row) of a component; a null id comes last.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    first = groups.groupBy("root").agg(best.alias("best")).select("best.row")
    return prints.join(first, "row", "left_semi").select(*(F.col("kept")[c].alias(c) for c in docs.columns))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for every row of ``docs``.

    component_id is the least doc_id that can be reached over links, copies the number of rows
    with the same fingerprint. A null or blank text has fingerprint zero and links like any other.
    A null doc_id is never the least unless the whole component has none; equal rows each get a row.
    """
    return _labelled(_prints(docs, doc_id, text)).select(
        "doc_id",
        F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"),
        "component_id",
        "copies",
    )


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
