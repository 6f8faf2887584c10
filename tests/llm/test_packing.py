from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rollcall.llm import packing
from tables import documents  # noqa: F401

PATH = public_tokenizers.path(packing.VOCABULARY)


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_whole_texts():
    rng = random.Random(3)
    alphabet = "aB é́ \u0085\x01|<>endoftext's1½ﬁ中　​\U0001f600\n\t\x0b-Ißß&*"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["x" + chr(c) + "Y " + chr(c) for c in range(1, 0x2000)]
    texts += ["", "<|endoftext|>x <|endoftext|>", "İI ŞS", "it's they'LL 'S", "a" * 5000]
    assert packing.Encoder(PATH).encode(texts) == whole(texts)


def test_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    texts = [" ".join(f"w{chr(97 + i % 26)}{i % 17}" for i in range(k, k + 40)) for k in range(30)]
    assert packing.Encoder(PATH).encode(texts + texts) == whole(texts + texts)


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12)
        x = packing.least_squares(a, b)
        slope = a.T @ (b - a @ x)
        # The conditions that hold at the least of a convex function, and there only.
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope[x > 0]).max(initial=0) < 1e-6


def test_fullest_against_all_patterns():
    rng = np.random.default_rng(2)
    for cells in (1, 5, 9):
        worth = rng.normal(size=cells)
        most = 0.0
        todo = [(0.0, cells, cells)]
        while todo:
            value, room, longest = todo.pop()
            most = max(most, value)
            todo += [(value + worth[c - 1], room - c, c) for c in range(1, min(room, longest) + 1)]
        taken = packing.fullest(worth)
        assert taken @ np.arange(1, cells + 1) <= cells and taken @ worth == pytest.approx(most)


def test_patterns_reproduce_the_histogram():
    """Also one of short lengths only, which no three of them fill."""
    rng = np.random.default_rng(4)
    for most in (32, 6):
        counts = np.zeros(32)
        counts[:most] = rng.integers(0, 5000, most)
        matrix, repeats = packing.fitted(counts)
        assert (matrix.T @ np.arange(1, 33) <= 32).all() and (repeats > 0).all()
        assert np.abs(matrix @ repeats - counts).max() < 0.01 * counts.max()


@pytest.mark.parametrize("most", [300, 1000, 4000])
def test_most_pieces_follow_patterns(most):
    rng = random.Random(most)
    sizes = dict(sorted(Counter(rng.randrange(1, most) for _ in range(20000)).items()))
    bins = packing.Bins(4096)
    left = packing.follow_patterns(bins, sizes)
    assert sum(left.values()) < 20000 / 4
    # Sequences by patterns are full.
    assert not any(bins.groups.values())
    assert bins.next * 4096 == sum(size * count for size, _, _, count, _ in bins.plan)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    sizes = [
        [rng.randrange(1, 4097) for _ in range(3000)],
        [4096] * 5 + [1] * 5000,
        [2049] * 300 + [2047] * 200,
        [int(min(4096, rng.lognormvariate(6, 1))) + 1 for _ in range(20000)],
        [700] * 1000,
        [],
    ][seed]
    sizes = [min(s, 4096) for s in sizes]
    histogram = Counter(sizes)
    ranks, bins = defaultdict(set), defaultdict(list)
    for size, rank, first, count, offset in packing.plan_sequences(histogram):
        assert not ranks[size] & set(range(rank, rank + count))
        ranks[size] |= set(range(rank, rank + count))
        for i in range(count):
            bins[first + i].append((offset, size))
    assert {s: len(r) for s, r in ranks.items()} == histogram
    assert all(ranks[s] == set(range(n)) for s, n in histogram.items())
    for parts in bins.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 4096
    # First fit, longest first, one piece at a time.
    rooms = []
    for size in sorted(sizes, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(4096)
            at = -1
        rooms[at] -= size
    assert len(bins) <= 1.01 * len(rooms) + 1


def check(rows, docs, length=4096):
    """Against plain tokenizing, cutting and adding up."""
    coded = [x + b"\x01\0\0\0" for x in whole([t or "" for _, t in docs])]
    want = Counter()
    for (doc, _), ids in zip(docs, coded, strict=True):
        for k, at in enumerate(range(0, len(ids), 4 * length)):
            part = ids[at : at + 4 * length]
            want[doc, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= length
    return len(bins)


def test_documents(spark, documents):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (4, "same"), (4, "same")]
    docs += [(5, " ".join(f"long{i}" for i in range(30000))), (6, "a " * 4095), (7, "a " * 4096)]
    df = documents(docs, ["'x' as piece", "1 as length", "2 as part", "3 as place"]).repartition(3)
    cut_up = packing.pieces(df, keep_ids=True)
    packed = packing.placed(cut_up)
    check(packed.select("_row.doc_id", *packing.OUT).collect(), docs)
    by_id = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert by_id[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.placed(packing.pieces(df.limit(0))).count() == 0


def test_query(spark, small):
    rows = packing.op8_packing(spark, small).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    used = check(rows, docs)
    assert used <= 1.01 * sum(r.length for r in rows) / 4096 + 2


def test_words_are_remembered_in_little_memory():
    """What a worker keeps between tasks stays small, also where chunks hardly ever repeat."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20_000)]
    texts = [" ".join(f"{rng.choice(words)}{rng.choice('.,;:!?#')}{rng.choice('.,;:!?#')}" for _ in range(200)) for _ in range(1000)]
    encoder = packing.Encoder(PATH)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    for at in range(0, 1000, 100):
        encoder.encode(texts[at : at + 100])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 4e6 and encoder.encode(texts[:20]) == whole(texts[:20])


def test_slices_hold_the_bytes_they_may():
    texts = ["x" * n for n in (3, 3, 5, 20, 0, 1)] + [None, "y" * 9]
    batch = pa.record_batch({"n": range(8), "text": texts})
    assert [part.column(0).to_pylist() for part in packing.slices(batch, 1, 8)] == [[0, 1], [2], [3], [4, 5, 6], [7]]
