from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import same

from rollcall.llm import mixing
from tables import documents  # noqa: F401


def plain_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target | {s: 3.0 * sizes[s] for s in stopped}
        stopped |= above


def corpus(seed, sources=7, n=150):
    rng = random.Random(seed)
    names = ["b", "a", None, "B", "é", "z", "\U0001f600"][:sources]
    rows = []
    for i in range(n):
        source = names[0] if rng.random() < 0.4 else rng.choice(names)
        rows.append((i, " ".join(f"w{k}" for k in range(rng.choice([0, 1, 5, 40, 3000]))), source))
    return rows + [(3, None, "a"), (None, "x y", None), (5, "same row", "b"), (5, "same row", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, documents, seed):
    rows = corpus(seed)
    df = documents(rows, ["'k' as key", "1 as size", "2 as row", "3 as part"])
    got = mixing.mixed(mixing.sized(df)).join(
        mixing.sized(df).select("row", "source"), "row"
    ).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    same(mixing.mixed(mixing.sized(df)).drop("row"), mixing.SQL, {"documents": df.toArrow()})


def test_schedule_is_close_to_the_weights_everywhere(spark):
    slots = {"a": 500, "b": 200, "c": 100, "d": 1, "e": 2, "f": 37}
    first, rows = 0, []
    for key, n in slots.items():
        rows.append((key, n, first))
        first += n
    targets = spark.createDataFrame(rows, "key string, slots bigint, first_slot bigint")
    plan = sorted(mixing.schedule(spark, targets).collect())
    for key, n in slots.items():
        assert [r["block"] for r in plan if r["key"] == key] == list(range(n))
    for at in range(50, 700, 50):
        seen = sum(r["key"] == "a" for r in plan[:at])
        assert abs(seen - at * 500 / 840) <= 4


def test_every_source_gets_its_slots(spark):
    for n in (1, 2, 3, 9, 5000):
        targets = spark.createDataFrame([("a", n, 0), ("b", 1, n)], "key string, slots bigint, first_slot bigint")
        assert mixing.schedule(spark, targets).count() == n + 1


def test_documents_of_the_mix(spark, documents):
    df = documents(corpus(4), ["'k' as key", "7 as taken"])
    taken = Counter()
    for r in mixing.mixed(mixing.sized(df)).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert +words == +taken


def test_empty(spark, documents):
    df = documents([(1, "", "a"), (2, None, None)])
    assert {r["taken"] for r in mixing.mixed(mixing.sized(df)).collect()} == {0}
    assert mixing.mixed(mixing.sized(df.limit(0))).count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_query_against_sql(spark, small):
    same(mixing.op10_schedule(spark, small), mixing.SQL, {"documents": f"{small}/documents.parquet"})
