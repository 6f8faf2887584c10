from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from rollcall.llm import hnsw


def brute(rows, step=1, k=5):
    """Every usable row is compared with every query row but itself: query id, then answers of its rows."""
    good = [
        (i, v) for i, v in rows
        if not (i is None or v is None or None in v or not np.isfinite(v).all() or not np.any(v))
    ]
    out = {}
    for n, (q, v) in enumerate(good):
        if q % step:
            continue
        some = [(c, w) for m, (c, w) in enumerate(good) if m != n and len(w) == len(v)]
        if some:
            scores = hnsw.cosines(np.array(v, float), np.array([w for _, w in some], float))
            found = sorted((-s, c) for s, (c, _) in zip(scores.tolist(), some, strict=True))[:k]
            out.setdefault(q, []).extend((n, *x) for n, x in enumerate(found, 1))
    return out


def recall(got, want):
    """Answers of a query id are compared as a bag, since its rows may find the same."""
    here = {}
    for r in got:
        here.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum((Counter(here.get(q, [])) & Counter(c for _, _, c in some)).total() for q, some in want.items())
    return hits / sum(map(len, want.values()))


def test_graph_recall_and_reach():
    rng = np.random.default_rng(1)
    for spread in (1.0, 0.05):
        centres = rng.normal(size=(20, 32))
        x = centres[rng.integers(0, 20, 3000)] + spread * rng.normal(size=(3000, 32))
        unit = hnsw._unit(x)
        graph = hnsw.Graph.build(unit[:2800], 3)
        exact = np.argsort(-(unit[2800:] @ unit[:2800].T), 1)[:, :5]
        found = graph.search(unit[2800:])[:, :5]
        assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(found, exact, strict=True)]) > 0.95


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_shards_are_searched_whole(n):
    unit = hnsw._unit(np.random.default_rng(n).normal(size=(n, 8)))
    found = hnsw.Graph.build(unit, 0).search(unit)
    assert all(set(row[row >= 0]) == set(range(n)) for row in found)
    assert (found[:, 0] == np.arange(n)).all()


def test_edges_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(300)]
    rows += [(600 + i, [2.0, -0.0, 0, 0, 0, 0]) for i in range(3)]
    rows += [(700, None), (701, [0.0] * 6), (702, [1.0, None, 0, 0, 0, 0]), (703, [float("nan")] * 6)]
    rows += [(704, [float("inf"), 1, 1, 1, 1, 1]), (None, [1.0, 1, 1, 1, 1, 1]), (705, [1.0, 2.0]), (706, [3.0, 1.0])]
    # Ids that repeat with another vector and with the same one.
    rows += [(5, [9.0, 9, 9, 9, 9, 9]), (5, [9.0, 9, 9, 9, 9, 8]), (200, [1.0, 0, 0, 0, 0, 0]), rows[7], rows[7]]
    rows += [(707, []), (708, [1e300, 0, 0, 0, 0, 0]), (709, [3.0])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as shard", "2 as dim", "3 as vector")
    table = hnsw.vectors(df)
    got = hnsw.search(hnsw.index(table, shard_rows=60), table, block_rows=50).collect()
    want = brute(rows)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], -r["score"]))
    assert set(by_query) == set(want)
    for q, some in want.items():
        assert [r for r, _ in sorted(by_query[q])] == [r for r, _, _ in sorted(some)]
        assert [s for _, s in sorted(by_query[q])] == pytest.approx([s for _, s, _ in sorted(some)], abs=1e-12)
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 5) == sorted(c for _, _, c in want[5])
    assert sum(c == 5 for _, _, c in want[5]) == 2 and len(want[5]) == len(want[7]) == 15
    assert recall(got, want) > 0.97
    assert hnsw.search(hnsw.index(table.limit(0)), table.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-3, 3e-4, 1e-5])
def test_recall_in_a_group_of_near_copies(spark, noise):
    """A third of the rows differ by less than single precision can rank."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + noise * rng.normal(size=(1000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = hnsw.vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = hnsw.search(hnsw.index(table), table.filter("vec_id % 20 = 0 and vec_id < 1000")).collect()
    want = {q: some for q, some in brute(rows, 20).items() if q < 1000}
    assert recall(got, want) > 0.95


def test_ties_do_not_end_at_the_beam():
    """Of many multiples of one vector the smallest ids are the nearest."""
    n = 1000
    x = np.random.default_rng(9).normal(size=(n, 16))
    x[: n // 2] = x[0] * 2.0 ** np.random.default_rng(2).permutation(n // 2)[:, None]
    ids = np.random.default_rng(4).permutation(n)
    graph = hnsw.Graph.build(hnsw._unit(x), 0)
    row = {
        "dim": 16, "vectors": x.tobytes(), "ids": np.column_stack([np.ones(n, np.int64), ids]).tobytes(),
        "layers": [a.tobytes() for a in graph.layers], "links": [a.tobytes() for a in graph.links],
    }
    got = [i for _, i, _ in hnsw._found(row, np.array([-1]), x[:1], 5)]
    assert got == sorted(ids[: n // 2].tolist())[:5]


def test_a_search_scores_a_small_part_of_a_shard():
    """Also where a third of the vectors are near copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12000, 24))
    x[:4000] = x[0] + 1e-4 * rng.normal(size=(4000, 24))
    unit = hnsw._unit(x)
    graph = hnsw.Graph.build(unit, 1)
    graph.scored = 0  # The insertions searched too.
    found = graph.search(unit[::40])
    assert graph.scored / 300 < len(unit) / 5
    exact = np.argsort(-(unit[::40] @ unit.T), 1)[:, :6]
    assert np.mean([len({*a[:6]} & {*b}) / 6 for a, b in zip(found, exact, strict=True)]) > 0.95


def test_every_vector_can_be_reached():
    rng = np.random.default_rng(8)
    for spread in (1.0, 1e-6):
        x = rng.normal(size=(6, 12))[rng.integers(0, 6, 2500)] + spread * rng.normal(size=(2500, 12))
        graph = hnsw.Graph.build(hnsw._unit(x), 2)
        seen, edge = {graph.entry}, [graph.entry]
        while edge:
            edge = [j for j in set(graph.links[0][edge].ravel().tolist()) - {-1} if j not in seen]
            seen.update(edge)
        assert len(seen) == len(x)


def test_query_recall(spark, small):
    got = hnsw.op9_hnsw(spark, small).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute(rows, hnsw.QUERY_STEP)
    assert len(got) == sum(map(len, want.values())) and recall(got, want) >= 0.9
