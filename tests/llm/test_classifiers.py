"""The toxicity network and the quality model: held-out accuracy, edges, and what is not read."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm import quality_gam, toxicity
from rollcall.llm.learning import labelled
from tables import documents  # noqa: F401

NEUTRAL = [f"word{i}" for i in range(300)]
TOXIC = ["vilefool", "vilemess", "rotbrain"]


def split(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_corpus(n=900, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(NEUTRAL) for _ in range(rng.randrange(3, 80))]
        bad = rng.random() < 0.2
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad, int(bad)))
    return rows, labels


def tables(spark, documents, rows, labels, tmp_path):
    documents(rows, ["'x' as score", "1 as label", "2 as _id", "3 as _label", "4 as _text"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def auc(scores, truth):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    positive = truth == 1
    return (rank[positive].mean() - (positive.sum() - 1) / 2) / max(1, (~positive).sum())


def test_toxicity_on_held_out_rows(spark, documents, tmp_path):
    rows, labels = toxic_corpus()
    # Labels of held-out rows are turned around: learning from them would show.
    told = [(i, q, 1 - t if split(i) else t) for i, q, t in labels]
    rows += [(None, "vilefool"), (5000, None), (5001, ""), (5002, "...")]
    d = tables(spark, documents, rows, [*told, (None, 0, 1), (7, None, None)], tmp_path)
    got = toxicity.op5_toxicity(spark, d).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and split(r.doc_id)) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    scores, y = np.array(held).T
    assert auc(scores, y) > 0.97
    assert ((scores >= 0.5) == y).mean() > 0.95
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[None] >= 0.5 and by_id[5000] == by_id[5001] == by_id[5002] < 0.5
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


@pytest.mark.parametrize("module", [toxicity, quality_gam])
def test_nothing_to_learn_or_to_score(spark, documents, tmp_path, module):
    run = toxicity.op5_toxicity if module is toxicity else quality_gam.op6_quality_gam
    d = tables(spark, documents, [(1, "a b"), (2, None)], [], tmp_path)
    assert all(0 <= r.score <= 1 for r in run(spark, d).collect())
    (tmp_path / "none").mkdir()
    d = tables(spark, documents, [], [(1, 1, 1), (2, 0, 0)], tmp_path / "none")
    assert run(spark, d).count() == 0


def test_language_and_source_are_not_read(spark, documents):
    rows, labels = toxic_corpus(300)
    df = documents(rows)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    net = toxicity.trained(df, known)
    other = toxicity.trained(df.selectExpr("doc_id", "text", "reverse(lang) lang", "'q' source"), known)
    texts = [toxicity.hashed(t) for _, t in rows]
    assert np.array_equal(net.raw(texts), other.raw(texts))
    assert np.array_equal(net.thresholds, other.thresholds)


def test_long_texts_are_scored_whole(monkeypatch):
    net = toxicity.Network()
    net.bias = np.float32(-6)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 30, 5000).astype(np.int32)
    whole = net.raw([ids])
    monkeypatch.setattr(toxicity, "PART", 64)
    assert np.allclose(net.raw([ids]), whole, atol=1e-6)
    rows, answers, _ = net._answers(toxicity._rows(toxicity._padded([ids])[0]), np.array([0]))
    odds = float(answers[0] @ net.weights + net.bias)
    assert whole[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_thresholds_follow_the_language():
    net = toxicity.Network()
    raw = np.array([0.2, 0.3, 0.6, 0.7] * 30)
    truth = np.array([0, 1, 1, 1] * 30)
    spoken = np.zeros(120, int)
    net.calibrate(raw, truth, spoken)
    assert 0.2 < net.thresholds[0] < 0.3
    assert net.scaled(np.array([net.thresholds[0]]), np.array([0]))[0] == 0.5
    assert toxicity.LANGUAGES[toxicity.language(toxicity.hashed("der die und das ist"))] == "de"
    assert toxicity.LANGUAGES[toxicity.language(toxicity.hashed("zzz"))] == "other"


def test_features():
    for text in (None, "", " \n", "a", "A|B 1!! é " * 3, "x" * 100_000, "w " * 20_000):
        values = quality_gam.features(text)
        assert len(values) == len(quality_gam.FEATURES) and np.isfinite(values).all()
    by_name = dict(zip(quality_gam.FEATURES, quality_gam.features("Ab ab\nAb ab\nc | 12"), strict=True))
    assert by_name["equal_lines"] == pytest.approx(1 / 3)
    assert by_name["bars"] == pytest.approx(1 / 7) and by_name["digit_share"] == pytest.approx(2 / 12)


def test_model_learns_a_pair():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.Gam().fit(x[:3000], y[:3000])
    assert {(0, 1)} <= {(i, j) for i, j, _ in model.pairs}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    # Scores are sums of table rows.
    one, odds = x[3000], model.base
    for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
        odds += t[sum(one[k] >= c for c in e)]
    for i, j, grid in model.pairs:
        odds += grid[sum(one[i] >= c for c in model.pair_edges[i]), sum(one[j] >= c for c in model.pair_edges[j])]
    assert model.score(x[3000:3001])[0] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_quality_on_held_out_rows(spark, documents, tmp_path):
    rng, rows, labels = random.Random(4), [], []
    for i in range(500):
        words = [rng.choice(NEUTRAL) for _ in range(rng.randrange(20, 90))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good) if not split(i) else int(not good), 0))
    d = tables(spark, documents, [*rows, (None, None)], labels, tmp_path)
    got = quality_gam.op6_quality_gam(spark, d).collect()
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: int("!!" not in t) for i, t in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.98


def test_queries_against_held_out_labels(spark, small):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = quality_gam.op6_quality_gam(spark, small).collect()
    held = [(r.predicted, labels[r.doc_id].quality) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.8
    assert toxicity.op5_toxicity(spark, small).count() == len(got)


def plain_toxicity(net, text):
    """Word by word: two embedding rows, every filter at every place, the largest answers, the threshold."""
    ids = toxicity.hashed(text).tolist()
    rows = [net.words[i & (toxicity.BUCKETS - 1)] + net.words[(i >> toxicity.BITS) + toxicity.BUCKETS] for i in ids]
    odds, column = float(net.bias), 0
    for w in toxicity.WIDTHS:
        # A text shorter than the filter is followed by zeros.
        padded = [*rows, *[np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)]
        for f in range(toxicity.FILTERS):
            answers = [sum(float(padded[at + k] @ net.filters[w][k][:, f]) for k in range(w)) for at in range(len(rows))]
            if answers:
                odds += max(0.0, max(answers) + float(net.shifts[w][f])) * float(net.weights[column])
            column += 1
    raw = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    words = [w for w in (text or "").lower().split()]
    counts = [sum(w in some.split() for w in words) for some in toxicity.FUNCTION_WORDS.values()]
    spoken = counts.index(max(counts)) if any(counts) else len(toxicity.LANGUAGES) - 1
    t = net.thresholds[spoken]
    return 0.5 * raw / t if raw < t else 0.5 + 0.5 * (raw - t) / (1 - t)


def test_toxicity_against_a_plain_forward_pass(spark, documents):
    rows, labels = toxic_corpus(200)
    rows += [(None, "vilefool and the"), (5000, None), (5001, ""), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(6000, "the vilefool of"), (6001, "der die das vilemess"), (6002, "le les des rotbrain est une")]
    df = documents(rows)
    net = toxicity.trained(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    net.thresholds[:] = [0.3, 0.4, 0.5, 0.6, 0.7]
    got = df.select("doc_id", "text", toxicity.score(df, net, df["text"]).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == pytest.approx(plain_toxicity(net, r.text), abs=1e-5)


def test_quality_against_a_plain_pass(spark, documents):
    rng, rows, labels = random.Random(4), [], []
    for i in range(300):
        words = [rng.choice(NEUTRAL) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words if i % 3 else [w.upper() + "!!" for w in words])))
        labels.append((i, int(i % 3 > 0), 0))
    rows += [(None, "no id"), (400, None), (401, ""), (9, rows[9][1]), (9, rows[9][1])]
    df = documents(rows)
    model = quality_gam.trained(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = df.select("text", quality_gam.score(df, model, df["text"]).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        x, odds = quality_gam.features(r.text), model.base
        for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
            odds += t[sum(x[k] >= c for c in e)]
        for i, j, grid in model.pairs:
            odds += grid[sum(x[i] >= c for c in model.pair_edges[i]), sum(x[j] >= c for c in model.pair_edges[j])]
        assert r.s == pytest.approx(1 / (1 + np.exp(-odds)))


def test_only_picked_documents_are_measured(spark, documents):
    """The function of a text stands above the join with the picked ids, so no other row reaches it."""
    rows, labels = toxic_corpus(50)
    known = spark.createDataFrame([*labels, (3, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    df = documents([*rows, (3, rows[3][1]), (None, "x")])

    @F.arrow_udf(T.IntegerType())
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([len(x.as_py() or "") for x in texts], pa.int32())

    sample = labelled(df, known, "toxic", "text", 20, measure=size)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join Inner")
    assert sample.count() == 20
    whole = labelled(df, known, "toxic", "text", 1000, measure=size).collect()
    # Document 3 has two labels, the larger counts, and two rows.
    assert len(whole) == sum(not split(i) for i, _ in rows) + 1


def test_repeated_rows_and_labels_teach(spark, documents):
    rows, labels = toxic_corpus(120)
    known = spark.createDataFrame(labels * 2, "doc_id bigint, quality int, toxic int")
    once = toxicity.trained(documents(rows), known)
    assert np.array_equal(once.thresholds, toxicity.trained(documents(rows), known.distinct()).thresholds)
    assert np.isfinite(toxicity.trained(documents(rows * 2), known).words).all()
    x = np.array([quality_gam.features(t) for _, t in rows[:20]])
    twice = quality_gam.trained(documents(rows * 2), known).score(x)
    assert ((0 <= twice) & (twice <= 1)).all()
