from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import language_model as lm
from tables import documents  # noqa: F401


def plain_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), ""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_base(rows):
    """Counts and scores of every text, word by word."""
    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update(plain_tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        some = plain_tokens(text)
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in some)
        out.append((i, held(i), len(some), sum(counts[w] > 0 for w in some), total, round(score, 6)))
    return out, counts


def made(texts, seed=1):
    counts = Counter(w for t in texts for w in lm.tokens(t))
    words = lm.Vocabulary(dict(counts), sum(counts.values()), len(counts), {})
    forms: dict = {}
    for w, n in counts.items():
        if w not in words.head:
            a, b = forms.get(lm.form(w), (0, 0))
            forms[lm.form(w)] = (a + n, b + 1)
    words.set_forms(forms)
    net = lm.Network(seed)
    net.start_from(words)
    return words, net, counts


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    kinds = [[f"{x}{k}{e}" for k in range(40) for e in ("", ".", "é", "!!")] for x in ("ab", "cd")]
    return [" ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randrange(60))) for i in range(n)]


def plain_score(net, words, text):
    """One word after the other, without batches."""
    p, h, out = net.p, np.zeros(lm.HIDDEN), 0.0

    def log_softmax(x):
        x = x.astype(float)
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    ids, _ = words.encode(lm.tokens(text))
    inputs, classes = words.coded(ids)
    for row, c, i in zip(inputs, classes, ids, strict=True):
        out += log_softmax(h @ p["classes"] + p["class_bias"])[c]
        if c < lm.HEAD_CLASSES:
            out += log_softmax(h @ p["words"][c] + p["word_bias"][c])[words.inner[i]]
        x = p["inputs"][row]
        gates = 1 / (1 + np.exp(-(h @ p["gates"] + x[: 2 * lm.HIDDEN])))
        r, z = gates[: lm.HIDDEN], gates[lm.HIDDEN :]
        n = np.tanh(r * (h @ p["fresh"] + p["shift"]) + x[2 * lm.HIDDEN :])
        h = (1 - z) * n + z * h
    return out


def test_tokens():
    for text in (None, "", "A\tÉ b\x0bC", "x y Z"):
        assert [w.decode() for w in lm.tokens(text)] == plain_tokens(text)
    assert all(0 <= lm.form(w) < lm.FORMS for t in corpus() for w in lm.tokens(t) + [b"\xc3", b"9", b"a"])


def test_scores_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)
    texts = [*corpus(), None, "", "never seen words"]
    words, net, _ = made(texts[:40])
    coded = [words.encode(lm.tokens(t))[0] for t in texts]
    want = [plain_score(net, words, t) for t in texts]
    for width in (1, 7, 100):
        assert lm.log_likelihoods(net, words, coded, width) == pytest.approx(want, rel=1e-4)


def test_probabilities_add_up_to_one():
    texts = corpus()
    words, net, counts = made(texts)
    # After any beginning: all known words and one unseen word of each form.
    start = lm.tokens("ab1 cd2.")[:-1]
    known = [words.encode([*start, w])[0] for w in counts]
    inner = [words.inner_score[words.place[w]] for w in counts]
    logs = lm.log_likelihoods(net, words, known) - lm.log_likelihoods(net, words, [words.encode(start)[0]])
    total = np.sum(np.exp(logs) * 10.0 ** np.array(inner))
    for k in range(lm.FORMS):
        ids = np.append(words.encode(start)[0], -1 - k).astype(np.int32)
        logs = lm.log_likelihoods(net, words, [ids]) - lm.log_likelihoods(net, words, [ids[:-1]])
        total += np.exp(logs[0]) * 10.0 ** words.within[k]
    assert total == pytest.approx(1, abs=1e-3)


def test_slopes_against_differences(monkeypatch):
    """Plain steps: the change of every weight is its slope."""
    monkeypatch.setattr(lm, "RATE", 1.0)
    words, net, _ = made(corpus(20))
    rng = np.random.default_rng(5)
    for k in net.p:
        net.p[k] = rng.normal(0, 0.3, net.p[k].shape).astype(np.float64)
    texts = [words.encode(lm.tokens(t))[0][:9] for t in corpus(6, 8)]
    ((_, group),) = lm.Group.all(words, texts, 10)
    (places,) = list(group.windows())
    slopes = {}
    monkeypatch.setattr(net, "_move", lambda name, slope, rows=None: slopes.__setitem__(name, (slope, rows)))
    net.learn(np.zeros((len(places[0]), lm.HIDDEN)), group, places, words)
    scale = 8 / sum(map(len, places))

    def loss():
        return -lm.log_likelihoods(net, words, texts).sum() * scale

    for name, (slope, rows) in slopes.items():
        full = np.zeros(net.p[name].shape)
        full[rows if rows is not None else ...] = slope
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in full.shape)
            if rows is not None:
                at = (int(rng.choice(rows)), *at[1:])
            kept = net.p[name][at]
            net.p[name][at] = kept + 1e-3
            up = loss()
            net.p[name][at] = kept - 1e-3
            down = loss()
            net.p[name][at] = kept
            assert (up - down) / 2e-3 == pytest.approx(full[at], abs=2e-3), (name, at)


def test_words_of_a_step_lie_side_by_side(monkeypatch):
    """Windows are stretches of a group's words: all texts' first words, then the second ones."""
    monkeypatch.setattr(lm, "HEAD", 64)
    words, _, _ = made(corpus(40))
    texts = [words.encode(lm.tokens(t))[0] for t in [*corpus(50), "", "never seen " * 40]]
    for some, group in lm.Group.all(words, texts, 20):
        steps = [step for places in group.windows() for step in places]
        assert all(isinstance(step, range) for step in steps)
        assert [i for step in steps for i in step] == list(range(sum(len(texts[i]) for i in some)))
        for t, step in enumerate(steps):
            want = words.coded(np.array([texts[i][t] for i in some if len(texts[i]) > t], np.int32))[0]
            assert group.inputs[step.start : step.stop].tolist() == want.tolist()
    # Sorted by input rows, words are sorted by classes too.
    assert (np.diff(words.row_classes) >= 0).all()


def test_forms_are_found_once(monkeypatch):
    """Each different unknown word of a batch, whatever the number of its occurrences."""
    words, _, _ = made(corpus(30))
    seen, form = [], lm.form
    monkeypatch.setattr(lm, "form", lambda word: (seen.append(word), form(word))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(["new ab1 éa new", "new old", None])], ["text"])
    rare = lm.rare_words(lm.coded(batch, words, 0), words).to_pylist()
    assert sorted(seen) == sorted(x.encode() for x in ("new", "éa", "old"))
    want = [{"new": 2, "éa": 1}, {"new": 1, "old": 1}, {}]
    assert [{r["token"]: r["n"] for r in some} for some in rare] == want
    assert all(r["within"] == words.within[form(r["token"].encode())] for some in rare for r in some)


def test_training_helps_on_unseen_texts(spark, small):
    """With the settings of the query: warm start, then one pass over all training texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    words, net, _ = made([r.text for r in rows if not held(r.doc_id)])
    unseen = [words.encode(lm.tokens(r.text))[0] for r in rows if held(r.doc_id)]
    size = sum(map(len, unseen))
    before = lm.log_likelihoods(net, words, unseen).sum() / size
    learn = docs.filter(~lm.held_out("doc_id", lm.FOLDS, lm.HELD))
    assert lm.log_likelihoods(lm.trained(learn, words), words, unseen).sum() / size > before + 0.2


def test_texts_coded_at_once_and_one_by_one(monkeypatch):
    texts = [*corpus(50), None, "", " \n", "never seen NEVER seen \x1c \x85 é", "ab1 " * 40, "ÀB1 ab1", " ab1\tcd2. "]
    words, _, _ = made(corpus(30))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for vocabulary in (words, lm.Vocabulary({}, 0, 0, {})):
        chunk = lm.coded(batch, vocabulary, 0)
        rare: list[dict] = [{} for _ in texts]
        for text, word, n in zip(*(x.tolist() for x in chunk.rare), strict=True):
            rare[text][chunk.words[word].as_py().encode()] = n
        for text, ids, unknown in zip(texts, chunk.texts, rare, strict=True):
            want, others = vocabulary.encode(lm.tokens(text))
            assert ids.tolist() == want.tolist() and unknown == others
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    parts = list(lm._chunks(iter([batch]), words, 0))
    assert len(parts) > 5
    assert [x.tolist() for p in parts for x in p.texts] == [words.encode(lm.tokens(t))[0].tolist() for t in texts]


def test_every_word_gives_a_gradient(spark, documents, monkeypatch):
    """One task's weights are those of a plain pass that learns from every word of every text."""
    monkeypatch.setattr(lm, "WARM_EPOCHS", 0)
    texts = [*corpus(50), "ab1", "", "cd2 " * 100]
    words, net, counts = made(texts)
    net = lm.Network()
    net.start_from(words)
    learn, seen = net.learn, []
    monkeypatch.setattr(net, "learn", lambda h, group, places, v: (seen.extend(map(len, places)), learn(h, group, places, v))[1])
    lm.train(net, words, [words.encode(lm.tokens(t))[0] for t in texts], lm.TRAIN_SIDE_BY_SIDE)
    assert sum(seen) == sum(counts.values())
    got = lm.trained(documents(list(enumerate(texts))).coalesce(1), words)
    assert got.flat() == pytest.approx(net.flat(), abs=1e-4)


def test_groups_are_narrow_enough_to_learn_in_one_pass():
    """Of texts whose every word follows from the one before, one pass by the default learns more than by 1,024."""
    rng = random.Random(6)
    cycle = [f"w{i}" for i in range(12)]
    texts = [" ".join((cycle * 4)[at : at + 30]) for at in (rng.randrange(12) for _ in range(2048))]
    scores = []
    for width in (1024, lm.TRAIN_SIDE_BY_SIDE):
        words, net, _ = made(texts)
        coded = [words.encode(lm.tokens(t))[0] for t in texts]
        lm.train(net, words, coded, width)
        scores.append(lm.log_likelihoods(net, words, coded[:100]).sum())
    assert scores[1] > scores[0] + 100


def compare(rows, got):
    want, _ = plain_base(rows)
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("known", [1 << 18, 40])
def test_documents(spark, documents, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    rows = list(enumerate(corpus(80)))
    rows += [(None, "ab1 no id"), (None, None), (200, ""), (200, " \n"), (201, "only here"), (201, "only here")]
    rows += [(7, "held only word"), (300, "long " * 20000)]
    df = documents(rows, ["'x' as token", "1 as n", "2 as score", "3 as row"]).repartition(3)
    compare(rows, lm.scored(df).collect())
    assert lm.scored(df.limit(0)).count() == 0


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op3_language_model(spark, small).collect()
    compare(rows, got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
