"""Every stage of the pipeline against a plain version on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from test_classifiers import toxic_corpus
from test_packing import check
from test_simhash import plain_components, plain_fingerprint

from rollcall.llm import mixing, quality_rules, toxicity
from tables import documents  # noqa: F401


@pytest.fixture
def tables(spark, documents, tmp_path):
    rows, labels = toxic_corpus(260, 9)
    sources = ["a", "b", None, "c.org"]
    rows = [(i, t, sources[i % 4] if i % 3 else "a") for i, t in rows]
    base = " ".join(f"clean{k}" for k in range(200))
    rows += [(1000 + i, base if i % 2 else base.replace("clean77", "odd"), "a") for i in range(40)]
    rows += [(2000, None, None), (2001, "", "b"), (None, base + " no id", "b"), (2002, "w " * 500, "b")]
    rows += [(2003, " ".join(f"long{k}" for k in range(20000)), "c.org"), (2004, base, "a"), (2004, base, "a")]
    extra = ["'x' as code", "1 as size", "2 as row", "'k' as key", "true as kept", "3 as sequence_id"]
    documents(rows, extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def sql(query, df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    result = con.execute(query)
    names = [d[0] for d in result.description]
    return [dict(zip(names, r, strict=True)) for r in result.fetchall()]


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "simhash", "mixing", "packing"]
    after = {}
    current = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tables}/{name}"
        stage(spark, current, tables).write.parquet(path)
        current = after[name] = spark.read.parquet(path)
        if i < 4:
            assert current.columns == docs.columns
    scores = toxicity.op5_toxicity(spark, tables).collect()
    assert Counter(r.doc_id for r in after["toxicity"].collect()) == Counter(r.doc_id for r in scores if r.score < 0.5)
    assert after["toxicity"].count() < docs.count() - 30
    kept = [r["doc_id"] for r in sql(quality_rules.SQL, after["toxicity"]) if r["kept"]]
    assert Counter(r.doc_id for r in after["quality_rules"].collect()) == Counter(kept)
    before = after["quality_rules"].collect()
    codes = [plain_fingerprint(r.text) for r in before]
    groups = plain_components([r.doc_id if r.doc_id is not None else 10**9 for r in before], codes)
    assert Counter(r.doc_id if r.doc_id is not None else 10**9 for r in after["simhash"].collect()) == Counter(set(groups))
    taken = {r["doc_id"]: r["taken"] for r in sql(mixing.SQL, after["simhash"])}
    words = Counter()
    for r in after["mixing"].collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: n for k, n in taken.items() if n}
    assert max(Counter(r.doc_id for r in after["mixing"].collect()).values()) <= 3
    texts = [(r.doc_id, r.text) for r in after["mixing"].collect()]
    used = check(after["packing"].collect(), texts)
    assert used <= 1.05 * sum(r.length for r in after["packing"].collect()) / 4096 + 1


def test_run(spark, tables, small):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0
    assert corpus_pipeline.run(spark, small).count() > 0


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
