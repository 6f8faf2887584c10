from __future__ import annotations

import random
import re
from collections import Counter

from oracle import same

from rollcall.llm import quality_rules as rules
from tables import documents  # noqa: F401

CASES = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 50,
    "l1 l1\nl2\nl1 l1\n\nl2\n \n", "# * $ % & | < > word", "café \U0001f600 naïve x",
    " ".join(f"w{i % 13}" for i in range(60)), " ".join(f"w{i}" for i in range(100)),
    "\n".join(["same line of words here"] * 9), " ".join(f"v{i}" for i in range(20000)),
]


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_metrics_against_plain_counts(spark, documents):
    rng = random.Random(5)
    texts = CASES + [
        " ".join(rng.choice("abc") for _ in range(rng.randrange(80))).replace("a b", "a\nb") for _ in range(60)
    ]
    df = documents(list(enumerate(texts)), ["1 as n_words", "2 as host", "'t' as kept"])
    got = {r["doc_id"]: tuple(r)[1:] for r in rules.judged(df).select("_row.doc_id", *rules.METRICS).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_hosts_and_edges(spark, documents):
    clean = " ".join(f"w{i}" for i in range(50))
    noisy = " ".join(f"w{i}###" for i in range(50))
    rows = [(i, clean, "https://www.Good.org/a") for i in range(300)]
    rows += [(1000 + i, noisy, "good.org") for i in range(2)] + [(2000 + i, noisy, "bad.net") for i in range(200)]
    rows += [(3000, clean, "bad.net"), (4000, clean, None), (None, None, None), (4000, clean, None)]
    df = documents(rows)
    got = {r["id"]: r for r in rules.judged(df).selectExpr("_row.doc_id id", "*").collect()}
    assert all(got[i]["kept"] and got[i]["host"] == "good.org" for i in range(300))
    # A trusted host's rare failures stay; a bad host loses its clean document too.
    assert got[1000]["kept"] and not got[2000]["kept"] and not got[3000]["kept"]
    assert got[4000]["kept"] and got[4000]["host"] is None and got[None]["base_failed"]
    same(
        rules.judged(df).select("_row.doc_id", *rules.METRICS, "base_failed", "kept", "host", "host_docs", "any_rate"),
        rules.SQL, {"documents": df.toArrow()},
    )
    assert rules.judged(df.limit(0)).count() == 0


def test_query_against_sql(spark, small):
    same(rules.op7_host_rules(spark, small), rules.SQL, {"documents": f"{small}/documents.parquet"})
