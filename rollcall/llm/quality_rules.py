"""Quality rules per document, and verdicts on their hosts (DataFrame functions only).

Four rules are checked on every document. Failures are then counted per host, each host's rates
are shrunk towards the mean of all hosts by a beta prior fitted to the hosts themselves, and the
host's verdict decides about its documents:

* a document that fails a base rule (too few words, too much repetition) always goes;
* all documents of a host go if its shrunk rate of failing documents passes ``HOST_LIMIT``;
* a document that fails a soft rule (symbols, equal lines) goes unless its host is trusted in that
  rule, that is, its shrunk rate is below ``TRUST``.

Small hosts have little evidence and stay near the mean; large hosts speak for themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import SPACE, WORD, salted_lookup, table, words_of, written
from rollcall.llm.registry import query

WINDOW = 8
MIN_WORDS = 20
#: Percent of words inside repeated windows, percent of symbols, percent of equal lines.
MAX_REPEATED, MAX_SYMBOLS, MAX_EQUAL_LINES = 30, 10, 30
#: Fewer equal lines than this are no sign of junk: one repeated line of three is 33 percent.
LEAST_EQUAL_LINES = 3
SYMBOLS = "#*$%&|<>"
HOST_LIMIT, TRUST = 0.6, 0.01
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
SOFT_RULES = ("symbols", "equal_lines")
RULES = ("short", "repeated", *SOFT_RULES)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_metrics(df: DataFrame, text: str) -> DataFrame:
    """Add the metrics, as longs, and n_lines. Null and blank texts have zero of everything."""
    plain = F.coalesce(F.col(text), F.lit(""))

    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(WORD))
    count = F.size("_words")
    df = (
        df.withColumn("_words", words_of(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("_runs1", F.transform("_words", lambda x: F.xxhash64(x)))
    )
    # Runs of 2, 4 and 8 words, each hashed from two runs of half the length. Every step is a
    # column of its own that the next one reads twice, so that no array is made anew per element.
    for half in (1, 2, 4):
        size = F.size(f"_runs{half}") - half
        df = df.withColumn(
            f"_runs{2 * half}",
            F.when(
                size > 0,
                F.zip_with(
                    F.slice(f"_runs{half}", F.lit(1), size),
                    F.slice(f"_runs{half}", F.lit(half + 1), size),
                    lambda a, b: F.xxhash64(a, b),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    df = df.withColumnRenamed(f"_runs{WINDOW}", "_windows")
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Only texts that repeat a window need its places.
    places = F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), places))
    found = F.filter(
        "_sorted",
        lambda x, k: x.h.eqNullSafe(F.get("_sorted", k - 1).h)
        | x.h.eqNullSafe(F.get("_sorted", k + 1).h),
    )
    df = df.withColumn("_starts", F.sort_array(F.transform(found, lambda x: x.i)))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda seen, i: F.struct(
            (seen.total + i + WINDOW - F.greatest(i, seen.end)).alias("total"),
            (i + WINDOW).alias("end"),
        ),
        lambda seen: seen.total,
    )
    return df.select(
        *(c for c in df.columns if not c.startswith("_") or c == "_row"),
        count.cast("long").alias("n_words"),
        (F.char_length(plain) - F.regexp_count(plain, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(plain, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_of(source: Column) -> Column:
    """Lower-case host of an address, or the name itself; null stays a host of its own."""
    return F.regexp_extract(F.lower(source), r"^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)", 1)


def rule_failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "equal_lines": (F.col("n_dup_lines") >= LEAST_EQUAL_LINES)
        & (100 * F.col("n_dup_lines") > MAX_EQUAL_LINES * F.col("n_lines")),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Per host: documents, shrunk rate of failing documents and of each soft rule.

    The prior of a rate has the mean of all documents and, by the method of moments, the weight
    mean (1 - mean) / variance - 1 over the hosts' rates, within bounds. Equal hosts (or one host)
    give the largest weight. The driver sees the few moments only.
    """
    names = ("any", *SOFT_RULES)
    failed = rule_failures()
    failed["any"] = reduce(Column.__or__, (failed[x] for x in RULES))
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("host_docs"), *(F.sum(failed[x].cast("long")).alias(x) for x in names)
    )
    hosts = written(hosts, "hosts")
    moments = hosts.agg(
        *(F.sum(x).alias(f"{x}_sum") for x in names),
        *(F.var_pop(F.col(x) / F.col("host_docs")).alias(f"{x}_var") for x in names),
        F.sum("host_docs").alias("docs"),
    ).first()

    def shrunk(name: str) -> Column:
        mean = (moments[f"{name}_sum"] or 0) / max(1, moments["docs"] or 0)
        spread = moments[f"{name}_var"] or 0.0
        weight = mean * (1 - mean) / spread - 1 if spread > 1e-12 else MOST_WEIGHT
        weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
        return (F.col(name) + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))

    return hosts.select(
        "host", "host_docs", *(F.round(shrunk(x), 6).alias(f"{x}_rate") for x in names)
    )


def judged(
    docs: DataFrame, text: str = "text", source: str = "source", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per document: ``_row`` (struct of ``carry``), metrics, host, rates, verdict.

    Metrics are computed once and written with the carried columns, since the hosts need them all
    before any document can be judged. Null sources form one host. Columns of ``docs`` that are
    not carried do no harm whatever their names.
    """
    rows = docs.select(
        F.struct(*(F.col(c) for c in carry)).alias("_row"),
        F.col(text).alias("_text"),
        host_of(F.col(source)).alias("host"),
        # Rows of one host are told apart by where they were read.
        F.monotonically_increasing_id().alias("spread"),
    )
    measured = written(with_metrics(rows, "_text"), "measured")
    failed = rule_failures()
    hosts = host_verdicts(measured)
    both = salted_lookup(measured, hosts, "host", ["spread"]).drop("spread")
    distrusted = reduce(
        Column.__or__, (failed[x] & (F.col(f"{x}_rate") >= TRUST) for x in SOFT_RULES)
    )
    base = failed["short"] | failed["repeated"]
    return both.withColumn("base_failed", base).withColumn(
        "kept", ~base & (F.col("any_rate") <= HOST_LIMIT) & ~distrusted
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    rows = judged(docs, carry=tuple(docs.columns)).filter("kept")
    return rows.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
    regexp_extract(lower(source), '^(?:[a-z]+://)?(?:www\\.)?([^/:?#]+)', 1) as host
  from documents),
w as (
  select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from d),
win as (
  select rid, i, array_to_string(ws[i:i + 7], ' ') as s
  from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
rep as (select rid, i from win qualify count(*) over (partition by rid, s) > 1),
cov as (
  select rid, sum(8 - greatest(0, coalesce(before + 8 - i, 0))) as n
  from (select rid, i, lag(i) over (partition by rid order by i) as before from rep) group by rid),
m as (
  select rid, doc_id, host, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
    coalesce(cov.n, 0) as n_repeat_words
  from w left join cov using (rid)),
f as (
  select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) as base_failed,
    100 * n_symbols > {MAX_SYMBOLS} * word_chars as symbols,
    n_dup_lines >= {LEAST_EQUAL_LINES}
      and 100 * n_dup_lines > {MAX_EQUAL_LINES} * n_lines as equal_lines
  from m),
h as (
  select host, count(*) as n, sum((base_failed or symbols or equal_lines)::int) as a,
    sum(symbols::int) as b, sum(equal_lines::int) as c
  from f group by host),
t as (
  select sum(a) / sum(n) as ma, sum(b) / sum(n) as mb, sum(c) / sum(n) as mc,
    var_pop(a / n) as va, var_pop(b / n) as vb, var_pop(c / n) as vc from h),
p as (
  select ma, mb, mc,
    case when va > 1e-12 then least(greatest(ma * (1 - ma) / va - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) else {MOST_WEIGHT} end as ka,
    case when vb > 1e-12 then least(greatest(mb * (1 - mb) / vb - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) else {MOST_WEIGHT} end as kb,
    case when vc > 1e-12 then least(greatest(mc * (1 - mc) / vc - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) else {MOST_WEIGHT} end as kc
  from t),
r as (
  select host, n as host_docs, round((a + ma * ka) / (n + ka), 6) as any_rate,
    round((b + mb * kb) / (n + kb), 6) as symbols_rate,
    round((c + mc * kc) / (n + kc), 6) as equal_lines_rate
  from h, p)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
  n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and any_rate <= {HOST_LIMIT} and not (symbols and symbols_rate >= {TRUST})
    and not (equal_lines and equal_lines_rate >= {TRUST}) as kept,
  r.host, host_docs, any_rate
from f join r on f.host is not distinct from r.host
"""


@query("op7_host_rules", SQL)
def op7_host_rules(spark, sf_dir):
    verdicts = judged(table(spark, sf_dir, "documents"))
    return verdicts.select(
        "_row.doc_id", *METRICS, "base_failed", "kept", "host", "host_docs", "any_rate"
    )
