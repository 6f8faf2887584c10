"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Every source gets a target of words. Its documents are put in a shuffled, fixed order and laid end
to end, around and around, until the target is reached; that stream is cut into blocks of equal
word counts. The schedule is a golden-ratio sequence: point i, the fractional part of i times the
golden ratio, falls into the cumulative weights of the sources, and the n-th point that falls to a
source takes the n-th block of its stream. Any run of slots is thus close to the weights, and the
whole mix takes exactly the (rounded) target from each source.

Nothing is collected but totals. No window covers a whole source: documents are ordered within
hash buckets and slots are ranked within runs, with the buckets' and runs' totals added before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.common import WORD, table, words_of, written
from rollcall.llm.registry import query

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK = 1024
SEED = 10
#: Hex digits of the shuffling hash that name a bucket; slots in a run; cells of the weight line.
BUCKET_DIGITS, RUN, CELLS = 3, 1 << 16, 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """The documents with a row number, sizes and shuffling order, written once.

    ``carry`` keeps all columns of ``docs`` in a struct ``_row``. The order depends on id, size
    and text alone, so a rerun mixes alike.
    """
    size = n_words(F.col(text))
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), size.cast("string"), F.lit(str(SEED))]
    return written(
        docs.select(
            *([F.struct("*").alias("_row")] if carry else []),
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            # Never null, so that joins and groups need no null-safe keys.
            F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("key"),
            size.alias("size"),
            F.md5(F.concat_ws(":", *parts).cast("binary")).alias("shuffled"),
            F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
        ).withColumn("bucket", F.substring("shuffled", 1, BUCKET_DIGITS)),
        "sized",
    )


def source_targets(docs: DataFrame) -> DataFrame:
    """(key, source, source_size, target, words, slots, first_slot) per source.

    Weights go by code-point order of the sources, null last. A target above ``MOST_EPOCHS`` times
    its source's size stops there and the excess is shared again by weight, until none is above.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    # Sorted output is numbered by its partitions, so no task sees all sources.
    sums = written(
        sums.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    ranked = _numbered(sums, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "weights")
    most = MOST_EPOCHS * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, stopped = F.lit(0.0), -1
    while True:
        above = most <= F.col("weight") * share if stopped >= 0 else F.lit(False)
        n, taken, weights = ranked.agg(
            F.sum(above.cast("int")),
            F.sum(F.when(above, most)),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if (n or 0) == stopped or not weights:
            break
        stopped = n or 0
        share = F.lit(total - (taken or 0)) / F.lit(weights)
    target = F.least(most.cast("double"), F.col("weight") * share)
    words = F.floor(target + 0.5).cast("long")
    slots = F.ceil(words / BLOCK).cast("long")
    planned = ranked.select(
        "part", "rank", "key", "source", "source_size", target.alias("target"), words.alias("words"), slots.alias("slots")
    )
    return written(_summed(planned, "slots", "rank", "first_slot"), "targets")


def _numbered(df: DataFrame, order: Column) -> DataFrame:
    """A gapless ``rank`` from 0 over rows whose ``part`` goes with the order."""
    within = Window.partitionBy("part").orderBy(order)
    one = df.withColumn("one", F.lit(1))
    return _summed(one.withColumn("place", F.row_number().over(within)), "one", "place", "rank").drop(
        "one", "place"
    )


def _summed(df: DataFrame, value: str, order: str, name: str, by: str | None = None) -> DataFrame:
    """``name``: the sum of ``value`` before a row, in the order of ``part``, then ``order``.

    With ``by``, each of its values has a sum of its own.
    """
    keys = [by] if by else []
    inner = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "part").agg(F.sum(value).alias("_total"))
    totals = totals.select(*keys, "part", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(totals, [*keys, "part"]).withColumn(
        name, F.col("_before") + F.col("_within")
    ).drop("_before", "_within")


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """(slot, key, block): which block of which source comes at which place of the mix.

    An interval of the unit line is met again within 2.62 times the inverse of its length, so
    2.7 times as many points as slots (and a few) give each source its slots; points beyond a
    source's last block are passed over.
    """
    slots = targets.agg(F.sum("slots")).first()[0] or 0
    i = F.col("id")
    # Two short products instead of a long one: no digits of the fraction are lost.
    coarse = F.floor(i / 2**24) * F.lit((GOLDEN * 2**24) % 1.0)
    point = coarse - F.floor(coarse) + (i % 2**24) * F.lit(GOLDEN)
    place = F.least(F.floor((point - F.floor(point)) * slots), F.lit(max(0, slots - 1)))
    width = max(1, slots // CELLS)
    points = spark.range(int(2.7 * slots) + 64 if slots else 0).select(
        i.alias("slot"), place.cast("long").alias("place"), F.floor(place / width).cast("long").alias("cell")
    )
    last = F.col("first_slot") + F.col("slots") - 1
    cells = targets.filter("slots > 0").select(
        "key", "slots", "first_slot",
        F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor(last / width))).alias("cell"),
    )
    met = points.join(cells, "cell").filter(
        (F.col("place") >= F.col("first_slot")) & (F.col("place") < F.col("first_slot") + F.col("slots"))
    )
    met = met.select("slot", "key", "slots", F.floor(F.col("slot") / RUN).alias("part"), F.lit(1).alias("one"))
    ranked = _summed(met, "one", "slot", "block", by="key")
    return ranked.filter("block < slots").select("slot", "key", "block")


def taken_blocks(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's parts in its source's stream: (row, ..., block, overlap).

    A document has one part per block that it touches, in every round that the stream reaches it;
    one that is never reached has a single row with a null block.
    """
    placed = _summed(
        docs.select("row", "doc_id", "key", "size", "shuffled", "tie", F.col("bucket").alias("part")),
        "size", F.struct("shuffled", "doc_id", "size", "tie"), "start", by="key",
    )
    few = targets.select("key", "source_size", "target", "words")
    spread = F.pmod(F.xxhash64("row"), F.lit(16))
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    placed = placed.withColumn("salt", spread).join(salted, ["key", "salt"])
    rounds = F.floor((F.col("words") - 1 - F.col("start")) / F.greatest("source_size", F.lit(1)))
    reached = (F.col("size") > 0) & (F.col("words") > F.col("start"))
    placed = placed.select(
        "row", "doc_id", "key", "size", "source_size", "target", "words", "start",
        F.explode_outer(F.when(reached, F.sequence(F.lit(0).cast("long"), rounds))).alias("round"),
    )
    begin = F.col("start") + F.col("round") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.col("words"))
    spans = placed.withColumn("begin", begin).withColumn("end", end)
    spans = spans.withColumn(
        "block",
        F.explode_outer(
            F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
        ),
    )
    edge = F.col("block") * BLOCK
    overlap = F.least("end", edge + BLOCK) - F.greatest("begin", edge)
    return spans.select("row", "doc_id", "key", "size", "source_size", "target", "block", overlap.alias("overlap"))


def mixed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) for every row of ``sized`` documents.

    Null texts and blank ones have size 0 and nothing taken. Null sources are one source, the
    last. An empty table gives no rows.
    """
    targets = source_targets(docs)
    plan = schedule(docs.sparkSession, targets)
    parts = taken_blocks(docs, targets)
    joined = parts.join(plan, ["key", "block"], "left")
    words = F.when(F.col("slot").isNotNull(), F.col("overlap"))
    return joined.groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents as the mix takes them: one row per round, with the columns of ``docs``.

    Where the stream of a source ends inside a document, the last row has its first words only,
    with single spaces; documents that the mix does not take are left out.
    """
    rows = sized(docs, text=text, carry=True)
    taken = mixed(rows).filter("taken > 0").select("row", "size", "taken")
    both = rows.select("row", "_row").join(taken, "row")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    here = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    whole = F.col("_row")[text]
    cut = F.when(here == F.col("size"), whole).otherwise(
        F.array_join(F.slice(words_of(whole), 1, here.cast("int")), " ")
    )
    return both.select(*((cut if c == text else F.col("_row")[c]).alias(c) for c in docs.columns))


SQL = f"""
with d as (
  select row_number() over () as rid, doc_id, source, t,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint as size
  from (select doc_id, source, coalesce(text, '') as t from documents)),
s as (
  select source, sum(size)::bigint as source_size,
    ([5, 2, 1])[((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight
  from d group by source),
o as (
  select *, {MOST_EPOCHS} * source_size as most,
    sum({MOST_EPOCHS} * source_size) over w as capped, sum(weight) over w as used,
    sum(source_size) over () as total, sum(weight) over () as weights,
    row_number() over w as k
  from s window w as (order by {MOST_EPOCHS} * source_size / weight, source nulls last rows unbounded preceding)),
levels as (
  select k, most / weight as ratio, (total - capped) / (weights - used) as share,
    lead(most / weight) over (order by k) as above
  from o where used < weights
  union all
  select 0, null, max(total) / max(weights), min(most / weight) from o),
pick as (select share from levels where above is null or above > share order by k limit 1),
g as (
  select source, source_size, least(most::double, weight * share) as target,
    floor(least(most::double, weight * share) + 0.5)::bigint as words
  from o, pick),
p as (
  select rid, d.doc_id, size, source_size, target, words,
    (sum(size) over (partition by d.source order by
      md5(coalesce(doc_id::varchar, '') || ':' || size || ':{SEED}'), doc_id, size, rid
      rows unbounded preceding) - size)::bigint as begin
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else (words // source_size) * size
    + greatest(0, least(size, words % source_size - begin)) end::bigint as taken
from p
"""


@query("op10_schedule", SQL)
def op10_schedule(spark, sf_dir):
    return mixed(sized(table(spark, sf_dir, "documents"))).drop("row")
