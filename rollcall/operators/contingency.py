"""G-tests of independence on grouped counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.tails import chi2_sf, chi2_sf_one


def _n_log(n: Column, by: Column) -> Column:
    """n * ln(n / by), zero for an empty cell."""
    n, by = n.cast("double"), by.cast("double")
    return F.when(n > 0, n * F.ln(n / by)).otherwise(F.lit(0.0))


def _add(columns: Sequence[Column]) -> Column:
    return reduce(Column.__add__, columns)


def g_test(
    counts: DataFrame,
    cells: Sequence[str],
    *,
    with_p: bool = True,
    group: str | None = None,
    null_group: bool = True,
) -> DataFrame:
    """G, df and p of a table whose rows are groups and whose columns are ``cells``.

    One aggregation and no join: with row totals R, column totals C and N in all,
    G = 2 (sum O ln(O/R) - sum C ln(C/N)). A null group counts like any other, as in
    ``pairwise_g_test``; with ``group`` and ``null_group=False`` it is left out.
    """
    if not null_group:
        if group is None:
            raise ValueError("name the group column to leave its null out")
        counts = counts.where(F.col(group).isNotNull())
    row_total = _add([F.col(c) for c in cells])
    sums = counts.agg(
        F.sum(_add([_n_log(F.col(c), row_total) for c in cells])).alias("_rows"),
        F.count(F.lit(1)).alias("_k"),
        *(F.sum(c).alias(f"_c{i}") for i, c in enumerate(cells)),
    )
    columns = [F.col(f"_c{i}") for i in range(len(cells))]
    n = _add(columns)
    g = 2 * (F.col("_rows") - _add([_n_log(c, n) for c in columns]))
    out = sums.select(
        F.when(n > 0, F.greatest(g, F.lit(0.0))).alias("g"),
        ((F.col("_k") - 1) * (len(cells) - 1)).alias("df"),
        n.alias("n"),
    )
    return out.withColumn("p", chi2_sf(F.col("g"), F.col("df"))) if with_p else out


def g_test_long(
    cells: DataFrame, row: str, col: str, n: str | None = None, *, with_p: bool = True
) -> DataFrame:
    """G, df and p of an r x c table held as (row, col, n) rows, or as raw rows without ``n``.

    Rows are added up per cell before anything else; both margins then come from one grouping
    with grouping sets.
    """
    count = F.count(F.lit(1)) if n is None else F.sum(n)
    grouped = cells.groupBy(row, col).agg(count.alias("_o"))
    o = F.col("_o").cast("double")
    margins = grouped.groupingSets([[row], [col]], row, col).agg(
        F.grouping(F.col(row)).alias("_is_col"),
        F.sum("_o").alias("_margin"),
        F.sum(F.when(o > 0, o * F.ln(o)).otherwise(0.0)).alias("_cells"),
    )
    margin = F.col("_margin").cast("double")
    margin_log = F.when(margin > 0, margin * F.ln(margin)).otherwise(0.0)
    is_row = F.col("_is_col") == 0
    sums = margins.agg(
        F.sum(F.when(is_row, F.col("_cells") - margin_log).otherwise(-margin_log)).alias("_terms"),
        F.count_if(is_row).alias("_r"),
        F.count_if(~is_row).alias("_c"),
        F.sum(F.when(is_row, F.col("_margin"))).alias("n"),
    )
    total = F.col("n").cast("double")
    out = sums.select(
        F.when(
            total > 0, F.greatest(2 * (F.col("_terms") + total * F.ln(total)), F.lit(0.0))
        ).alias("g"),
        ((F.col("_r") - 1) * (F.col("_c") - 1)).alias("df"),
        "n",
    )
    return out.withColumn("p", chi2_sf(F.col("g"), F.col("df"))) if with_p else out


def pairwise_g_test(
    counts: DataFrame,
    group: str,
    cells: tuple[str, str],
    *,
    with_p: bool = True,
    null_group: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """The 2 x 2 G-test of every unordered pair of groups, p unadjusted.

    The result is all k (k - 1) / 2 pairs, by definition: this is meant for grouped counts, not
    for rows. Groups are dealt into ``blocks`` and joined by equal block pair, so the pairs are
    spread over blocks^2 join keys (by default at least as many as shuffle partitions) and neither
    side is broadcast or crossed. The null group, if counted, comes last in a pair.
    """
    a, b = cells
    if blocks is None:
        partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(8, math.isqrt(partitions) + 1)
    if not null_group:
        counts = counts.where(F.col(group).isNotNull())
    block = F.pmod(F.xxhash64(group), F.lit(blocks)).cast("int")
    dealt = counts.select(group, a, b, block.alias("_block"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    left = dealt.select(
        F.col(group).alias("group_a"),
        F.col(a).alias("_a1"),
        F.col(b).alias("_a2"),
        F.col("_block").alias("_block_a"),
        others,
    ).withColumnRenamed("_other", "_want_b")
    right = dealt.select(
        F.col(group).alias("group_b"),
        F.col(a).alias("_b1"),
        F.col(b).alias("_b2"),
        F.col("_block").alias("_block_b"),
        others,
    ).withColumnRenamed("_other", "_want_a")
    pairs = left.join(
        right,
        (F.col("_block_a") == F.col("_want_a"))
        & (F.col("_want_b") == F.col("_block_b"))
        & F.when(F.col("group_b").isNull(), F.col("group_a").isNotNull()).otherwise(
            F.coalesce(F.col("group_a") < F.col("group_b"), F.lit(False))
        ),
    )
    a1, a2, b1, b2 = (F.col(c) for c in ("_a1", "_a2", "_b1", "_b2"))
    n = a1 + a2 + b1 + b2
    g = 2 * (
        _n_log(a1, a1 + a2)
        + _n_log(a2, a1 + a2)
        + _n_log(b1, b1 + b2)
        + _n_log(b2, b1 + b2)
        - _n_log(a1 + b1, n)
        - _n_log(a2 + b2, n)
    )
    out = pairs.select(
        "group_a", "group_b", F.greatest(g, F.lit(0.0)).alias("g"), F.lit(1).alias("df")
    )
    return out.withColumn("p", chi2_sf_one(F.col("g"))) if with_p else out


def to_long(
    counts: DataFrame, group: str, cells: Sequence[str], *, col: str = "cell", n: str = "n"
) -> DataFrame:
    """Grouped counts as (group, cell, n) rows, the layout ``g_test_long`` takes."""
    return counts.unpivot([group], list(cells), col, n)


def to_matrix(
    pairs: DataFrame,
    value: str = "p",
    *,
    row: str = "group_b",
    col: str = "group_a",
    columns: Sequence[object] | None = None,
) -> DataFrame:
    """Lower triangle layout of pairs: one row per later group, one column per earlier one.

    Without ``columns`` Spark first runs a job for the column names (one per group).
    """
    grouped = pairs.groupBy(row)
    pivoted = grouped.pivot(col, list(columns)) if columns is not None else grouped.pivot(col)
    return pivoted.agg(F.first(value))
