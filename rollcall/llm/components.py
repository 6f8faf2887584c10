"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import written
from rollcall.operators.keys import unique_side


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and all its v. The join can be split if u is hot."""
    least = unique_side(edges, "u", [F.min("v").alias("m")]).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m")
    )
    return edges.join(least, F.col("u") == F.col("k")).drop("k")


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of its component.

    Each round first hangs the larger neighbours of a node on its least neighbour, then the
    smaller ones (Kiveris et al., "Connected components in MapReduce and beyond"). The rounds are
    about the logarithm of the longest chain. Every round is a written table; the driver sees
    one count and one checksum of it. No links give no rows; a self link gives none either.
    """
    edges = written(
        links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u > v")
        .distinct(),
        "links",
    )
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # In `large` every edge points down, so all v of a u are smaller than u.
        with_least = _with_least(large)
        hung = with_least.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(hung.filter("u > v").distinct(), "stars")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
