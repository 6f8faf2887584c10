"""The tables behind maps and scatter plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.tails import t_reach
from rollcall.operators.keys import REGION, attach
from rollcall.operators.linear import fit_line


def legend_bin(value: Column, breaks: Sequence[float]) -> Column:
    """Index of the last break at or below the value; null below the first break or for null."""
    steps: Column | None = None
    for i in range(len(breaks) - 1, -1, -1):
        arm = (value >= F.lit(breaks[i]), F.lit(i))
        steps = F.when(*arm) if steps is None else steps.when(*arm)
    return F.lit(None).cast("int") if steps is None else steps


def region_layer(
    metric: DataFrame,
    regions: DataFrame,
    value: str,
    *,
    limits: tuple[float, float],
    breaks: Sequence[float],
    region: str = REGION,
) -> DataFrame:
    """Every region with its value, whether it is missing or off the scale, and its legend bin.

    A value outside ``limits`` is drawn in the missing colour, so it gets no bin.
    """
    low, high = limits
    joined = attach(regions, metric.select(region, value), region, null_safe=())
    v = F.col(value)
    off = v.isNotNull() & ((v < F.lit(low)) | (v > F.lit(high)))
    return joined.withColumns(
        {
            "is_missing": v.isNull().cast("int"),
            "off_scale": off.cast("int"),
            "legend_bin": F.when(~off, legend_bin(v, breaks)),
        }
    )


def scatter_layer(
    df: DataFrame, x: str, y: str, keep: Sequence[str] = (), *, level: float = 0.95
) -> DataFrame:
    """Every point with the regression line, its confidence band, and the label of the plot.

    ``fitted``, ``se_fit``, ``ci_low`` and ``ci_high`` are the line's height at the point's x, its
    standard error and the band at ``level``; null where x is missing or the line has no residual
    freedom. ``r2`` and ``p`` are the line's own. The line is one aggregated row that each task
    reads as a constant.
    """
    line = fit_line(df, x, y, band=True).withColumn("reach", t_reach(F.col("n") - 2, level))
    parts = ("n", "slope", "intercept", "mean_x", "sxx", "rss", "reach", "r2", "p")
    at = F.col(x).cast("double")
    points = df.select(*keep, x, y).withColumn("_line", line.select(F.struct(*parts)).scalar())
    part = {name: F.col(f"_line.{name}") for name in parts}
    free = part["n"] - 2
    gap = at - part["mean_x"]
    spread = 1 / part["n"] + F.when(part["sxx"] > 0, gap * gap / part["sxx"])
    error = F.when(free > 0, F.sqrt(part["rss"] / F.nullif(free, F.lit(0)) * spread))
    height = part["intercept"] + part["slope"] * at
    return points.withColumns({"fitted": height, "se_fit": error}).withColumns(
        {
            "ci_low": F.col("fitted") - part["reach"] * F.col("se_fit"),
            "ci_high": F.col("fitted") + part["reach"] * F.col("se_fit"),
            "r2": part["r2"],
            "p": part["p"],
        }
    ).drop("_line")
