"""Correlation, least squares and stepwise selection from one pass of centred moments.

Spark reads the rows once and returns, per model, the pairwise moments of its columns. Everything
after that works on those p x p numbers: a stepwise search fits each candidate from them, so no
candidate costs a scan. Fitting runs in the task that holds the moment row, and nothing is
collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.functions.tails import f_tail, t_quantile, t_sf, t_two_sided
from rollcall.operators.keys import REGION, Keys, as_list
from rollcall.operators.moments import MERGE_FAN_IN, PARTS, Moments, moment_rows, pair_moments, stack_of

INTERCEPT = "(Intercept)"


def corr_matrix(df: DataFrame, cols: Sequence[str], *, by: Keys = ()) -> DataFrame:
    """Long Pearson matrix (x, y, r, n, p) of all column pairs, with pairwise deletion."""
    by, cols = as_list(by), list(cols)

    def rows_of(m: Moments) -> list[dict]:
        out = []
        for i, j in combinations(range(len(cols)), 2):
            n, scale = m.n[i, j], math.sqrt(max(m.spread[i, j], 0) * max(m.spread[j, i], 0))
            r = max(-1.0, min(1.0, m.cross[i, j] / scale)) if scale > 0 else math.nan
            t = r * math.sqrt((n - 2) / (1 - r * r)) if n > 2 and abs(r) < 1 else math.inf
            p = t_two_sided(t, n - 2) if n > 2 and r == r else math.nan
            out.append({"x": cols[i], "y": cols[j], "r": r, "n": int(n), "p": p})
        return out

    fields = [
        T.StructField("x", T.StringType()),
        T.StructField("y", T.StringType()),
        T.StructField("r", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("p", T.DoubleType()),
    ]
    return _per_model(pair_moments(df, cols, by), by, fields, rows_of)


def fit_line(
    df: DataFrame, x: str, y: str, *, by: Keys = (), with_p: bool = True, band: bool = False
) -> DataFrame:
    """Regression line of ``y`` on ``x``: n, r, r2, slope, intercept and the p value of r.

    ``band`` adds what a confidence band needs: mean and centred squares of x, residual squares.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.groupBy(*as_list(by)).agg(
        F.regr_count(ys, xs).alias("n"),
        F.corr(ys, xs).alias("r"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        *([F.regr_avgx(ys, xs).alias("mean_x"), F.regr_sxx(ys, xs).alias("sxx")] if band else []),
        *([F.regr_syy(ys, xs).alias("_syy")] if band else []),
    )
    if band:
        rss = F.greatest(F.col("_syy") * (1 - F.col("r2")), F.lit(0.0))
        out = out.withColumn("rss", rss).drop("_syy")
    if not with_p:
        return out
    free = F.col("n") - 2
    t = F.when(F.col("r2") < 1, F.col("r") * F.sqrt(free / (1 - F.col("r2")))).otherwise(
        float("inf")
    )
    return out.withColumn("p", t_sf(F.when(F.col("r").isNotNull(), t), free))


def leave_out(df: DataFrame, *values: object, region: str = REGION) -> DataFrame:
    """The rows without the named regions (rows without a region stay out too)."""
    return df.where(~F.col(region).isin(list(values)))


def moments(df: DataFrame, cols: Sequence[str], by: Keys = ()) -> DataFrame:
    """Pairwise moments of the rows that have all of ``cols``."""
    numeric = df.select(*as_list(by), *(F.col(c).cast("double").alias(c) for c in cols))
    return pair_moments(numeric.dropna(subset=list(cols)), list(cols), by)


#: A column whose share not explained by the model's columns is smaller is a combination of them.
TOLERANCE = 1e-10


class _Model:
    """Means and centred cross-products with the response in column 0."""

    def __init__(self, m: Moments):
        self.n = int(m.n[0, 0])
        self.means = np.diag(m.mean)
        self.cross = m.cross
        self.scale = np.sqrt(np.maximum(np.diag(self.cross), 0.0))

    def estimable(self, columns: Sequence[int]) -> list[int]:
        """The columns that are not a linear combination of earlier ones."""
        return _Swept(self, columns).kept

    def correlations(self) -> np.ndarray:
        """Cross-products in units of the columns' scales; a column without spread has zeros."""
        s = np.where(self.scale > 0, self.scale, 1.0)
        return np.where(np.outer(self.scale, self.scale) > 0, self.cross / np.outer(s, s), 0.0)

    def fit(self, columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Slopes, the inverse of the centred cross-products, and the residual sum of squares."""
        total = self.cross[0, 0]
        if not columns:
            return np.zeros(0), np.zeros((0, 0)), total
        columns = list(columns)
        s = self.scale[columns]
        inverse = np.linalg.inv(self.cross[np.ix_(columns, columns)] / np.outer(s, s))
        beta = inverse @ (self.cross[columns, 0] / s)
        rss = total - beta @ (self.cross[columns, 0] / s)
        return beta / s, inverse / np.outer(s, s), max(rss, 0.0)

    def criterion(self, share: float, columns: int, penalty: float, corrected: bool) -> float:
        """n ln(RSS / n) + penalty x coefficients, with the small-sample term if ``corrected``.

        ``share`` is RSS in units of the response's sum of squares. NaN where the model leaves no
        residual freedom or fits exactly: there is nothing to compare.
        """
        size = columns + 1
        if self.n <= size or share <= 0 or self.cross[0, 0] <= 0:
            return math.nan
        value = self.n * math.log(share * self.cross[0, 0] / self.n) + penalty * size
        if corrected:
            free = self.n - size - 2
            value += 2.0 * (size + 1) * (size + 2) / free if free > 0 else math.inf
        return value


class _Swept:
    """The scaled cross-products with a model's columns swept in.

    A sweep of one column takes p^2 steps. Afterwards the response's own entry is the residual sum
    of squares, and one division says what it would be with any other column in, or any column of
    the model out.
    """

    def __init__(self, m: _Model, columns: Sequence[int]):
        self.a = m.correlations()
        #: Columns in the model, and columns that are combinations of these.
        self.kept: list[int] = []
        self.spare: list[int] = []
        for c in columns:
            self.add(c)

    def add(self, c: int) -> None:
        if self.a[c, c] < TOLERANCE:
            self.spare.append(c)
        else:
            self._sweep(c, 1.0)
            self.kept.append(c)

    def _sweep(self, c: int, sign: float) -> None:
        a, d = self.a, self.a[c, c]
        row = a[c].copy()
        a -= np.outer(row, row / d)
        a[c] = a[:, c] = sign * row / d
        a[c, c] = -1.0 / d

    @property
    def share(self) -> float:
        return self.a[0, 0]

    def with_column(self, c: int) -> tuple[float, int]:
        """RSS share and number of columns with one more column."""
        d = self.a[c, c]
        if c in self.spare or d < TOLERANCE:
            return self.share, len(self.kept)
        return self.share - self.a[0, c] ** 2 / d, len(self.kept) + 1

    def without_column(self, c: int) -> tuple[float, int]:
        """RSS share and number of columns with one column of the model less."""
        if c in self.spare:
            return self.share, len(self.kept)
        if not self.spare:
            return self.share - self.a[0, c] ** 2 / self.a[c, c], len(self.kept) - 1
        # A combination of this column and others may take its place.
        left = object.__new__(_Swept)
        left.a, left.spare = self.a.copy(), []
        left.kept = [k for k in self.kept if k != c]
        left._sweep(c, -1.0)
        for d in self.spare:
            left.add(d)
        return left.share, len(left.kept)


def _coefficients(m: _Model, xs: Sequence[str], columns: Sequence[int], level: float) -> dict:
    kept = m.estimable(columns)
    slopes, inverse, rss = m.fit(kept)
    free = m.n - len(kept) - 1
    total = m.cross[0, 0]
    variance = rss / free if free > 0 else math.nan
    centre = m.means[kept]
    estimate = {0: m.means[0] - slopes @ centre}
    spread = {0: 1.0 / m.n + centre @ inverse @ centre}
    for i, c in enumerate(kept):
        estimate[c], spread[c] = slopes[i], inverse[i, i]
    reach = t_quantile(level, free)
    out = []
    for c in [0, *columns]:
        value = estimate.get(c, math.nan)
        error = math.sqrt(variance * spread[c]) if c in spread else math.nan
        t = value / error if error > 0 else math.nan
        out.append(
            {
                "term": INTERCEPT if c == 0 else xs[c - 1],
                "estimate": value,
                "std_error": error,
                "t": t,
                "p": t_two_sided(t, free),
                "ci_low": value - reach * error,
                "ci_high": value + reach * error,
            }
        )
    shared = {
        "n": m.n,
        "df_residual": free,
        "sigma": math.sqrt(variance) if variance == variance else math.nan,
        "r2": 1.0 - rss / total if total > 0 else math.nan,
    }
    size = len(kept)
    explained = (total - rss) / size if size else math.nan
    f = explained / variance if variance > 0 else math.nan
    shared |= {
        "adj_r2": 1.0 - (rss / free) / (total / (m.n - 1)) if total > 0 and free > 0 else math.nan,
        "f": f,
        "f_df": size,
        "f_p": f_tail(f, size, free),
    }
    return [row | shared for row in out]


_FIT_FIELDS = [
    T.StructField("term", T.StringType()),
    *(
        T.StructField(c, T.DoubleType())
        for c in ("estimate", "std_error", "t", "p", "ci_low", "ci_high")
    ),
    T.StructField("n", T.LongType()),
    T.StructField("df_residual", T.LongType()),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()),
    T.StructField("f", T.DoubleType()),
    T.StructField("f_df", T.LongType()),
    T.StructField("f_p", T.DoubleType()),
]


def _per_model(
    found: DataFrame,
    by: list[str],
    fields: list[T.StructField],
    rows_of: Callable[[Moments], list[dict]],
) -> DataFrame:
    """Apply ``rows_of`` to the moments of every row; keep the group columns."""
    schema = T.StructType([*(found.schema[c] for c in by), *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                m = Moments.from_flat(*(record[p] for p in PARTS))
                rows += [{c: record[c] for c in by} | row for row in rows_of(m)]
            yield pd.DataFrame(rows, columns=schema.names)

    out = found.select(*by, *PARTS).mapInPandas(run, schema)
    doubles = [f.name for f in fields if isinstance(f.dataType, T.DoubleType)]
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def ols(
    df: DataFrame, y: str, xs: Sequence[str], *, by: Keys = (), level: float = 0.95
) -> DataFrame:
    """Least squares of ``y`` on ``xs`` with an intercept: one row per term (and group).

    Rows with a null in any model column are left out. A term that repeats earlier ones has a
    null estimate.
    """
    by, xs = as_list(by), list(xs)
    columns = list(range(1, len(xs) + 1))
    return _per_model(
        moments(df, [y, *xs], by),
        by,
        _FIT_FIELDS,
        lambda m: _coefficients(_Model(m), xs, columns, level),
    )


def _search(
    m: _Model,
    xs: list[str],
    start: list[int],
    lower: set[int],
    direction: str,
    penalty: float,
    corrected: bool,
) -> list[dict]:
    """The path of a stepwise search: the start and each accepted move."""
    # One column order per model, whatever the order of the moves, so that a model has one value.
    def swept(columns: list[int]) -> _Swept:
        return _Swept(m, sorted(columns, key=lambda c: xs[c - 1]))

    def value(share: float, size: int) -> float:
        return m.criterion(share, size, penalty, corrected)

    # Rounding of n ln(RSS / n) grows with n; a gain below it is no gain.
    tolerance = 1e-9 + 1e-14 * m.n
    current, model = list(start), swept(start)
    best = value(model.share, len(model.kept))
    path = [{"move": "start", "columns": list(current), "criterion": best, "reason": None}]
    if math.isnan(best):
        path[0]["reason"] = "no residual freedom"
        return path
    while True:
        scored = []
        if direction in ("backward", "both"):
            scored += [
                (value(*model.without_column(c)), f"- {xs[c - 1]}", [d for d in current if d != c])
                for c in current
                if c not in lower
            ]
        if direction in ("forward", "both"):
            scored += [
                (value(*model.with_column(c)), f"+ {x}", [*current, c])
                for c, x in enumerate(xs, start=1)
                if c not in current
            ]
        scored = [s for s in scored if not math.isnan(s[0])]
        least = min((s[0] for s in scored), default=math.inf)
        if least >= best - tolerance:
            return path
        _, move, current = min((s for s in scored if s[0] <= least + tolerance), key=lambda s: s[1])
        # Swept anew: rounding does not add up over the moves, and values fall from step to step.
        model = swept(current)
        reached = value(model.share, len(model.kept))
        if not reached < best:
            return path
        best = reached
        path.append({"move": move, "columns": list(current), "criterion": best, "reason": None})


def _check_step(direction: str, xs: list[str], start: Sequence[str], lower: Sequence[str]) -> None:
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    unknown = [c for c in (*start, *lower) if c not in xs]
    if unknown:
        raise ValueError(f"not among the candidates: {unknown}")


def step_aic(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    *,
    start: Sequence[str] | None = None,
    lower: Sequence[str] = (),
    direction: str = "both",
    penalty: float | None = 2.0,
    corrected: bool = False,
    by: Keys = (),
) -> DataFrame:
    """Stepwise selection among ``xs`` by n ln(RSS / n) + penalty x coefficients.

    One row per step: step number, move, terms and criterion; the last step is the chosen model.
    ``start`` defaults to no terms for forward and all of them otherwise. ``penalty`` 2 is AIC,
    ``None`` is ln(n), that is BIC; ``corrected`` adds the small-sample term. Moves with equal
    criterion are taken in name order. A group whose first model leaves no residual freedom has
    one row with a null criterion and the ``reason``; moves to such models are not taken.
    """
    by, xs = as_list(by), list(xs)
    first = ([] if direction == "forward" else xs) if start is None else list(start)
    _check_step(direction, xs, first, lower)
    begin = [xs.index(c) + 1 for c in first]
    keep = {xs.index(c) + 1 for c in lower}

    def rows_of(found: Moments) -> list[dict]:
        m = _Model(found)
        weight = math.log(m.n) if penalty is None else float(penalty)
        path = _search(m, xs, begin, keep, direction, weight, corrected)
        return [
            {
                "step": i,
                "move": p["move"],
                "terms": [xs[c - 1] for c in p["columns"]],
                "criterion": p["criterion"],
                "is_final": int(i == len(path) - 1),
                "n": m.n,
                "reason": p["reason"],
            }
            for i, p in enumerate(path)
        ]

    fields = [
        T.StructField("step", T.LongType()),
        T.StructField("move", T.StringType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("criterion", T.DoubleType()),
        T.StructField("is_final", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
    return _per_model(moments(df, [y, *xs], by), by, fields, rows_of)


def step_fit(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    *,
    start: Sequence[str] | None = None,
    lower: Sequence[str] = (),
    direction: str = "both",
    penalty: float | None = 2.0,
    corrected: bool = False,
    by: Keys = (),
    level: float = 0.95,
) -> DataFrame:
    """Coefficients of the model that ``step_aic`` chooses, from the same single pass."""
    by, xs = as_list(by), list(xs)
    first = ([] if direction == "forward" else xs) if start is None else list(start)
    _check_step(direction, xs, first, lower)
    begin = [xs.index(c) + 1 for c in first]
    keep = {xs.index(c) + 1 for c in lower}

    def rows_of(found: Moments) -> list[dict]:
        m = _Model(found)
        weight = math.log(m.n) if penalty is None else float(penalty)
        chosen = _search(m, xs, begin, keep, direction, weight, corrected)[-1]["columns"]
        return _coefficients(m, xs, chosen, level)

    return _per_model(moments(df, [y, *xs], by), by, _FIT_FIELDS, rows_of)


def ols_leave_each_out(
    df: DataFrame, y: str, xs: Sequence[str], *, region: str = REGION, level: float = 0.95
) -> DataFrame:
    """The fit without each region in turn, keyed by the region left out.

    Rows are reduced to one moment row per region, and what is left without a region is merged from
    the others, never subtracted from a total: a region with nearly all rows, or with far larger
    values, leaves the rest its digits. Regions are dealt into ``MERGE_FAN_IN`` buckets; each
    bucket's others are merged from the other buckets, and within a bucket each region adds its
    siblings, so no task holds all regions. Rows without a region are not used. A region whose
    absence leaves no rows is not in the result.
    """
    xs = list(xs)
    per_region = moments(df.where(F.col(region).isNotNull()), [y, *xs], region)
    bucket = F.pmod(F.xxhash64(region), F.lit(MERGE_FAN_IN))
    keyed = per_region.withColumn("_bucket", bucket)
    lists = T.StructType([T.StructField(p, T.ArrayType(T.DoubleType())) for p in PARTS])
    keys = T.StructType([T.StructField("_bucket", T.LongType())])

    def total(regions: pa.Table) -> pa.Table:
        return moment_rows(stack_of(regions).combined([0]), regions.select(["_bucket"]).slice(0, 1))

    def outside(buckets: pa.Table) -> pa.Table:
        return moment_rows(stack_of(buckets).others(), buckets.select(["_bucket"]))

    totals = keyed.groupBy("_bucket").applyInArrow(lambda t: total(t), T.StructType([*keys, *lists]))
    # One row per bucket, as many as the fan-in.
    rest = totals.groupBy().applyInArrow(lambda t: outside(t), T.StructType([*keys, *lists]))
    rest = rest.withColumnRenamed("_bucket", "_of")
    columns = list(range(1, len(xs) + 1))
    schema = T.StructType([per_region.schema[region], *_FIT_FIELDS])

    def fits(regions: pa.Table, others: pa.Table) -> pa.Table:
        left = stack_of(regions).others(stack_of(others))
        rows = []
        for i, name in enumerate(regions.column(region).to_pylist()):
            m = Moments(*(getattr(left, p)[i] for p in PARTS))
            if m.n[0, 0] > 0:
                rows += [{region: name} | row for row in _coefficients(_Model(m), xs, columns, level)]
        return pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))

    out = keyed.groupBy("_bucket").cogroup(rest.groupBy("_of")).applyInArrow(lambda r, o: fits(r, o), schema)
    doubles = [f.name for f in _FIT_FIELDS if isinstance(f.dataType, T.DoubleType)]
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
