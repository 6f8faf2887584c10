"""Column expressions for ratios and variable transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import col_of


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def percent_int(share: Column | str, *, zero_as_null: bool = True) -> Column:
    """A share as a whole percentage, truncated; zero is shown as missing on the maps."""
    pct = col_of(share) * F.lit(100.0)
    whole = pct.cast("int")
    return F.when(pct != 0, whole) if zero_as_null else whole


def log10_of(c: Column | str, offset: float = 0.0) -> Column:
    """log10(c + offset), failing on input that has no logarithm rather than returning null."""
    shifted = col_of(c).cast("double") + F.lit(float(offset))
    return F.when(
        shifted <= 0, F.raise_error(F.lit(f"log10 needs values above {-offset:g}")).cast("double")
    ).otherwise(F.log10(shifted))


def with_transforms(
    df: DataFrame,
    *,
    log10: Sequence[str] = (),
    log10p1: Sequence[str] = (),
    sqrt: Sequence[str] = (),
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``log10_<col>``, ``log10p1_<col>`` and ``sqrt_<col>`` columns, or names of your own."""
    names = dict(names or {})
    new = {f"log10_{c}": log10_of(c) for c in log10}
    new |= {f"log10p1_{c}": log10_of(c, 1.0) for c in log10p1}
    new |= {f"sqrt_{c}": F.sqrt(F.col(c).cast("double")) for c in sqrt}
    return df.withColumns({names.get(name, name): expr for name, expr in new.items()})
