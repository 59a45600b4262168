"""Missing-value predicates. Feeds may hold NaN and NULL; both mean "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip_abs(c: Column, limit: float) -> Column:
    """Clip to [-limit, limit]; a limit of zero or less leaves the value alone. Missing stays missing."""
    if not limit or limit <= 0:
        return c
    bounded = F.greatest(F.lit(-float(limit)), F.least(c, F.lit(float(limit))))
    return F.when(is_missing(c), c).otherwise(bounded)


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
