"""Namespaces are structs (`market`, `feature`, `meta`, `status`) or three-field label structs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

KEYS = ("date", "sid")

# Price-bar fields.
MARKET_FIELDS = ("open", "high", "low", "close", "volume", "amount", "adj_factor")
REQUIRED_BAR_FIELDS = ("open", "high", "low", "close", "volume")

# The status fields of a panel.
STATUS_FIELDS = (
    "is_listed",
    "is_suspended",
    "has_market_record",
    "has_factor_record",
    "market_state",
    "factor_state",
    "bar_missing",
    "factor_row_missing",
    "factor_missing_ratio",
    "feature_all_missing",
    "sample_state",
    "sample_usable_for_feature",
)
BOOLEAN_STATUS_FIELDS = (
    "is_listed",
    "is_suspended",
    "has_market_record",
    "has_factor_record",
    "bar_missing",
    "factor_row_missing",
    "feature_all_missing",
    "sample_usable_for_feature",
)
LABEL_FIELDS = ("value", "valid", "reason")


class SchemaError(ValueError):
    """A table does not satisfy its contract."""


def struct_fields(df: DataFrame, namespace: str) -> list[str]:
    """Field names of a struct column, or an empty list when the column is absent."""
    for field in df.schema:
        if field.name == namespace and isinstance(field.dataType, T.StructType):
            return field.dataType.names
    return []


def feature_names(df: DataFrame) -> list[str]:
    return sorted(struct_fields(df, "feature"))


def label_columns(df: DataFrame) -> list[str]:
    """Names of columns shaped like a target: a struct of exactly value, valid and reason."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StructType) and tuple(f.dataType.names) == LABEL_FIELDS
    ]


def forbidden_panel_columns(df: DataFrame) -> list[str]:
    """Columns that must never sit in a base panel: targets and predictions."""
    return label_columns(df) + [c for c in df.columns if c == "pred" or c.startswith(("label", "pred_"))]


def require_columns(df: DataFrame, names: Iterable[str], table: str) -> None:
    known = set(df.columns)
    for field in df.schema:
        if isinstance(field.dataType, T.StructType):
            known.update(f"{field.name}.{n}" for n in field.dataType.names)
    absent = [n for n in names if n not in known]
    if absent:
        raise SchemaError(f"{table}: missing columns {absent}")


def select_features(
    names: Iterable[str],
    include: str | None = None,
    exclude: str | None = None,
    fundamentals: Iterable[str] | None = None,
) -> list[str]:
    """Choose features by name: keep `include` matches, drop `exclude` matches (regex search).

    With `fundamentals` given, a name holding ``fund__`` stays only when listed
    (with or without the ``feature.`` prefix); other names are untouched.
    """
    kept = [n for n in names if not include or re.search(include, f"feature.{n}")]
    kept = [n for n in kept if not exclude or not re.search(exclude, f"feature.{n}")]
    if fundamentals is not None:
        allowed = {f.removeprefix("feature.") for f in fundamentals}
        kept = [n for n in kept if "fund__" not in n or n in allowed]
    return kept


def encoded_positions(names: list[str], include: str | None = None, exclude: str | None = None) -> list[int] | None:
    """Positions to keep in the layout [features | missing flags | present]; None means all of them."""
    kept = set(select_features(names, include, exclude))
    chosen = [i for i, n in enumerate(names) if n in kept]
    if len(chosen) == len(names):
        return None
    return chosen + [len(names) + i for i in chosen] + [2 * len(names)]


def encoded_width(names: list[str], include: str | None = None, exclude: str | None = None) -> int:
    positions = encoded_positions(names, include, exclude)
    return 2 * len(names) + 1 if positions is None else len(positions)
