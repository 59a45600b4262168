"""Data-quality contracts and panel sanity findings. Checks return rows; only schema faults raise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.missing import is_missing
from panelwright.functions.schema import (
    BOOLEAN_STATUS_FIELDS,
    LABEL_FIELDS,
    REQUIRED_BAR_FIELDS,
    STATUS_FIELDS,
    SchemaError,
    forbidden_panel_columns,
    require_columns,
    struct_fields,
)

STATE_FIELDS = ("sample_state", "market_state", "factor_state")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key_groups, duplicate_rows): keys that repeat, and rows beyond the first of each key."""
    repeats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeats.agg(
        F.count(F.lit(1)).alias("key_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def require_unique(df: DataFrame, keys: Sequence[str], table: str) -> None:
    extra = duplicate_keys(df, keys).first()["duplicate_rows"]
    if extra:
        raise SchemaError(f"{table}: {extra} duplicate rows on {list(keys)}")


def validate_raw_bars(df: DataFrame) -> None:
    require_columns(df, ["date", "sid", *REQUIRED_BAR_FIELDS], "raw bars")
    require_unique(df, ["date", "sid"], "raw bars")


def validate_raw_factors(df: DataFrame) -> None:
    require_columns(df, ["date", "sid"], "raw factors")
    if len(df.columns) <= 2:
        raise SchemaError("raw factors: no feature columns")
    require_unique(df, ["date", "sid"], "raw factors")


def validate_instrument_master(df: DataFrame) -> None:
    require_columns(df, ["sid", "symbol", "list_date", "delist_date"], "instrument master")
    require_unique(df, ["sid"], "instrument master")
    if df.where(F.col("list_date").isNull()).limit(1).count():
        raise SchemaError("instrument master: list_date is missing on some rows")


def validate_trading_calendar(df: DataFrame) -> None:
    require_columns(df, ["date", "is_open"], "trading calendar")
    require_unique(df, ["date"], "trading calendar")


def validate_daily_bars(df: DataFrame) -> None:
    require_columns(df, ["date", "sid", *[f"market.{f}" for f in REQUIRED_BAR_FIELDS]], "daily bars")
    require_unique(df, ["date", "sid"], "daily bars")


def validate_factor_values(df: DataFrame) -> None:
    require_columns(df, ["date", "sid"], "factor values")
    if not struct_fields(df, "feature"):
        raise SchemaError("factor values: no feature fields")
    require_unique(df, ["date", "sid"], "factor values")


def validate_session_index(df: DataFrame) -> None:
    require_columns(df, ["date", "sid"], "session index")
    require_unique(df, ["date", "sid"], "session index")


def validate_panel(df: DataFrame) -> None:
    require_columns(df, ["date", "sid", *[f"status.{f}" for f in STATUS_FIELDS]], "panel")
    bad = forbidden_panel_columns(df)
    if bad:
        raise SchemaError(f"panel: labels or predictions do not belong in it: {bad}")
    require_unique(df, ["date", "sid"], "panel")


def validate_target(df: DataFrame, label: str = "label") -> None:
    require_columns(df, ["date", "sid", *[f"{label}.{f}" for f in LABEL_FIELDS]], f"target {label}")


def validate_labels_exist(df: DataFrame, names: Iterable[str]) -> None:
    require_columns(df, [f"{n}.{f}" for n in names for f in LABEL_FIELDS], "labelled panel")


def target_violations(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts of rows breaking: valid means a value and no invalid reason; invalid means no value and a reason."""
    value, valid, reason = (F.col(f"{label}.{f}") for f in LABEL_FIELDS)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid & is_missing(value)).alias("valid_without_value"),
        F.count_if(~valid & ~is_missing(value)).alias("invalid_with_value"),
        F.count_if(~valid & (reason == "")).alias("invalid_without_reason"),
    )


def labelled_panel_violations(panel: DataFrame, labelled: DataFrame) -> DataFrame:
    """(missing_keys, extra_keys, missing_columns) of a labelled panel against its base."""
    keys = ["date", "sid"]
    missing = panel.select(*keys).join(labelled.select(*keys), keys, "left_anti").agg(F.count(F.lit(1)).alias("missing_keys"))
    extra = labelled.select(*keys).join(panel.select(*keys), keys, "left_anti").agg(F.count(F.lit(1))).scalar()
    absent = len([c for c in panel.columns if c not in labelled.columns])
    return missing.select("missing_keys", extra.alias("extra_keys"), F.lit(absent).alias("missing_columns"))


def state_histogram(panel: DataFrame, state: str = "status.sample_state") -> DataFrame:
    """(state, n, share), largest first."""
    counts = panel.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("state", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share")).orderBy(F.desc("n"), "state")


def boolean_rates(panel: DataFrame) -> DataFrame:
    """(flag, n_true, rate) of the boolean status fields, from one aggregate row."""
    counted = panel.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"status.{f}")).alias(f) for f in BOOLEAN_STATUS_FIELDS]
    )
    items = [
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("n_true"), F.try_divide(F.col(f), F.col("n")).alias("rate"))
        for f in BOOLEAN_STATUS_FIELDS
    ]
    return counted.select(F.inline(F.array(*items)))


def missing_ratio_profile(panel: DataFrame) -> DataFrame:
    ratio = F.col("status.factor_missing_ratio")
    return panel.agg(F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio")).select(
        "min_ratio", "max_ratio", (F.col("min_ratio") < F.col("max_ratio")).alias("has_variety")
    )


def state_sets(panel: DataFrame) -> DataFrame:
    """(state_column, state): the states that occur. Each column has a handful."""
    items = [F.struct(F.lit(n).alias("state_column"), F.col(f"status.{n}").alias("state")) for n in STATE_FIELDS]
    return panel.select(F.inline(F.array(*items))).distinct()


def sanity_findings(panel: DataFrame) -> DataFrame:
    """(severity, check, message) for every failed distribution check; no rows means all passed."""
    flags = {f: F.count_if(F.col(f"status.{f}")).alias(f) for f in BOOLEAN_STATUS_FIELDS}
    sets = {s: F.collect_set(f"status.{s}").alias(s) for s in STATE_FIELDS}
    ratio = F.col("status.factor_missing_ratio")
    return findings_of(panel.agg(
        F.count(F.lit(1)).alias("n"), *flags.values(), *sets.values(), F.min(ratio).alias("lo"), F.max(ratio).alias("hi")
    ))


def findings_of(facts: DataFrame) -> DataFrame:
    """The findings from one row of facts: n, the true flags, the states that occur, and the span (lo, hi) of the missing ratio."""
    n = F.col("n")
    findings = [_finding("FAIL", "empty", "panel has no rows", n == 0)]
    some = n > 0
    for f in BOOLEAN_STATUS_FIELDS:
        if f != "is_listed":  # true by construction
            findings.append(_finding("SUSPICIOUS", f"{f}_single_value", f"{f} is all false", some & (F.col(f) == 0)))
            findings.append(_finding("SUSPICIOUS", f"{f}_single_value", f"{f} is all true", some & (F.col(f) == n)))
    suspended, market, usable = F.col("is_suspended"), F.col("has_market_record"), F.col("sample_usable_for_feature")

    def lacks(column: str, state: str) -> Column:
        return some & ~F.array_contains(column, state)

    findings += [
        _finding("FAIL", "no_suspension", "no row is suspended", some & (suspended == 0)),
        _finding("SUSPICIOUS", "mostly_suspended", "more than half of the rows are suspended", some & (suspended * 2 > n)),
        _finding("SUSPICIOUS", "little_market_data", "fewer than half of the rows have a bar", some & (market * 2 < n)),
        _finding("SUSPICIOUS", "missing_ratio_flat", "factor_missing_ratio has one value", some & (F.col("lo") == F.col("hi"))),
        _finding("SUSPICIOUS", "sample_state_flat", "sample_state has fewer than two values", some & (F.size("sample_state") < 2)),
        _finding("FAIL", "sample_state_suspended", "sample_state never is SUSPENDED", lacks("sample_state", "SUSPENDED")),
        _finding("FAIL", "market_state_ok", "market_state never is OK", lacks("market_state", "OK")),
        _finding("SUSPICIOUS", "market_state_flat", "market_state has one value", some & (F.size("market_state") < 2)),
        # The two published variants of this check differ; both are reported.
        _finding("FAIL", "factor_state_ok", "factor_state never is OK", lacks("factor_state", "OK")),
        _finding("SUSPICIOUS", "factor_state_flat", "factor_state has one value", some & (F.size("factor_state") < 2)),
        _finding("SUSPICIOUS", "usable_all", "every row is usable", some & (usable == n)),
        _finding("FAIL", "usable_none", "no row is usable", some & (usable == 0)),
    ]
    return facts.select(F.explode(F.filter(F.array(*findings), lambda x: x["hit"])).alias("f")).select(
        "f.severity", "f.check", "f.message"
    )


def _finding(severity: str, check: str, message: str, hit: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.lit(message).alias("message"),
        F.coalesce(hit, F.lit(False)).alias("hit"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.count_distinct("sid").alias("n_sids")
    )
