"""Raw feeds to clean keyed tables: names, identifiers, dates, defaults, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.identifiers import normalise_date, normalise_symbol
from panelwright.functions.missing import fractional_columns, nan_to_null
from panelwright.functions.schema import MARKET_FIELDS, REQUIRED_BAR_FIELDS
from panelwright.operators.staging import stage
from panelwright.sources.tables import union_all, yearly_groups

# Accepted names of each field, best first.
BAR_DATE_NAMES = ("date", "trade_date", "datetime")
BAR_SID_NAMES = ("sid", "order_book_id", "instrument", "code", "ts_code", "symbol")
BAR_OPTIONAL_NAMES = {"amount": ("amount", "money"), "adj_factor": ("adj_factor", "factor")}
FACTOR_DATE_NAMES = ("datetime", "date", "trade_date")
FACTOR_SID_NAMES = ("order_book_id", "instrument", "symbol", "sid", "code", "ts_code")
FACTOR_META_NAMES = (
    "datetime", "date", "instrument", "order_book_id", "sid", "symbol", "trade_date", "ts_code", "code",
)


class SourceError(ValueError):
    """A raw feed lacks what normalisation needs."""


def _first_present(df: DataFrame, names: Sequence[str], what: str) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise SourceError(f"no {what} column; found {df.columns}")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in `order`.

    An aggregate rather than a row number: partial aggregation leaves at most one
    candidate per key and input task, so a key holding most of the rows costs nothing extra.
    """
    payload = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload])


def keep_first_by_position(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """One row per key: the first by `position`, which names each row of the feed once. The position columns are left out.

    Which keys occur more than once, and where first, is found on keys and positions alone. Only those few keys meet the wide rows, which are
    filtered where they are if the planner sees that the keys are few, and shuffled once if they are not; wide rows are never gathered or sorted by an aggregate.
    """
    spot = F.struct(*position)
    firsts = df.select(*keys, *position).groupBy(*keys).agg(F.min(spot).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = stage(firsts.where("_n > 1").select(*keys, "_first"))
    kept = df.join(repeated, list(keys), "left").where(F.col("_first").isNull() | (spot == F.col("_first")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns if c not in position])


def _keyed(df: DataFrame, date: str, sid: str) -> DataFrame:
    """Rows with a readable date and an identifier; tested on the raw identifier, which is cheap to push down."""
    return df.where(F.col(sid).isNotNull() & _date(df, date).isNotNull())


def _date(df: DataFrame, name: str) -> Column:
    return normalise_date(F.col(name), df.schema[name].dataType.simpleString())


def drop_counts(df: DataFrame, date_names: Sequence[str] = BAR_DATE_NAMES, sid_names: Sequence[str] = BAR_SID_NAMES) -> DataFrame:
    """One row for a raw feed: n_rows, and how many normalisation drops for no readable date, for no identifier, and as repeated keys."""
    date, sid = _first_present(df, date_names, "date"), _first_present(df, sid_names, "instrument")
    keys = df.select(_date(df, date).alias("date"), normalise_symbol(F.col(sid)).alias("sid")).groupBy("date", "sid").agg(F.count(F.lit(1)).alias("n"))

    def total(rows: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, n)), F.lit(0)).cast("long")

    n, dated, named = F.col("n"), F.col("date").isNotNull(), F.col("sid").isNotNull()
    return keys.agg(total(F.lit(True), n).alias("n_rows"), total(~dated, n).alias("no_date"), total(dated & ~named, n).alias("no_sid"),
                    total(dated & named, n - 1).alias("repeated"))


def _without_nan(df: DataFrame) -> DataFrame:
    fractional = set(fractional_columns(df))
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in fractional else F.col(c) for c in df.columns])


def bar_fields(df: DataFrame) -> list[Column]:
    """The bar columns as doubles; absent optional ones get their defaults."""
    absent = [c for c in REQUIRED_BAR_FIELDS if c not in df.columns]
    if absent:
        raise SourceError(f"bars lack required columns {absent}")
    defaults = {"amount": F.lit(None).cast("double"), "adj_factor": F.lit(1.0)}
    fields = [F.col(c).cast("double").alias(c) for c in REQUIRED_BAR_FIELDS]
    for name, aliases in BAR_OPTIONAL_NAMES.items():
        present = next((a for a in aliases if a in df.columns), None)
        fields.append((F.col(present).cast("double") if present else defaults[name]).alias(name))
    return fields


def _clean_bars(df: DataFrame, order: Sequence[str]) -> DataFrame:
    date = _first_present(df, BAR_DATE_NAMES, "date")
    sid = _first_present(df, BAR_SID_NAMES, "instrument")
    fields = bar_fields(df)
    clean = _keyed(df, date, sid).select(
        _date(df, date).alias("date"),
        normalise_symbol(F.col(sid)).alias("sid"),
        *fields,
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    return _without_nan(clean)


def _first_of(clean: DataFrame, order: Sequence[str] | None) -> DataFrame:
    return keep_first(clean, ["date", "sid"], [f"_o{i}" for i in range(len(order))]) if order else clean


def normalise_bars(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """(date, sid, open .. adj_factor). `order` names the columns that say which duplicate is first;
    without it the caller vouches that keys are already unique."""
    return _first_of(_clean_bars(df, order or ()), order)


def _clean_factors(df: DataFrame, order: Sequence[str], exclude: Iterable[str]) -> DataFrame:
    date = _first_present(df, FACTOR_DATE_NAMES, "date")
    sid = _first_present(df, FACTOR_SID_NAMES, "instrument")
    skipped = {*FACTOR_META_NAMES, *exclude, *order, "_file", "_row"}
    names = [c for c in df.columns if c not in skipped]
    if not names:
        raise SourceError("factor feed has no feature columns")
    clean = _keyed(df, date, sid).select(
        _date(df, date).alias("date"),
        normalise_symbol(F.col(sid)).alias("sid"),
        *[F.col(f"`{c}`").cast("float").alias(c.removeprefix("feature.")) for c in names],
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    return _without_nan(clean)


def normalise_factors(df: DataFrame, order: Sequence[str] | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """(date, sid, <features as float>), identifier columns other than the chosen one dropped."""
    return _first_of(_clean_factors(df, order or (), exclude), order)


def read_bars(spark: SparkSession, directory: str, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Clean bars of a yearly directory. Files of equal schema are normalised together, each group by its own column names and types.
    Duplicates across files are resolved too, not only within one."""
    order = ["_file", "_row"]
    clean = union_all([_clean_bars(df, order) for df in yearly_groups(spark, directory, start_year, end_year)])
    return keep_first_by_position(clean, ["date", "sid"], ["_o0", "_o1"])


def read_factors(
    spark: SparkSession,
    directory: str,
    start_year: int | None = None,
    end_year: int | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    order = ["_file", "_row"]
    clean = union_all([_clean_factors(df, order, exclude) for df in yearly_groups(spark, directory, start_year, end_year)])
    return keep_first_by_position(clean, ["date", "sid"], ["_o0", "_o1"])


def bar_keys(bars: DataFrame) -> DataFrame:
    """Distinct (date, sid): all that the calendar and the instrument master need."""
    return bars.select("date", "sid").distinct()


def market_struct(bars: DataFrame) -> Column:
    return F.struct(*[c for c in MARKET_FIELDS if c in bars.columns])


def feature_struct(names: Iterable[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").cast("float").alias(c) for c in names])


def daily_bars(bars: DataFrame) -> DataFrame:
    return bars.select("date", "sid", market_struct(bars).alias("market"))


def factor_values(factors: DataFrame) -> DataFrame:
    names = [c for c in factors.columns if c not in ("date", "sid")]
    return factors.select("date", "sid", feature_struct(names).alias("feature"))
