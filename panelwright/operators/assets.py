"""Dimension tables derived from the bars: calendar, instrument master, suspension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelwright.sources.tables import in_date_range

# Days without a bar before an instrument counts as delisted; volume at or below which it is suspended.
DELIST_GRACE_DAYS = 90
SUSPENSION_VOLUME = 0.0


def trading_calendar(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, is_open, td_idx): every date with a bar, numbered in order."""
    return with_day_index(in_date_range(bars.select("date").dropna(), start, end).distinct())


def with_day_index(dates: DataFrame) -> DataFrame:
    """Number the open days from zero.

    The window is unpartitioned on purpose: it sees one row per open day, at most 366 a year.
    The same bound is what lets every consumer broadcast a calendar.
    """
    is_open = F.col("is_open") if "is_open" in dates.columns else F.lit(True)
    return (
        dates.select("date", is_open.alias("is_open"))
        .where("is_open")
        .withColumn("td_idx", F.row_number().over(W.orderBy("date")) - 1)
    )


def instrument_master(
    bars: DataFrame, grace_days: int = DELIST_GRACE_DAYS, calendar: DataFrame | None = None
) -> DataFrame:
    """(sid, symbol, list_date, delist_date); delisted = last bar older than the grace period.

    With the bars' own calendar given, the latest date comes from it instead of another pass over the bars.
    """
    spans = bars.groupBy("sid").agg(F.min("date").alias("list_date"), F.max("date").alias("last_date"))
    latest = (bars if calendar is None else calendar).agg(F.max("date")).scalar()
    return spans.select(
        "sid",
        F.col("sid").alias("symbol"),
        "list_date",
        F.when(F.col("last_date") < F.date_sub(latest, grace_days), F.col("last_date")).alias("delist_date"),
    )


def status_intervals(daily: DataFrame) -> DataFrame:
    """Sparse suspension rows: bars whose volume is not above zero. Independent of the panel's own flag."""
    return daily.where(F.col("market.volume") <= SUSPENSION_VOLUME).select(
        "date", "sid", F.lit(True).alias("is_suspended")
    )
