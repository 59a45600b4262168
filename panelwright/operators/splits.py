"""Time splits: date ranges [start, end) as inclusive trading-day ranges of the calendar."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

SPLITS = ("train", "valid", "test")


def split_ranges(calendar: DataFrame, config: Mapping[str, str], lookback: int = 0, on_empty: str = "clamp") -> DataFrame:
    """(split, start_idx, end_idx) for train, valid and test, plus train_valid.

    A bound outside the calendar clamps to its first or last day; with ``on_empty="drop"``
    a split that has no day inside its dates is left out instead. Starts leave `lookback - 1` days.
    """
    picks = [F.count(F.lit(1)).cast("int").alias("_days")]
    for split in SPLITS:
        start, end = F.lit(config[f"{split}_start"]).cast("date"), F.lit(config[f"{split}_end"]).cast("date")
        picks.append(F.count_if(F.col("date") < start).cast("int").alias(f"_{split}_start"))
        picks.append((F.count_if(F.col("date") < end) - 1).cast("int").alias(f"_{split}_end"))
    bounds = calendar.agg(*picks)
    last = F.col("_days") - 1

    def clamp(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(c), last))

    def entry(name: str, first: str, final: str) -> Column:
        return F.struct(
            F.lit(name).alias("split"),
            F.greatest(clamp(f"_{first}_start"), F.lit(lookback - 1)).alias("start_idx"),
            clamp(f"_{final}_end").alias("end_idx"),
            (F.col(f"_{first}_start") <= F.col(f"_{final}_end")).alias("_has_days"),
        )

    rows = [entry(s, s, s) for s in SPLITS] + [entry("train_valid", "train", "valid")]
    out = bounds.select(F.inline(F.array(*rows)))
    if on_empty == "drop":
        out = out.where("_has_days")
    return out.drop("_has_days")


def split_days(calendar: DataFrame, ranges: DataFrame) -> DataFrame:
    """(date, td_idx, split): the days of train, valid and test. Days of overlapping splits appear in each."""
    days = ranges.where(F.col("split").isin(*SPLITS) & (F.col("start_idx") <= F.col("end_idx"))).select(
        "split", F.explode(F.sequence("start_idx", "end_idx")).alias("td_idx")
    )
    return calendar.select("date", "td_idx").join(days, "td_idx")


def with_split(df: DataFrame, calendar: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the three splits, tagged. The day table is bounded by the calendar, so it is broadcast."""
    return df.join(F.broadcast(split_days(calendar, ranges).select("date", "split")), "date")


def day_slice(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("td_idx").between(first, last))
