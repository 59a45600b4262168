"""Model-shaped views of a labelled panel: tabular rows, encoded rows, dense cells, lookback windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.missing import is_missing
from panelwright.operators.staging import spread
from panelwright.functions.schema import encoded_positions, feature_names, select_features

USABLE = "status.sample_usable_for_feature"


def tabular_view(
    panel: DataFrame,
    target: DataFrame | str | None,
    include: str | None = None,
    exclude: str | None = None,
    fundamentals: list[str] | None = None,
) -> DataFrame:
    """(date, sid, td_idx, features, y, y_valid, usable); without a target every label is 0 and invalid.

    The target is a table, joined by key, or the name of a label column of the panel, which then is derived once and joined to nothing.
    """
    names = select_features(feature_names(panel), include, exclude, fundamentals)
    own = [F.col(f"{target}.value").alias("y"), F.coalesce(F.col(f"{target}.valid"), F.lit(False)).alias("y_valid")] if isinstance(target, str) else []
    rows = panel.select(
        "date",
        "sid",
        "td_idx",
        F.array(*[F.col(f"feature.`{n}`").cast("float") for n in names]).alias("features"),
        F.col(USABLE).alias("usable"),
        *own,
    )
    if own:
        return rows.select("date", "sid", "td_idx", "features", "usable", "y", "y_valid")
    if target is None:
        return rows.withColumns({"y": F.lit(0.0).cast("float"), "y_valid": F.lit(False)})
    label = target.select("date", "sid", F.col("label.value").alias("y"), F.col("label.valid").alias("y_valid"))
    return rows.join(label, ["date", "sid"], "left").withColumn("y_valid", F.coalesce("y_valid", F.lit(False)))


def view_metadata(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: feature count and order, rows, days, instruments, date span, label name."""
    return panel.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_distinct("date").alias("n_days"),
        F.count_distinct("sid").alias("n_sids"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ).select(
        "*", F.lit(len(features)).alias("n_features"), F.lit(",".join(features)).alias("feature_order"), F.lit(label).alias("label_name")
    )


def encode_features(values: Column, present: Column) -> Column:
    """[features with missing as 0 | missing flags | row present] as one float array."""
    filled = F.transform(values, lambda x: F.when(is_missing(x), F.lit(0.0)).otherwise(x).cast("float"))
    flags = F.transform(values, lambda x: is_missing(x).cast("float"))
    return F.concat(filled, flags, F.array(present.cast("float")))


def encoded_view(
    panel: DataFrame, regression: DataFrame | str | None, classification: DataFrame | str | None,
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """(date, sid, td_idx, x, present, y_ret, y_mom, ret_mask, mom_mask, both_mask) for panel rows.

    Targets are tables, joined by key, or names of label columns of the panel, as `build_targets` keeps them beside its rows.
    """
    names = select_features(feature_names(panel), include, exclude)
    values = F.array(*[F.col(f"feature.`{n}`").cast("float") for n in names])
    # A row without a factor record is absent features, each flagged as missing.
    present = F.col(USABLE)
    wanted = ((regression, "_ret", "ret_mask"), (classification, "_mom", "mom_mask"))
    own = [c for target, value, mask in wanted if isinstance(target, str)
           for c in (F.col(f"{target}.value").alias(value), F.coalesce(F.col(f"{target}.valid"), F.lit(False)).alias(mask))]
    rows = panel.select("date", "sid", "td_idx", encode_features(values, present).alias("x"), present.alias("present"), *own)
    for target, value, mask in wanted:
        if target is None:
            rows = rows.withColumns({value: F.lit(None).cast("float"), mask: F.lit(False)})
        elif not isinstance(target, str):
            block = target.select(
                "date", "sid", F.col("label.value").alias(value), F.col("label.valid").alias(mask)
            )
            rows = rows.join(block, ["date", "sid"], "left").withColumn(mask, F.coalesce(mask, F.lit(False)))
    return rows.select(
        "date",
        "sid",
        "td_idx",
        "x",
        "present",
        F.when(is_missing(F.col("_ret")), 0.0).otherwise(F.col("_ret")).cast("float").alias("y_ret"),
        F.when(F.col("mom_mask"), F.col("_mom")).otherwise(-1).cast("byte").alias("y_mom"),
        "ret_mask",
        "mom_mask",
        (F.col("ret_mask") & F.col("mom_mask")).alias("both_mask"),
    )


def keep_encoded(x: Column, names: list[str], include: str | None = None, exclude: str | None = None) -> Column:
    """Train-time feature subset of an encoded row: chosen features, their flags, the present flag."""
    positions = encoded_positions(names, include, exclude)
    if positions is None:
        return x
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.get(x, p))


def dense_cells(view: DataFrame, calendar: DataFrame, width: int) -> DataFrame:
    """Every (day, instrument) cell; cells without a panel row are zeros with class -1 and masks off.

    The cells are the output here. Each instrument expands the day numbers and the view is
    left-joined by key, so the work is spread over instruments.
    """
    n_days = calendar.agg(F.count(F.lit(1))).scalar()
    axis = (
        spread(view.select("sid").distinct(), "sid")
        .withColumn("td_idx", F.explode(F.sequence(F.lit(0), (n_days - 1).cast("int"))))
        .join(F.broadcast(calendar.select("date", "td_idx")), "td_idx")
    )
    joined = axis.join(view.drop("td_idx"), ["date", "sid"], "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    off = F.lit(False)
    return joined.select(
        "date",
        "sid",
        "td_idx",
        F.coalesce("x", zeros).alias("x"),
        F.coalesce("present", off).alias("present"),
        F.coalesce("y_ret", F.lit(0.0).cast("float")).alias("y_ret"),
        F.coalesce("y_mom", F.lit(-1).cast("byte")).alias("y_mom"),
        *[F.coalesce(m, off).alias(m) for m in ("ret_mask", "mom_mask", "both_mask")],
    )


def halo_rows(view: DataFrame, lookback: int, span: int) -> DataFrame:
    """Rows dealt into blocks of `span` days by `_block`. The last lookback - 1 days of a block also go to the next one, so that every window
    lies within the block of its last day: a row is there twice at most."""
    if span < lookback - 1:
        raise ValueError("a block must be as long as the days that the next one looks back on")
    block, late = F.floor(F.col("td_idx") / span).cast("int"), F.pmod(F.col("td_idx"), F.lit(span)) >= span - (lookback - 1)
    return view.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))


def lookback_windows(view: DataFrame, sampled: DataFrame, lookback: int, width: int, span: int | None = None, few: bool = False) -> DataFrame:
    """For each sampled (date, sid), given once: the `lookback` encoded rows ending that day, oldest first.

    Days without a panel row are zero vectors; the first lookback - 1 days yield nothing. Where `sampled` carries td_idx,
    a sampled instrument without a panel row that day yields a window too, with its masks off.
    An instrument's days are cut into blocks of `span` days (by default `lookback`) with a halo of the lookback - 1 days before. Only blocks with a sampled day are
    moved, each vector twice at most whatever the lookback, and all windows of a block are cut from one array. With `few`, the caller vouches that the sampled blocks are
    so few that their keys may be broadcast (k a day are bounded by the calendar); then vectors of other blocks are dropped where they lie.
    """
    span = span or max(lookback, 1)
    if "td_idx" not in sampled.columns:
        sampled = sampled.select("date", "sid").join(view.select("date", "sid", "td_idx"), ["date", "sid"])
    key = ["sid", "_block"]
    ends = sampled.where(F.col("td_idx") >= lookback - 1).select("sid", F.floor(F.col("td_idx") / span).cast("int").alias("_block"), "date", F.col("td_idx").alias("end"))
    ends = ends.groupBy(*key).agg(F.collect_list(F.struct("date", "end")).alias("_ends"))
    absent = {"present": F.lit(False), "y_ret": F.lit(0.0).cast("float"), "y_mom": F.lit(-1).cast("byte"),
              "ret_mask": F.lit(False), "mom_mask": F.lit(False), "both_mask": F.lit(False)}
    rows = halo_rows(view.select("sid", "td_idx", "x", *absent), lookback, span).join(F.broadcast(ends.select(*key)) if few else ends.select(*key), key, "left_semi")
    held = rows.groupBy(*key).agg(F.collect_list(F.struct("td_idx", F.struct("x", *absent).alias("row"))).alias("_rows"))
    # The block's days from the first of the halo on, empty where there is no panel row.
    days = F.sequence(F.col("_block") * span - (lookback - 1), (F.col("_block") + 1) * span - 1)
    by_day = F.map_from_entries(F.coalesce("_rows", F.array().cast(held.schema["_rows"].dataType)))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)

    def cut(block: Column) -> Column:
        def one(e: Column) -> Column:
            start = e["end"] - F.col("_block") * span
            own = F.get(block, start + (lookback - 1))
            window = F.transform(F.slice(block, start + 1, lookback), lambda r: F.coalesce(r["x"], zeros))
            return F.struct(e["date"].alias("date"), e["end"].alias("td_idx"), *[F.coalesce(own[c], none).alias(c) for c, none in absent.items()], window.alias("window"))

        return F.transform("_ends", one)

    # The block goes in as the one item of an array, so that it is put together once and not once a window.
    block = F.get(F.transform(F.array(by_day), lambda m: F.transform(days, lambda d: F.try_element_at(m, d))), F.lit(0))
    cuts = F.get(F.transform(F.array(block), cut), F.lit(0))
    return ends.join(held, key, "left").select("sid", F.inline(cuts)).select("date", "sid", "td_idx", *absent, "window")
