"""Per-day cross-sections: relevance bins, normalisation, group filters, sampling, rank metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.missing import clip_abs, is_finite
from panelwright.operators.staging import stage
from panelwright.operators.ranks import attach_ranks, average_rank, dense_codes, ordinal_positions, top_k, value_ranks

DAY = ["date"]

# Fixed value: keeps the Pearson form defined on constant days, which then count as zero.
CORRELATION_EPS = 1e-12


def per_day(df: DataFrame) -> DataFrame:
    """Mark a one-row-per-day table for broadcasting: it has at most 366 rows a year."""
    return F.broadcast(df)


def day_keys(df: DataFrame) -> list[str]:
    """What names a day of a table: the date, and the split where rows carry one, since splits may overlap."""
    return ["split", *DAY] if "split" in df.columns else DAY


def group_sizes(df: DataFrame, by: Sequence[str] = DAY) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"))


def drop_small_groups(df: DataFrame, min_group_size: int, by: Sequence[str] = DAY) -> DataFrame:
    """Rows of days with at least `min_group_size` rows. A count and a semi-join, not a window per day."""
    if min_group_size <= 1:
        return df
    large = group_sizes(df, by).where(F.col("group_size") >= min_group_size)
    return df.join(per_day(large), list(by), "left_semi")


def _binned(position: Column, n_bins: int) -> Column:
    """Clip to 0 .. n_bins - 1; NULL stays NULL (greatest and least would skip it)."""
    return F.when(position.isNotNull(), F.greatest(F.lit(0), F.least(position, F.lit(n_bins - 1)))).cast("int")


def relevance_bins(df: DataFrame, value: str, n_bins: int = 10, name: str = "relevance", by: Sequence[str] = DAY) -> DataFrame:
    """Ordinal label from the average rank inside the day; 0 for missing values, single rows and constant days."""
    share = (average_rank() - 1) / F.greatest(F.lit(1.0), (F.col("group_n") - 1).cast("double"))
    bins = F.when((F.col("group_n") > 1) & (F.col("group_values") > 1), _binned(F.floor(share * n_bins), n_bins))
    out = attach_ranks(df, value_ranks(df, by, value), by, value, {name: bins})
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def relevance_levels(df: DataFrame, value: str, mask: str, n_bins: int = 5, name: str = "relevance") -> DataFrame:
    """Relevance from the descending position among unmasked rows; masked rows get 0."""
    masked = df.withColumn("_ranked", F.when(F.col(mask), F.col(value)))
    placed = ordinal_positions(masked, DAY, "_ranked", "_pos", descending=True)
    valid = df.where(F.col(mask)).groupBy("date").agg(F.count(F.lit(1)).alias("_valid"))
    level = (n_bins - 1) - F.floor(F.col("_pos") / (F.col("_valid") / n_bins))
    return (
        placed.join(per_day(valid), "date", "left")
        .withColumn(name, F.coalesce(_binned(level, n_bins), F.lit(0)))
        .select(*df.columns, name)
    )


def normalise(df: DataFrame, value: str, method: str = "none", name: str | None = None) -> DataFrame:
    """Cross-sectional normalisation of one column: none, rank (0..1, ties low) or zscore."""
    name = name or value
    if method == "none":
        return df.withColumn(name, F.col(value))
    if method == "rank":
        rank = F.when(F.col("group_n") > 1, F.col("before") / (F.col("group_n") - 1)).otherwise(F.lit(0.0))
        out = attach_ranks(df, value_ranks(df, DAY, value), DAY, value, {"_normalised": rank})
    elif method == "zscore":
        finite = F.when(is_finite(F.col(value)), F.col(value).cast("double"))
        stats = df.groupBy("date").agg(F.avg(finite).alias("_mean"), F.stddev_samp(finite).alias("_std"))
        score = F.try_divide(finite - F.col("_mean"), F.col("_std"))
        out = df.join(per_day(stats), "date", "left").withColumn("_normalised", score)
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return out.withColumn(name, F.col("_normalised")).drop("_normalised", "_mean", "_std")


def sample_per_day(df: DataFrame, k: int, present: str, seed: int = 42, instruments: DataFrame | None = None) -> DataFrame:
    """k instruments a day, usable ones first, otherwise in a seeded md5 order; reproducible on any cluster.

    With `instruments` (sid), a day of fewer than k rows is filled to k from the instruments that have no row that day: `present` false,
    other columns null. Days without any row do not appear. df is read twice: pass a stored table.

    Rows are first counted by usability and the first two digits of their draw. The counts say up to which of these 512 cells a day's k first
    rows reach, and only rows of those cells are ordered.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string"), F.col("sid")))
    cell = F.when(F.coalesce(F.col(present), F.lit(False)), 0).otherwise(256) + F.conv(F.substring(draw, 1, 2), 16, 10).cast("int")
    counts = df.groupBy(*DAY, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*DAY).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reach = counts.withColumn("_earlier", earlier).where(F.col("_earlier") < k).groupBy(*DAY).agg(F.max("_cell").alias("_reach"))
    near = df.join(per_day(reach), DAY).where(cell <= F.col("_reach")).drop("_reach")
    order = [F.coalesce(F.col(present), F.lit(False)).desc(), draw.asc(), F.col("sid").asc()]
    chosen = top_k(near, DAY, order, k).withColumnRenamed("top_pos", "sample_pos")
    if instruments is None:
        return chosen
    chosen = stage(chosen)
    fill = _absent_instruments(chosen.select("date", "sid"), instruments, k, seed)
    return chosen.unionByName(fill.withColumn(present, F.lit(False)), allowMissingColumns=True)


def _absent_instruments(held: DataFrame, instruments: DataFrame, k: int, seed: int) -> DataFrame:
    """(date, sid, sample_pos) that bring every short day to k rows.

    The instruments stand in a ring in md5 order; a day walks the ring from a seeded place and skips those it holds. It holds fewer
    than k, so 2k steps find enough: no day meets all instruments.
    """
    keyed = instruments.select("sid", F.concat_ws("|", F.md5("sid"), "sid").alias("_spot")).dropna().distinct()
    ring = stage(keyed.join(dense_codes(keyed, "_spot", "_code"), "_spot").select("sid", "_code"))
    n = ring.agg(F.count(F.lit(1))).scalar()
    short = held.groupBy("date").agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") < k)
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string")))
    start = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(F.lit(2 * k).cast("long"), n) - 1, F.lit(0).cast("long")))
    walk = short.withColumn("_step", F.explode(steps)).withColumn("_code", F.pmod(start + F.col("_step"), n))
    free = walk.join(ring, "_code").join(held, ["date", "sid"], "left_anti")
    place = F.row_number().over(W.partitionBy("date").orderBy("_step"))
    filled = free.withColumn("_place", place).where(F.col("_place") <= k - F.col("_held"))
    return filled.select("date", "sid", (F.col("_held") + F.col("_place") - 1).cast("int").alias("sample_pos"))


def ranking_rows(
    view: DataFrame, min_group_size: int = 30, n_bins: int = 10, clip_y_abs: float = 0.0
) -> DataFrame:
    """Training rows of a ranker: usable and labelled, label clipped, small days dropped, relevance added.

    Days are ranked on a staged (split, date, sid, label) table; the features are joined once at the end. A view tagged by split holds
    a key once in each split that covers its day, and each split is ranked by itself.
    """
    by = day_keys(view)
    usable = view.where(F.col("y_valid") & F.col("usable"))
    narrow = stage(usable.select(*by, "sid", clip_abs(F.col("y"), clip_y_abs).alias("y_raw")))
    ranked = relevance_bins(drop_small_groups(narrow, min_group_size, by), "y_raw", n_bins, by=by)
    return usable.join(ranked, [*by, "sid"])


def _correlation_sums(x: Column, y: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_pairs"),
        F.covar_pop(x, y).alias("_cov"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
    ]


def rank_ic_daily(df: DataFrame, y: str = "y_raw", pred: str = "pred", by: Sequence[str] = DAY) -> DataFrame:
    """Spearman correlation per day, or per split and day, on average ranks of finite pairs.

    Days with fewer than three pairs, or with constant ranks on either side, are left out.
    """
    pairs = stage(df.where(is_finite(F.col(y)) & is_finite(F.col(pred))).select(*by, "sid", y, pred))
    ranked = attach_ranks(pairs, value_ranks(pairs, by, y), by, y, {"_ry": average_rank()})
    ranked = attach_ranks(ranked, value_ranks(pairs, by, pred), by, pred, {"_rp": average_rank()})
    return _rank_correlation(ranked, by)


def rank_ic_of_scores(df: DataFrame, name: str, scores: Column, y: str = "y_raw") -> DataFrame:
    """`rank_ic_daily` by (name, date) for an array of finite scores a row; `name` counts the items from 1.

    The label's ranks are those of the day for every item, so they are found once; only the scores are ranked item by item.
    """
    rows = stage(df.where(is_finite(F.col(y))).select(*DAY, "sid", y, scores.alias("_scores")))
    ranked = attach_ranks(rows, value_ranks(rows, DAY, y), DAY, y, {"_ry": average_rank()})
    each = ranked.select(*DAY, "sid", "_ry", F.posexplode("_scores").alias("_before", "_score"))
    each = stage(each.select((F.col("_before") + 1).alias(name), *DAY, "sid", "_ry", "_score"))
    by = [name, *DAY]
    return _rank_correlation(attach_ranks(each, value_ranks(each, by, "_score"), by, "_score", {"_rp": average_rank()}), by)


def _rank_correlation(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    stats = ranked.groupBy(*by).agg(*_correlation_sums(F.col("_ry"), F.col("_rp")))
    ic = F.try_divide(F.col("_cov"), F.sqrt("_vx") * F.sqrt("_vy"))
    return stats.where("n_pairs >= 3").select(*by, "n_pairs", ic.alias("rank_ic")).where("rank_ic is not null")


def rank_ic_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, their ratio and the number of days, optionally per split."""
    stats = daily.groupBy(*by).agg(
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.count("rank_ic").alias("rank_ic_n_days"),
    )
    ratio = F.when(F.col("rank_ic_std") > 0, F.col("rank_ic_mean") / F.col("rank_ic_std"))
    return stats.withColumn("rank_ic_ir", ratio)


def ic_daily(df: DataFrame, y: str, pred: str, mask: str) -> DataFrame:
    """Pearson IC and ordinal-rank IC per day over masked rows; days with fewer than two rows are left out."""
    rows = df.where(F.col(mask)).select("date", "sid", F.col(y).alias("_y"), F.col(pred).alias("_p"))
    rows = ordinal_positions(ordinal_positions(rows, DAY, "_y", "_oy"), DAY, "_p", "_op")

    def pearson(x: str, z: str) -> Column:
        spread = F.sqrt(F.var_pop(x) + CORRELATION_EPS) * F.sqrt(F.var_pop(z) + CORRELATION_EPS)
        return F.covar_pop(x, z) / (spread + CORRELATION_EPS)

    stats = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), pearson("_p", "_y").alias("ic"), pearson("_op", "_oy").alias("rank_ic")
    )
    return stats.where("n_rows >= 2")
