"""Label and view reports as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.missing import is_missing
from panelwright.operators.cross_section import per_day
from panelwright.operators.ranks import quantiles
from panelwright.operators.staging import stage

# Reported quantiles and the return sizes counted as large.
REPORTED_QUANTILES = {"q01": 0.01, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q99": 0.99}
LARGE_RETURNS = {"over_10pct": 0.10, "over_20pct": 0.20}


def _opened(target: DataFrame) -> DataFrame:
    return target.select("date", "sid", "label.value", "label.valid", "label.reason")


def _valid_values(target: DataFrame) -> DataFrame:
    return _opened(target).where("valid")


def _share(n: Column | str = "n") -> Column:
    """Share of an already grouped table of a few rows (reasons, states, classes)."""
    n = F.col(n) if isinstance(n, str) else n
    return n / F.sum(n).over(W.partitionBy())


def _beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side: each other row comes in as a scalar subquery."""
    for i, other in enumerate(others):
        row = row.withColumn(f"_row{i}", other.select(F.struct(*other.columns)).scalar())
    return row.select("*", *[f"_row{i}.*" for i in range(len(others))]).drop(*[f"_row{i}" for i in range(len(others))])


def target_summary(target: DataFrame) -> DataFrame:
    rows = _opened(target).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("n_valid"))
    return rows.select(
        "total",
        "n_valid",
        (F.col("total") - F.col("n_valid")).alias("n_invalid"),
        F.try_divide("n_valid", "total").alias("valid_share"),
    )


def target_reasons(target: DataFrame) -> DataFrame:
    """(reason, n, share_of_invalid, share_of_total) of invalid rows."""
    counts = _opened(target).groupBy("valid", "reason").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share_of_total", _share()).where("not valid").withColumn("share_of_invalid", _share())
    return shares.select("reason", "n", "share_of_invalid", "share_of_total").orderBy(F.desc("n"), "reason")


def regression_profile(target: DataFrame) -> DataFrame:
    """Moments, exact quantiles and counts of large values of the valid labels, one row."""
    rows = stage(_valid_values(target).select("value"))
    x = F.col("value").cast("double")
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count_if(is_missing(x)).alias("n_missing"),
        *[F.count_if(F.abs(x) > limit).alias(name) for name, limit in LARGE_RETURNS.items()],
    )
    return _beside(stats, quantiles(rows, [], "value", REPORTED_QUANTILES))


def class_distribution(target: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """(class, name, n, share) of the valid labels."""
    counts = _valid_values(target).groupBy(F.col("value").cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return counts.select(
        "class", F.coalesce(F.try_element_at(lookup, F.col("class")), F.lit("—")).alias("name"), "n", _share().alias("share")
    )


def _yearly_counts(target: DataFrame) -> DataFrame:
    rows = _opened(target).withColumn("year", F.year("date"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("n_valid")).withColumn(
        "valid_rate", F.col("n_valid") / F.col("total")
    )


def regression_by_year(target: DataFrame) -> DataFrame:
    target = stage(target)
    rows = _valid_values(target).select(F.year("date").alias("year"), "value")
    x = F.col("value").cast("double")
    stats = rows.groupBy("year").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    median = quantiles(rows, ["year"], "value", {"median": 0.5})
    return _yearly_counts(target).join(stats, "year", "left").join(median, "year", "left")


def classes_by_year(target: DataFrame, classes: list[int]) -> DataFrame:
    """Counts and shares per class and year, one column pair per class."""
    rows = _opened(target).withColumn("year", F.year("date"))
    hits = [F.count_if(F.col("valid") & (F.col("value") == c)).alias(f"class_{c}") for c in classes]
    joined = rows.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("n_valid"), *hits)
    joined = joined.withColumn("valid_rate", F.col("n_valid") / F.col("total"))
    shares = {
        f"share_{c}": F.coalesce(F.try_divide(F.col(f"class_{c}"), F.col("n_valid")), F.lit(0.0)) for c in classes
    }
    return joined.withColumns(shares)


def target_findings(target: DataFrame, task_type: str) -> DataFrame:
    """(check, level, figure): valid rate, missing among valid, and class balance or extreme share."""
    rows = _opened(target)
    x = F.col("value").cast("double")
    facts = rows.agg(
        F.try_divide(F.count_if("valid"), F.count(F.lit(1))).alias("rate"),
        F.count_if(F.col("valid") & is_missing(x)).cast("double").alias("missing"),
        F.try_divide(F.count_if(F.col("valid") & (F.abs(x) > 1.0)), F.count_if("valid")).alias("extreme"),
    )
    checks = [
        ("valid_rate", F.when(F.col("rate") < 0.5, "WARNING").otherwise("OK"), F.col("rate")),
        ("missing_in_valid", F.when(F.col("missing") > 0, "ERROR").otherwise("OK"), F.col("missing")),
    ]
    if task_type == "classification":
        counts = rows.where("valid").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        balance = counts.agg(F.max("n") / F.min("n")).scalar()
        facts = facts.withColumn("balance", balance)
        checks.append(("class_balance", F.when(F.col("balance") > 10, "WARNING").otherwise("OK"), F.col("balance")))
    else:
        checks.append(("extreme_share", F.when(F.col("extreme") > 0.01, "WARNING").otherwise("OK"), F.col("extreme")))
    items = [F.struct(F.lit(c).alias("check"), level.alias("level"), fig.alias("figure")) for c, level, fig in checks]
    # A check without valid labels has no figure and is not reported.
    return facts.select(F.inline(F.array(*items))).where(F.col("figure").isNotNull())


def _daily_view(view: DataFrame) -> DataFrame:
    return view.groupBy("date").agg(
        F.count_if("present").alias("present"),
        F.count_if("ret_mask").alias("ret_valid"),
        F.count_if("mom_mask").alias("mom_valid"),
        F.count_if("both_mask").alias("both_valid"),
    )


def view_report(view: DataFrame, calendar: DataFrame, n_features: int) -> DataFrame:
    """One row on an encoded view: axes, cells, coverage, label statistics.

    Cell counts are axis products; the cells themselves are never built.
    """
    flags = F.aggregate(F.slice("x", n_features + 1, n_features), F.lit(0.0), lambda a, f: a + f.cast("double"))
    rows = stage(
        view.select(
            "date", "sid", "present", "ret_mask", "mom_mask", "both_mask", "y_mom",
            F.when(F.col("ret_mask"), F.col("y_ret")).alias("_ret"),
            (flags / n_features).alias("_missing"),
        )
    )
    daily = calendar.select("date").join(per_day(_daily_view(rows)), "date", "left").fillna(0)
    stats = rows.agg(
        F.count_distinct("sid").alias("n_sids"),
        F.avg(F.when(F.col("present"), F.col("_missing"))).alias("feature_missing_rate"),
        F.avg("_ret").alias("ret_mean"),
        F.stddev_pop("_ret").alias("ret_std"),
        F.min(F.col("_ret").cast("double")).alias("ret_min"),
        F.max(F.col("_ret").cast("double")).alias("ret_max"),
        *[F.count_if(F.col("mom_mask") & (F.col("y_mom") == c)).alias(f"class_{c}") for c in range(5)],
    )
    median = quantiles(rows, [], "_ret", {"ret_median": 0.5})
    days = daily.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("present").alias("present_cells"),
        F.avg("present").alias("avg_present"),
        F.min("present").alias("min_present"),
        F.max("present").alias("max_present"),
        F.sum("ret_valid").alias("ret_valid"),
        F.sum("mom_valid").alias("mom_valid"),
        F.sum("both_valid").alias("both_valid"),
    )
    out = _beside(stats, days, median)
    cells = F.col("n_days") * F.col("n_sids")
    return out.withColumns(
        {
            "total_cells": cells,
            "present_share": F.col("present_cells") / cells,
            "ret_coverage": F.col("ret_valid") / cells,
            "mom_coverage": F.col("mom_valid") / cells,
            "both_coverage": F.col("both_valid") / cells,
        }
    )


def view_by_year(view: DataFrame, calendar: DataFrame) -> DataFrame:
    daily = calendar.select("date").join(per_day(_daily_view(view)), "date", "left").fillna(0)
    return daily.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("present").alias("avg_present"),
        F.sum("ret_valid").alias("ret_valid"),
        F.sum("mom_valid").alias("mom_valid"),
    )
