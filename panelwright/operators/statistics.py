"""Panel and label statistics kept by year: stored partial states that merge into what a full scan would find.

Counts, extremes and squared deviations merge by sums, minima and the usual correction for unlike means. Quantiles stay exact: a state
counts the first digit of each value (`ranks.value_digits`), which says in which few digits the wanted positions lie, and only
the value counts of those digits are read. When a year is added or corrected its own rows are read, and its own states replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelwright.functions.missing import is_finite, is_missing
from panelwright.functions.schema import BOOLEAN_STATUS_FIELDS
from panelwright.operators.profiles import LARGE_RETURNS, REPORTED_QUANTILES
from panelwright.operators.quality import STATE_FIELDS, findings_of
from panelwright.operators.ranks import value_digits

# What the states of a target hold, in tables that may have no row yet.
MOMENTS = ", ".join(["n bigint, k bigint, mean double, squares double, low double, high double", *[f"{name} bigint" for name in LARGE_RETURNS], "year int"])
DIGITS = "digit bigint, n bigint, year int"
VALUES = "value double, n bigint, digit bigint, year int"


def _store(df: DataFrame, path: str, order: Sequence[str] = (), cells: int = 16) -> None:
    """Replace the years that df holds. With an order, a year's rows are dealt over cells of its first column, each cell one sorted file."""
    dealt = df.repartition("year", F.pmod(F.xxhash64(order[0]), F.lit(cells))).sortWithinPartitions("year", *order) if order else df.repartition("year")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def _years(rows: DataFrame, years: Sequence[int] | None) -> DataFrame:
    if "year" not in rows.columns:
        rows = rows.withColumn("year", F.year("date"))
    return rows if years is None else rows.where(F.col("year").isin(*years))


# --- panels --------------------------------------------------------------------------------


def panel_states(panel: DataFrame) -> DataFrame:
    """(year, kind, name, n, low, high): rows, true flags, states and the span of the missing ratio, each a few rows a year."""
    ratio = F.col("status.factor_missing_ratio").cast("double")
    none = F.lit(None).cast("double")
    # The panel is read once: by year and combination of states, of which there are few; all else is counted on those.
    combined = panel.groupBy("year", *[F.col(f"status.{s}").alias(s) for s in STATE_FIELDS]).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ratio).alias("low"), F.max(ratio).alias("high"), *[F.count_if(F.col(f"status.{f}")).alias(f) for f in BOOLEAN_STATUS_FIELDS])
    items = [("rows", F.lit(""), F.col("rows"), none, none), ("ratio", F.lit(""), F.lit(0).cast("long"), F.col("low"), F.col("high")),
             *[("flag", F.lit(f), F.col(f), none, none) for f in BOOLEAN_STATUS_FIELDS], *[(s, F.col(s), F.col("rows"), none, none) for s in STATE_FIELDS]]
    named = [F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.alias("n"), low.alias("low"), high.alias("high")) for kind, name, n, low, high in items]
    each = combined.select("year", F.inline(F.array(*named)))
    return each.groupBy("year", "kind", "name").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def update_panel_states(panel: DataFrame, path: str, years: Sequence[int] | None = None) -> None:
    """Put the states of the given years (by default all) of a panel in place of those stored. A panel stored by year is read for those years only."""
    _store(panel_states(_years(panel, years)), path)


def merged_findings(states: DataFrame) -> DataFrame:
    """`quality.sanity_findings` of the whole panel from its years' states."""
    def count(kind: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("n"))), F.lit(0))

    facts = states.agg(
        count("rows", "").alias("n"), *[count("flag", f).alias(f) for f in BOOLEAN_STATUS_FIELDS],
        *[F.collect_set(F.when(F.col("kind") == s, F.col("name"))).alias(s) for s in STATE_FIELDS],
        F.min("low").alias("lo"), F.max("high").alias("hi"))
    return findings_of(facts)


def merged_histogram(states: DataFrame, state: str = "sample_state") -> DataFrame:
    """`quality.state_histogram` of the whole panel."""
    counts = states.where(F.col("kind") == state).groupBy(F.col("name").alias("state")).agg(F.sum("n").alias("n"))
    return counts.select("state", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


# --- labels --------------------------------------------------------------------------------


def update_target_states(target: DataFrame, path: str, years: Sequence[int] | None = None) -> None:
    """States of the valid labels of (date, sid, label): moments, counts by first digit, and counts by value sorted by digit."""
    rows = _years(target, years).where("label.valid").select("year", F.col("label.value").cast("double").alias("value"))
    x = F.when(~is_missing(F.col("value")), F.col("value"))
    moments = rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("k"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("low"), F.max(x).alias("high"),
        *[F.count_if(F.abs("value") > limit).alias(name) for name, limit in LARGE_RETURNS.items()])
    _store(moments, f"{path}/moments")
    finite = rows.where(is_finite(F.col("value")))
    values = finite.groupBy("year", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("digit", value_digits(F.col("value"), double_precision=False)[0].cast("long"))
    _store(values, f"{path}/values", ["digit", "value"])
    counted = target.sparkSession.read.schema(VALUES).parquet(f"{path}/values")
    counted = counted.where(F.col("year").isin(*years)) if years is not None else counted
    _store(counted.groupBy("year", "digit").agg(F.sum("n").alias("n")), f"{path}/digits", ["digit"])


def _quantiles(spark: SparkSession, path: str, wanted: Mapping[str, float]) -> dict[str, float | None]:
    """Linearly interpolated quantiles. Two positions a quantile, so at most twice as many digits, come to the driver."""
    digits = spark.read.schema(DIGITS).parquet(f"{path}/digits").groupBy("digit").agg(F.sum("n").alias("n"))
    running = digits.withColumn("upto", F.sum("n").over(W.orderBy("digit")))  # a row a digit: 2 * 2,124 * 1,026 of them at most
    total = digits.agg(F.sum("n")).first()[0]
    if not total:
        return dict.fromkeys(wanted)
    places = sorted({place for p in wanted.values() for place in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    at = F.explode(F.array(*[F.lit(place).cast("long") for place in places])).alias("place")
    spots = running.select("digit", "n", "upto", at).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    found = [(r["digit"], r["place"], r["place"] - (r["upto"] - r["n"])) for r in spots.collect()]
    values = spark.read.schema(VALUES).parquet(f"{path}/values").where(F.col("digit").isin(*{d for d, _, _ in found})).groupBy("digit", "value").agg(F.sum("n").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(W.partitionBy("digit").orderBy("value")))
    table = spark.createDataFrame(found, "digit long, place long, inside long")
    hits = upto.join(F.broadcast(table), "digit").where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    value = {r["place"]: r["value"] for r in hits.select("place", "value").collect()}
    out = {}
    for name, p in wanted.items():
        low, high = value[math.floor(p * (total - 1))], value[math.ceil(p * (total - 1))]
        out[name] = low + (high - low) * (p * (total - 1) - math.floor(p * (total - 1)))
    return out


def merged_profile(spark: SparkSession, path: str, wanted: Mapping[str, float] = REPORTED_QUANTILES) -> DataFrame:
    """`profiles.regression_profile` of the whole target from its years' states."""
    years = spark.read.schema(MOMENTS).parquet(f"{path}/moments")
    whole = years.agg((F.sum(F.col("k") * F.col("mean")) / F.sum("k"))).scalar()
    spread = F.sum("squares") + F.sum(F.col("k") * F.pow(F.col("mean") - whole, F.lit(2.0)))
    row = years.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("k") * F.col("mean")) / F.sum("k")).alias("mean"),
        F.sqrt(F.try_divide(spread, F.sum("k") - 1)).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"),
        (F.sum("n") - F.sum("k")).alias("n_missing"), *[F.sum(name).alias(name) for name in LARGE_RETURNS])
    return row.select("*", *[F.lit(v).cast("double").alias(name) for name, v in _quantiles(spark, path, wanted).items()])
