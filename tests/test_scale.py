"""Plans and skew: what must hold when a day, a key or a value is most of the data."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from panelwright.operators import cross_section as xs, ranks, views
from panelwright.operators.staging import stage, staging_dir
from panelwright.plans import fixtures
from panelwright.sources import feeds

DAY = dt.date(2024, 1, 1)


@contextlib.contextmanager
def settings(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feed_aggregates_join_the_panel_without_another_shuffle(spark):
    with settings(spark, **NO_BROADCAST):
        p = fixtures.supplier_tables(spark, "/root/testdata/sf0.001").panel
        plan = plan_of(p)
    assert plan.count("SortMergeJoin") == 2
    keyed = [line for line in plan.split("\n") if "Exchange hashpartitioning(date" in line and ", sid" in line]
    assert len(keyed) == 3  # the index and one partial aggregate per feed


def test_keep_first_combines_before_shuffling(spark):
    df = spark.range(1000).select(F.lit(DAY).alias("date"), F.lit("a").alias("sid"), F.col("id").alias("seq"), F.rand(1).alias("x"))
    plan = plan_of(feeds.keep_first(df, ["date", "sid"], ["seq"]))
    assert "partial_min_by" in plan and "Window" not in plan


def test_open_and_close_are_hash_aggregates(spark):
    plan = plan_of(fixtures.supplier_bars(spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_lookback_reads_vectors_of_sampled_days_only(spark):
    cells = spark.range(4_000).select(
        F.expr("date_add(DATE'2024-01-01', CAST(id % 40 AS INT))").alias("date"), F.floor(F.col("id") / 40).cast("string").alias("sid"), (F.col("id") % 40).cast("int").alias("td_idx"),
        F.array(F.col("id").cast("float")).alias("x"), F.lit(True).alias("present"), F.lit(0.5).cast("float").alias("y_ret"), F.lit(1).cast("byte").alias("y_mom"),
        *[F.lit(True).alias(m) for m in ("ret_mask", "mom_mask", "both_mask")])
    sampled = cells.where("sid = '7' and td_idx >= 30").select("date", "sid", "td_idx")
    windows = views.lookback_windows(cells, sampled, 5, 1)
    assert "Window" not in plan_of(windows)
    got = {r["td_idx"]: [x[0] for x in r["window"]] for r in windows.collect()}
    assert got == {t: [float(280 + u) for u in range(t - 4, t + 1)] for t in range(30, 40)}


def test_lookback_moves_a_vector_twice_at_most(spark):
    cells = spark.range(4_000).select((F.col("id") % 400).cast("int").alias("td_idx"), F.floor(F.col("id") / 400).cast("string").alias("sid"))
    for lookback, span in ((60, 60), (60, 240), (5, 4), (1, 1)):
        dealt = views.halo_rows(cells, lookback, span)
        assert dealt.count() <= 4_000 * (1 + (lookback - 1) / span) + 10 * lookback <= 2 * 4_000 + 10 * lookback
        # Every window of the last days of a block lies in it.
        assert dealt.groupBy("sid", "_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= span + lookback - 1
    with pytest.raises(ValueError):
        views.halo_rows(cells, 60, 30)


def test_top_k_prunes_in_map_tasks(spark):
    df = stage(spark.range(1000).select(F.lit(DAY).alias("date"), F.col("id").cast("string").alias("sid"), F.rand(1).alias("x")))
    plan = plan_of(ranks.top_k(df, ["date"], [F.col("x").desc()], 20))
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") == 2


def skewed(spark, n=60000):
    """One day; a third of its rows share one value and a third have none."""
    value = F.when(F.col("id") % 3 == 0, F.lit(0.0)).when(F.col("id") % 3 == 1, F.col("id") / 7)
    return stage(spark.range(n).select(F.lit(DAY).alias("date"), F.col("id").cast("string").alias("sid"), value.alias("x")).repartition(6, "sid"))


def test_missing_values_spread_over_tasks(spark):
    df = skewed(spark)
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", **NO_BROADCAST):
        out = ranks.attach_ranks(df, ranks.value_ranks(df, ["date"], "x"), ["date"], "x", {"r": ranks.average_rank()})
        counted = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("x").isNull()).alias("n"), F.sum("r").alias("r"))
        assert "SortMergeJoin" in plan_of(counted)
        sizes = [r["n"] for r in counted.collect()]
        assert len(sizes) >= 8 and sum(sizes) == 20000 and max(sizes) < 2 * 20000 / 8


def test_hot_value_is_split_by_adaptive_execution(spark):
    df = skewed(spark)
    with settings(
        spark, spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20k", spark__sql__adaptive__advisoryPartitionSizeInBytes="10k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5", **NO_BROADCAST,
    ):
        out = xs.relevance_bins(df, "x", 10)
        rows = out.groupBy("relevance").agg(F.count(F.lit(1)).alias("n"), F.max("sid"))
        got = {r["relevance"]: r["n"] for r in rows.collect()}
        assert "skew=true" in rows._jdf.queryExecution().toString()
    assert sum(got.values()) == 60000


def test_hot_ties_are_numbered_in_cells(spark):
    df = skewed(spark, 6000)
    out = ranks.ordinal_positions(df, ["date"], "x", "pos")
    placed = out.where("x is not null").select("pos").orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(4000))
    assert out.where("x = 0").agg(F.max("pos")).first()[0] == 1999


def test_staged_tables_live_in_the_configured_folder(spark):
    folder = staging_dir(spark)
    staged = stage(spark.range(3).toDF("x"))
    assert folder is None or f"{folder.removeprefix('file:').rstrip('/')}/stage-" in staged.inputFiles()[0]
    assert staged.schema.names == ["x"] and staged.count() == 3


def test_sampling_orders_only_cells_that_reach_the_sample(spark, monkeypatch):
    rows = stage(spark.range(40_000).select(F.expr("date_add(DATE'2024-01-01', CAST(id % 2 AS INT))").alias("date"), F.col("id").cast("string").alias("sid"),
                                            ((F.col("id") % 2 == 0) & (F.col("id") < 20)).alias("present")))
    ordered, top_k = [], xs.top_k
    monkeypatch.setattr(xs, "top_k", lambda df, *rest: ordered.append(df.count()) or top_k(df, *rest))
    got = {(str(r["date"]), r["sid"]): r["sample_pos"] for r in xs.sample_per_day(rows, 300, "present").collect()}
    monkeypatch.undo()
    assert 600 <= ordered[0] < 2_000  # of 40,000
    for d in ("2024-01-01", "2024-01-02"):
        day = [(not r["present"], hashlib.md5(f"42|{d}|{r['sid']}".encode()).hexdigest(), r["sid"]) for r in rows.where(F.col("date") == d).collect()]
        assert {s: p for p, (_, _, s) in enumerate(sorted(day)[:300])} == {s: p for (x, s), p in got.items() if x == d}


def test_vectors_of_blocks_without_a_sample_are_dropped_where_they_lie(spark):
    cells = stage(spark.range(4_000).select(
        F.expr("date_add(DATE'2024-01-01', CAST(id % 40 AS INT))").alias("date"), F.floor(F.col("id") / 40).cast("string").alias("sid"), (F.col("id") % 40).cast("int").alias("td_idx"),
        F.array(F.col("id").cast("float")).alias("x"), F.lit(True).alias("present"), F.lit(0.5).cast("float").alias("y_ret"), F.lit(1).cast("byte").alias("y_mom"),
        *[F.lit(True).alias(m) for m in ("ret_mask", "mom_mask", "both_mask")]))
    sampled = cells.where("sid = '7' and td_idx >= 30").select("date", "sid", "td_idx")
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(views.lookback_windows(cells, sampled, 5, 1, few=True))
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
        few, many = ({r["td_idx"]: r["window"] for r in views.lookback_windows(cells, sampled, 5, 1, few=f).collect()} for f in (True, False))
    assert few == many and len(few) == 10


def test_suppliers_bars_and_factors_come_from_one_aggregate(spark):
    t = fixtures.supplier_tables(spark, "/root/testdata/sf0.001")
    for rows in (t.recorded, t.series):
        plan = plan_of(rows.select("date", "sid", "market", "feature", "status"))
        assert plan.count("Exchange hashpartitioning(date") == 1 and "FullOuter" not in plan
    apart = fixtures.side_by_side(t.daily, t.factors)
    assert sorted(map(repr, t.records.select(apart.columns).collect())) == sorted(map(repr, apart.collect()))
    bars = fixtures.supplier_bars(spark, "/root/testdata/sf0.001")
    master = fixtures.instrument_master(bars, calendar=fixtures.trading_calendar(bars))
    assert sorted(map(repr, t.master.collect())) == sorted(map(repr, master.collect()))
    assert "partial_min_by" not in plan_of(t.master) and sorted(t.calendar.collect()) == sorted(fixtures.trading_calendar(bars).collect())


def test_readers_of_few_fields_aggregate_those_alone(spark):
    rows = fixtures.supplier_tables(spark, "/root/testdata/sf0.001").recorded
    plan = plan_of(rows.select("date", "sid", "market.close", "feature", "status.sample_usable_for_feature"))
    assert "max_by(price" in plan and "min_by(price" not in plan and "sum(l_quantity" not in plan
