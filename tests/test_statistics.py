"""States by year against full scans; stores whose years are replaced; one-pass moments; duplicates found by position."""

from __future__ import annotations

import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from panelwright.functions.missing import is_missing
from panelwright.operators import labels, panel, profiles, quality, screening, statistics
from panelwright.plans import fixtures
from panelwright.sources import feeds, tables
from tests.test_scale import plan_of, settings

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(folder, **years):
    return {p: p.stat().st_mtime_ns for y in years.values() for p in (folder / f"year={y}").glob("*.parquet")}


def same(a, b):
    got, want = a.collect(), b.select(*a.columns).collect()
    assert len(got) == len(want) == 1
    for x, y in zip(got[0], want[0]):
        assert x == pytest.approx(y, rel=1e-12) if isinstance(y, float) else x == y


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    t = fixtures.supplier_tables(spark, SF)
    tables.write_panel(t.panel, str(folder / "panel"))
    panel = spark.read.parquet(str(folder / "panel"))
    tables.write_panel(labels.build_target(panel, t.calendar, "return_5d"), str(folder / "target"))
    return folder, panel, spark.read.parquet(str(folder / "target"))


def test_panel_states_merge_to_a_full_scan(spark, store, tmp_path):
    _, panel, _ = store
    years = sorted(r["year"] for r in panel.select("year").distinct().collect())
    path = str(tmp_path / "states")
    statistics.update_panel_states(panel, path, years[:-1])
    before = files(tmp_path / "states", first=years[0])
    statistics.update_panel_states(panel, path, years[-1:])
    assert files(tmp_path / "states", first=years[0]) == before and before
    states = spark.read.parquet(path)
    assert rows_of(statistics.merged_findings(states)) == rows_of(quality.sanity_findings(panel))
    assert rows_of(statistics.merged_histogram(states)) == rows_of(quality.state_histogram(panel))
    with settings(spark, spark__sql__maxMetadataStringLength="100000"):
        assert "(year#" in plan_of(statistics.panel_states(panel.where("year = 1996"))).split("PartitionFilters: [")[1].split("]")[0]
    empty = statistics.panel_states(panel.where("false"))
    assert rows_of(statistics.merged_findings(empty)) == rows_of(quality.sanity_findings(panel.where("false")))


def test_target_states_merge_to_a_full_scan(spark, store, tmp_path):
    _, _, target = store
    years = sorted(r["year"] for r in target.select("year").distinct().collect())
    path = str(tmp_path / "states")
    statistics.update_target_states(target, path, years[:-1])
    before = files(tmp_path / "states" / "values", first=years[0])
    statistics.update_target_states(target, path, years[-1:])
    statistics.update_target_states(target, path, years[-1:])  # a repeated job changes nothing
    assert files(tmp_path / "states" / "values", first=years[0]) == before and before
    same(statistics.merged_profile(spark, path), profiles.regression_profile(target))


@pytest.mark.parametrize("values", [[], [1.5], [0.0, 0.0, -0.0, 2.0], [None, float("nan"), 3.0, -4.0], [float(i) / 7 for i in range(-40, 41)] * 2])
def test_states_of_odd_labels(spark, tmp_path, values):
    rows = [(f"{1995 + i % 3}-01-{i % 28 + 1:02d}", f"s{i}", (v, True, "")) for i, v in enumerate(values)] + [("1996-02-01", "x", (None, False, "why"))]
    target = spark.createDataFrame(rows, "date string, sid string, label struct<value:float,valid:boolean,reason:string>").withColumn("date", F.to_date("date"))
    path = str(tmp_path / "states")
    statistics.update_target_states(target, path)
    if values:
        same(statistics.merged_profile(spark, path).drop("mean", "std", "min", "max"), profiles.regression_profile(target).drop("mean", "std", "min", "max"))
        known = [v for v in values if v is not None and v == v]
        got = statistics.merged_profile(spark, path).first()
        assert got["mean"] == pytest.approx(plain.fmean(known), rel=1e-6) and (len(known) < 2 or got["std"] == pytest.approx(plain.stdev(known), rel=1e-6))


def test_years_are_replaced_under_the_store_s_schema(spark, store, tmp_path):
    _, panel, _ = store
    rows = panel.select("date", "sid", "td_idx", F.col("market.close").alias("close"))
    path = str(tmp_path / "panel")
    tables.write_panel(rows, path)
    before, n = files(tmp_path / "panel", a=1995, b=1997), rows.count()
    changed = rows.where("year(date) = 1996").select(F.col("close").cast("string").alias("close"), "sid", "date", F.col("td_idx").cast("long").alias("td_idx")).cache()
    for _ in range(2):
        tables.replace_years(changed.withColumn("close", F.lit("7")), path)
    stored = spark.read.parquet(path)
    assert files(tmp_path / "panel", a=1995, b=1997) == before and before
    assert stored.count() == n and stored.drop("year").schema == rows.schema
    assert stored.where("year = 1996 and close <> 7").isEmpty() and stored.where("year <> 1996 and close = 7").isEmpty()
    with pytest.raises(ValueError, match="the store has the columns"):
        tables.replace_years(changed.drop("close"), path)


def test_stored_buckets_join_without_an_exchange(spark, store):
    _, panel, target = store
    keys = ["date", "sid"]
    left, right = (spark.read.table(tables.bucketed(df, keys, 4)) for df in (panel.select(*keys, "td_idx", "status"), target.select(*keys, "label")))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(labels.label_panel(left, {"return_5d": right}))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert labels.label_panel(left, {"return_5d": right}).count() == panel.count()


def test_moments_in_one_pass(spark):
    rng = random.Random(2)
    width = 7
    rows = [[5.0 if i == 0 else None if i == 1 else 1e6 + rng.random() if i == 2 else rng.choice([None, float("nan"), rng.gauss(3, 2)]) for i in range(width)] for _ in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "features array<float>")
    got = {r["position"]: r for r in screening.feature_moments(df).collect()}
    each = df.select(F.posexplode("features").alias("position", "v"))
    value = F.when(~is_missing(F.col("v")), F.col("v").cast("double"))
    for r in each.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"), F.var_pop(value).alias("variance")).collect():
        mine = got[r["position"]]
        assert (mine["n_rows"], mine["n_missing"]) == (r["n"], r["n"] - r["k"])
        assert mine["variance"] == (None if r["variance"] is None else pytest.approx(r["variance"], rel=1e-6, abs=0.0))
    assert got[0]["variance"] == 0.0 and got[1]["variance"] is None
    plan = plan_of(screening.feature_moments(df))
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("ObjectHashAggregate") and "PythonUDF" not in plan
    assert screening.feature_moments(df.limit(0)).count() == 0


def test_moments_of_a_known_width(spark):
    """The same moments from vectors that compiled code puts together; no lambda sees a value."""
    rng = random.Random(3)
    width, odd = 8, [None, float("nan"), 0.0, -0.0]
    rows = [[5.0 if i == 0 else None if i == 1 else 1e6 + rng.random() if i == 2 else 0.0 if i == 3 else rng.choice([None, 7.5]) if i == 4 else rng.choice([None, 0.0]) if i == 5
             else rng.choice([*odd, rng.gauss(3, 2)]) if i == 6 else rng.choice([float("nan"), -rng.random()]) for i in range(width)] for _ in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "features array<float>").repartition(5)
    got = {r["position"]: r for r in screening.feature_moments(df, width).collect()}
    each = df.select(F.posexplode("features").alias("position", "v"))
    value = F.when(~is_missing(F.col("v")), F.col("v").cast("double"))
    for r in each.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"), F.var_pop(value).alias("variance")).collect():
        mine = got[r["position"]]
        assert (mine["n_rows"], mine["n_missing"]) == (r["n"], r["n"] - r["k"])
        assert mine["variance"] == (None if r["variance"] is None else pytest.approx(r["variance"], rel=1e-6, abs=0.0))
    assert len(got) == width and got[1]["variance"] is None and all(got[i]["variance"] == 0.0 for i in (0, 3, 4, 5))
    plan = plan_of(screening.feature_moments(df, width))
    assert "lambda" not in plan and plan.count("Generate") == 1 and plan.index("Generate") < plan.index("ObjectHashAggregate")
    # Fewer wanted than there are, more wanted than there are, none at all, and rows that do not agree.
    assert sorted(r["position"] for r in screening.feature_moments(df, 3).collect()) == [0, 1, 2]
    assert {r["position"]: r for r in screening.feature_moments(df, width + 2).collect()} == got
    assert screening.feature_moments(df.limit(0), width).count() == 0
    with pytest.raises(Exception, match="unlike numbers of features"):
        screening.feature_moments(df.union(df.limit(1).select(F.slice("features", 1, 2))), width).collect()


def _lines(spark, path):
    """Order lines with whole, fractional, huge, negative and missing quantities; some keys come twice, some dates and suppliers are missing."""
    rng = random.Random(5)
    quantities = [1.0, 2.0, 6.0, 12.5, 0.0, -4.0, 1e12, 0.1, float("nan"), None]
    rows = [(i // 3, i, rng.choice([1, 2, 3, None]), i % 3, rng.choice(quantities), 10.0 + i, 0.05, 0.02, rng.choice("AR"),
             rng.choice([f"2024-01-{d:02d} 00:00:00" for d in range(1, 9)] + [None])) for i in range(120)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, day string"
    df = spark.createDataFrame(rows, kinds)
    df.select(*[c for c in df.columns if c != "day"], F.col("day").cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")


def test_wide_records_are_both_feeds_side_by_side(spark, tmp_path):
    with settings(spark, spark__sql__ansi__enabled="false"):
        # A day's price is divided by its quantity, which may be zero here.
        _lines(spark, tmp_path)
        bars, factors = fixtures.supplier_bars(spark, str(tmp_path)), fixtures.wide_factors(spark, str(tmp_path), 30)
        held = F.col("date").isNotNull() & F.col("sid").isNotNull()
        both = panel.side_by_side(feeds.daily_bars(bars), feeds.factor_values(factors)).where(held)
        got = fixtures.wide_records(spark, str(tmp_path), 30).where(held)
        # As text, where NaN is like NaN.
        assert str(rows_of(got)) == str(rows_of(both.select(*got.columns))) and got.count() > 15
        most = fixtures._priced_lines(spark, str(tmp_path)).groupBy("date", "sid").agg(F.max("l_quantity").alias("most"))
        plainly = most.select("date", "sid", *[F.when(F.col("most") % (k + 2) != 0, F.col("most") * k).alias(f"w{k}") for k in range(30)])
        assert str(rows_of(factors)) == str(rows_of(plainly))
        plan = plan_of(fixtures.wide_tables(spark, str(tmp_path)).recorded.select("td_idx", "status"))
        assert "FullOuter" not in plan


def test_missing_shares_without_a_lambda(spark):
    df = spark.createDataFrame([(1.0, None, 2), (float("nan"), None, None), (0.0, 3.0, 4), (None, float("nan"), 5)], "a float, b double, c int")
    share = df.select(F.expr(panel.missing_share(["a", "b", "c"])).alias("share"))
    assert [r["share"] for r in share.collect()] == [pytest.approx(x / 3) for x in (1, 3, 0, 2)] and dict(share.dtypes) == {"share": "float"}
    assert "lambda" not in plan_of(share)


def test_duplicates_are_found_by_position(spark):
    rng = random.Random(4)
    rows = [(f"2024-01-{rng.randrange(1, 9):02d}", f"s{rng.randrange(30)}", f"f{rng.randrange(3)}", i, float(i)) for i in range(500)] + [("2024-02-01", "hot", "f0", i, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "date string, sid string, file string, row long, x double").repartition(5)
    first = {}
    for date, sid, file, row, x in sorted(rows, key=lambda r: (r[2], r[3])):
        first.setdefault((date, sid), x)
    out = feeds.keep_first_by_position(df, ["date", "sid"], ["file", "row"])
    assert {(r["date"], r["sid"]): r["x"] for r in out.collect()} == first and out.count() == len(first) and out.columns == ["date", "sid", "x"]


def test_wide_rows_are_in_no_aggregate(spark, tmp_path):
    wide = spark.range(400).select(F.lit("2024-01-02").alias("datetime"), F.col("id").cast("string").alias("order_book_id"), *[F.col("id").alias(f"f{i}") for i in range(60)])
    wide.write.parquet(str(tmp_path / "year=2024.parquet"))
    with settings(spark, spark__sql__debug__maxToStringFields="1000", spark__sql__maxMetadataStringLength="100000"):
        plan = plan_of(feeds.read_factors(spark, str(tmp_path)))
    assert not any("Aggregate" in line and "f59" in line for line in plan.splitlines()) and "f59" in plan


def test_stored_files_are_ordered_by_day(spark, tmp_path):
    """The writer needs its rows by year; a sort of its own by year alone would undo the order by day."""
    rows = spark.range(400).select(F.expr("date_add(DATE'2023-12-20', CAST(id * 7 % 20 AS INT))").alias("date"), (F.col("id") * 13 % 100).cast("string").alias("sid"))
    tables.write_panel(rows.distinct(), str(tmp_path / "p"), files_per_year=2)
    for file in (tmp_path / "p").glob("year=*/*.parquet"):
        got = [(r["date"], r["sid"]) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert got == sorted(got)


def test_panel_states_read_a_panel_once(spark, store):
    _, panel, _ = store
    assert plan_of(statistics.panel_states(panel)).count("Scan parquet") == 1
