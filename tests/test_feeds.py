from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.identifiers import normalise_date, normalise_symbol
from panelwright.functions.schema import encoded_positions, encoded_width, select_features
from panelwright.sources import feeds, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "raw, want",
    [
        ("002017.XSHE", "002017.SZ"),
        ("600000.xshg", "600000.SH"),
        (" SH600000", "600000.SH"),
        ("sz000001\t", "000001.SZ"),
        ("830001", "830001.BJ"),
        ("430001", "430001.BJ"),
        ("900901", "900901.SH"),
        ("000001", "000001.SZ"),
        ("1.2.XBEJ", "1.2.BJ"),
        ("600000.sh", "600000.SH"),
        ("12345", "12345"),
        ("AAPL", "AAPL"),
        (None, None),
    ],
)
def test_symbol_forms(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(normalise_symbol(F.col("s"))).first()[0] == want


def test_dates_never_fail(spark):
    df = spark.createDataFrame([("2024-01-02",), ("bad",), ("2024-01-03 10:11:12",), (None,)], "d string")
    got = [r[0] for r in df.select(normalise_date(F.col("d"))).collect()]
    assert got == [dt.date(2024, 1, 2), None, dt.date(2024, 1, 3), None]


def test_bars_aliases_defaults_and_first_duplicate(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-02", "SH600000", 1.0, 2.0, 0.5, 1.5, 10.0, 2),
            ("2024-01-02", "600000.XSHG", 9.0, 9.0, 9.0, 9.0, 9.0, 3),
            ("2024-01-02", "600000", 7.0, 7.0, 7.0, float("nan"), 7.0, 1),
            ("bad", "600000", 1.0, 1.0, 1.0, 1.0, 1.0, 4),
            ("2024-01-03", None, 1.0, 1.0, 1.0, 1.0, 1.0, 5),
        ],
        "trade_date string, code string, open double, high double, low double, close double, volume double, seq int",
    )
    got = feeds.normalise_bars(raw, order=["seq"]).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert row["sid"] == "600000.SH" and row["open"] == 7.0 and row["close"] is None
    assert row["amount"] is None and row["adj_factor"] == 1.0


def test_bars_need_their_columns(spark):
    with pytest.raises(feeds.SourceError):
        feeds.normalise_bars(spark.createDataFrame([("2024-01-02", "1", 1.0)], "date string, sid string, open double"))
    with pytest.raises(feeds.SourceError):
        feeds.normalise_bars(spark.createDataFrame([(1.0,)], "open double"))


def test_factor_ids_and_exclusions(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "600000.XSHG", "SH999999", 1.0, float("nan"), 3.0)],
        "datetime string, order_book_id string, instrument string, KMID double, MA5 double, junk double",
    )
    got = feeds.normalise_factors(raw, exclude=["junk"])
    assert got.columns == ["date", "sid", "KMID", "MA5"]
    assert rows(got) == [(dt.date(2024, 1, 2), "600000.SH", 1.0, None)]
    with pytest.raises(feeds.SourceError):
        feeds.normalise_factors(raw.select("datetime", "order_book_id"))


def test_yearly_files(spark, tmp_path):
    schema = "date string, symbol string, open double, high double, low double, close double, volume double"
    bar = (1.0, 1.0, 1.0, 1.0, 1.0)
    for year, extra in ((2019, []), (2020, [("2020-01-02", "600000", 5.0, 5.0, 5.0, 5.0, 5.0)]), (2021, [])):
        day = f"{year}-01-02"
        df = spark.createDataFrame([(day, "600000", *bar), *extra], schema).toPandas()
        if year == 2020:
            df["money"] = 3.0
        df.to_parquet(tmp_path / f"year={year}.parquet", index=False)
    (tmp_path / "year=old.parquet").write_bytes(b"")
    paths = tables.yearly_paths(spark, str(tmp_path), 2020, None)
    assert [p[-17:] for p in paths] == ["year=2020.parquet", "year=2021.parquet"]
    bars = feeds.read_bars(spark, str(tmp_path), 2020).orderBy("date").collect()
    assert [(str(b["date"]), b["open"], b["amount"]) for b in bars] == [("2020-01-02", 1.0, 3.0), ("2021-01-02", 1.0, None)]
    assert feeds.bar_keys(feeds.read_bars(spark, str(tmp_path))).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.yearly_paths(spark, str(tmp_path), 2030)


def test_years_with_other_names_types_and_dates(spark, tmp_path):
    values = {"open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10}
    layouts = {
        2015: {"order_book_id": ["600000.XSHG"], "trade_date": ["2015-01-02"]},
        2016: {"ts_code": ["600000.SH"], "trade_date": ["20160102"]},
        2017: {"symbol": ["SH600000"], "date": ["2017/01/02"], "volume": 10.5},
        2018: {"code": ["600000"], "date": [20180102]},
        2019: {"symbol": ["600000"], "datetime": pd.to_datetime(["2019-01-02"]).astype("datetime64[ns]")},
        2020: {"symbol": ["600000"], "date": [dt.date(2020, 1, 2)], "volume": 7.0},
    }
    for year, own in layouts.items():
        df = pd.DataFrame({**own, **{k: [own.get(k, v)] for k, v in values.items()}})
        df.to_parquet(tmp_path / f"year={year}.parquet", index=False, coerce_timestamps=None, version="2.6")
    bars = feeds.read_bars(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(b["date"]), b["sid"]) for b in bars] == [(f"{y}-01-02", "600000.SH") for y in layouts]
    assert [b["volume"] for b in bars] == [10.0, 10.0, 10.5, 10.0, 10.0, 7.0]
    assert tables.read_yearly(spark, str(tmp_path)).count() == len(layouts)


def test_years_may_be_folders(spark, tmp_path):
    schema = "symbol string, open double, high double, low double, close double, volume double"
    bar = ("600000", 1.0, 1.0, 1.0, 1.0, 1.0)
    old = spark.createDataFrame([("20190102", *bar), ("20190103", *bar)], f"trade_date string, {schema}")
    old.repartition(2, "trade_date").write.parquet(str(tmp_path / "year=2019.parquet"))
    spark.createDataFrame([("2020-01-02", *bar)], f"date string, {schema}").toPandas().to_parquet(tmp_path / "year=2020.parquet", index=False)
    (tmp_path / "other").mkdir()
    old.write.parquet(str(tmp_path / "other" / "part"))
    assert [p[-17:] for p in tables.yearly_paths(spark, str(tmp_path))] == ["year=2019.parquet", "year=2020.parquet"]
    assert sorted(str(r["date"]) for r in feeds.read_bars(spark, str(tmp_path)).collect()) == ["2019-01-02", "2019-01-03", "2020-01-02"]
    places = {r["_file"].split("/")[0] for r in tables.read_yearly(spark, str(tmp_path)).select("_file").collect()}
    assert places == {"year=2019.parquet", "year=2020.parquet"}


def test_a_panel_year_has_a_file_for_each_cell_at_most(spark, tmp_path):
    df = spark.range(4_000).select(F.date_add(F.lit("2023-06-01").cast("date"), (F.col("id") % 400).cast("int")).alias("date"), F.col("id").cast("string").alias("sid"))
    tables.write_panel(df, str(tmp_path / "p"), files_per_year=3)
    assert all(1 <= len(list(d.glob("part-*"))) <= 3 for d in (tmp_path / "p").glob("year=*")) and len(list((tmp_path / "p").glob("year=*"))) == 2
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.drop("year").exceptAll(df).count() == 0 and got.count() == 4_000


def test_dropped_rows_are_counted(spark):
    raw = spark.createDataFrame([("20240102", "1"), ("2024/01/02", "1"), ("bad", "1"), ("bad", None), ("2024-01-02", None), ("2024-01-03", "1")], "date string, symbol string")
    assert tuple(feeds.drop_counts(raw).first()) == (6, 2, 1, 1)
    assert tuple(feeds.drop_counts(raw.limit(0)).first()) == (0, 0, 0, 0)


def test_calendar_csv(spark, tmp_path):
    path = tmp_path / "cal.csv"
    path.write_text("x,trade_date\n1,2024-01-03\n2,2024-01-02\n3,nope\n4,2024-01-03\n5,2024-02-01\n")
    got = rows(tables.read_calendar_csv(spark, str(path), end="2024-01-31").select("date"))
    assert got == [(dt.date(2024, 1, 2),), (dt.date(2024, 1, 3),)]


def test_panel_round_trip_prunes_by_date(spark, tmp_path):
    days = [dt.date(2023, 12, 29), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    df = spark.createDataFrame([(d, s, 1.5) for d in days for s in "ab"], "date date, sid string, x double")
    tables.write_panel(df, str(tmp_path / "p"), schema=df.schema)
    got = tables.read_date_range(spark, str(tmp_path / "p"), "2023-12-30", "2024-01-03", ["date", "sid"])
    assert rows(got) == [(dt.date(2024, 1, 2), "a"), (dt.date(2024, 1, 2), "b")]
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2023-12-30), LessThan(date,2024-01-03)]" in plan
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<date:date,sid:string>" in plan


def test_absent_target_is_none(spark, tmp_path):
    assert tables.read_target(spark, str(tmp_path / "nothing")) is None


def test_sinks(spark, tmp_path):
    preds = spark.createDataFrame([(dt.date(2024, 1, 2), "a", 0.5, 0.25)], "date date, sid string, y_raw double, pred double")
    tables.write_predictions(preds, str(tmp_path / "preds"))
    assert spark.read.csv(str(tmp_path / "preds"), header=True).first()["pred"] == "0.25"
    metrics = spark.createDataFrame([("test", "rank_ic_mean", 0.1)], "split string, metric string, value double")
    for run in ("r1", "r2"):
        tables.append_run_metrics(metrics, run, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
    tables.append_run_features(spark, ["b", "a"], "r1", str(tmp_path / "features"))
    assert [r["feature"] for r in spark.read.parquet(str(tmp_path / "features")).orderBy("position").collect()] == ["b", "a"]


def test_feature_selection_by_name():
    names = ["KMID", "MA5", "fund__pb", "fund__dividend_yield"]
    assert select_features(names) == names
    assert select_features(names, include="^feature.(K|fund)") == ["KMID", "fund__pb", "fund__dividend_yield"]
    assert select_features(names, exclude="(?i)DIVIDEND") == names[:3]
    assert select_features(names, fundamentals=["feature.fund__pb"]) == ["KMID", "MA5", "fund__pb"]
    assert encoded_positions(names) is None and encoded_width(names) == 9
    assert encoded_positions(names, exclude="fund") == [0, 1, 4, 5, 8] and encoded_width(names, exclude="fund") == 5
