from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import assets, cube, ranker, screening, splits, views

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]


def calendar(spark):
    return assets.with_day_index(spark.createDataFrame([(d,) for d in DAYS], "date date"))


def small_panel(spark):
    rng = random.Random(1)
    data = []
    for s in "abc":
        for t in sorted(rng.sample(range(12), 9)):
            has = rng.random() < 0.8
            data.append((DAYS[t], s, t, float(t) if has else None, rng.choice([None, float("nan"), 2.0]) if has else None, has))
    df = spark.createDataFrame(data, "date date, sid string, td_idx int, f1 double, f2 double, has boolean")
    return data, df.select(
        "date", "sid", "td_idx", F.when(F.col("has"), F.struct(F.col("f1").cast("float").alias("f1"), F.col("f2").cast("float").alias("f2"))).alias("feature"),
        F.struct(F.col("has").alias("sample_usable_for_feature")).alias("status"),
    )


def target(df, value, valid=True):
    return df.select("date", "sid", F.struct(F.lit(value).cast("float").alias("value"), F.lit(valid).alias("valid"), F.lit("").alias("reason")).alias("label"))


def encoded(row):
    _, _, _, f1, f2, has = row
    values = [f1, f2]
    gone = [v is None or v != v for v in values]
    return [0.0 if g else v for v, g in zip(values, gone)] + [float(g) for g in gone] + [float(has)]


def test_encoded_rows(spark):
    data, p = small_panel(spark)
    got = {(r["date"], r["sid"]): r for r in views.encoded_view(p, target(p, 0.5), target(p, 3.0, False)).collect()}
    for row in data:
        r = got[row[0], row[1]]
        assert list(r["x"]) == encoded(row) and r["present"] == row[5]
        assert (r["y_ret"], r["y_mom"], r["ret_mask"], r["mom_mask"], r["both_mask"]) == (0.5, -1, True, False, False)
    missing = views.encoded_view(p, None, target(p, 3.0)).first()
    assert (missing["y_ret"], missing["y_mom"], missing["ret_mask"], missing["mom_mask"]) == (0.0, 3, False, True)


def test_dense_cells_fill_the_grid(spark):
    data, p = small_panel(spark)
    cells = views.dense_cells(views.encoded_view(p, target(p, 0.5), None), calendar(spark), 5).collect()
    assert len(cells) == 36
    known = {(r[0], r[1]): encoded(r) for r in data}
    for c in cells:
        assert list(c["x"]) == known.get((c["date"], c["sid"]), [0.0] * 5)
        assert c["ret_mask"] == ((c["date"], c["sid"]) in known) and c["y_mom"] == -1


def grid(spark, n_days, n_sids, share):
    """Cells of which about `share` exist, with values that hardly compress."""
    keep = F.pmod(F.xxhash64("t", "n"), F.lit(1000)) < share * 1000
    days = spark.range(n_days).select(F.col("id").cast("int").alias("t"))
    cells = days.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n_sids - 1)))).where(keep)
    return cells.select(F.expr("date_add(DATE'2024-01-01', t)").alias("date"), F.format_string("s%05d", "n").alias("sid"), F.col("t").alias("td_idx"),
                        F.array(*[(F.pmod(F.xxhash64("t", "n", F.lit(i)), F.lit(10**6)) / 7).cast("float") for i in range(6)]).alias("x"), (F.col("n") % 2 == 0).alias("present"),
                        F.col("t").cast("float").alias("y_ret"), (F.col("n") % 5 - 1).cast("byte").alias("y_mom"), (F.col("t") % 2 == 0).alias("ret_mask"),
                        (F.col("n") % 3 == 0).alias("mom_mask"), ((F.col("t") % 2 == 0) & (F.col("n") % 3 == 0)).alias("both_mask"))


def test_cube_gives_its_cells_back_and_stores_only_those(spark, tmp_path):
    days = spark.range(50).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("date"), F.col("id").cast("int").alias("td_idx"))
    sizes = {}
    for share in (1.0, 0.05):
        view = grid(spark, 50, 200, share).cache()
        held = cube.write_cube(view, days, str(tmp_path / f"c{share}"), 6)
        sizes[share] = sum(p.stat().st_size for p in (tmp_path / f"c{share}" / "tiles").glob("*.parquet")) / view.count()
        key = lambda r: (r["date"], r["sid"])
        got = sorted((r.asDict() for r in cube.read_cells(held).collect()), key=key)
        assert got == sorted((r.asDict() for r in view.select(*got[0]).collect()), key=key)
        part = cube.read_cells(held, 15, 17, view.select("sid").where("sid between 's00060' and 's00070'"))
        assert part.count() == view.where("td_idx between 15 and 17 and sid between 's00060' and 's00070'").count() > 0
        full = cube.read_cells(held, 15, 17, absent=True)
        assert full.count() == 3 * view.select("sid").distinct().count() and full.where("y_mom = -1 and not present and x[0] = 0").count() >= full.count() - view.where("td_idx between 15 and 17").count()
        assert {(r.td_idx, r.n_cells) for r in cube.coverage_by_day(held).collect()} == {(r.td_idx, r["count"]) for r in view.groupBy("td_idx").count().collect()}
        assert {tuple(r) for r in cube.coverage_by_instrument(held).collect()} == {tuple(r) for r in view.groupBy("sid").count().collect()}
        scan = cube.read_cells(held, 40, 45)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(tile_t,2)" in scan and "LessThanOrEqual(tile_t,2)" in scan
        narrow = cube.coverage_by_day(held)._jdf.queryExecution().executedPlan().toString()
        assert "struct<tile_t:int,map:array<bigint>>" in narrow.replace(" ", "") or "ReadSchema: struct<tile_t:int,map:array<bigint>>" in narrow
    assert sizes[0.05] < 2.5 * sizes[1.0]  # bytes a cell that exists; written out densely it would be twenty times as many


@pytest.mark.parametrize(("lookback", "span"), [(1, None), (4, None), (4, 3), (4, 7), (12, None)])
def test_lookback_windows(spark, lookback, span):
    data, p = small_panel(spark)
    view = views.encoded_view(p, target(p, 0.5), None)
    sampled = p.select("date", "sid").where("sid <> 'b' or date > '2024-01-05'")
    got = {(r["date"], r["sid"]): r["window"] for r in views.lookback_windows(view, sampled, lookback, 5, span).collect()}
    known = {(r[1], r[2]): encoded(r) for r in data}
    want = {(r[0], r[1]) for r in data if r[2] >= lookback - 1 and (r[1] != "b" or r[2] > 4)}
    assert set(got) == want
    for (day, sid), window in got.items():
        t = DAYS.index(day)
        assert [list(x) for x in window] == [known.get((sid, u), [0.0] * 5) for u in range(t - lookback + 1, t + 1)]


def test_lookback_of_an_absent_instrument_has_masks_off(spark):
    data, p = small_panel(spark)
    view = views.encoded_view(p, target(p, 0.5), None)
    sampled = spark.createDataFrame([(DAYS[6], "nobody", 6), (DAYS[6], "a", 6)], "date date, sid string, td_idx int")
    got = {r["sid"]: r for r in views.lookback_windows(view, sampled, 3, 5).collect()}
    assert set(got) == {"nobody", "a"} and [list(x) for x in got["nobody"]["window"]] == [[0.0] * 5] * 3
    assert not any(got["nobody"][m] for m in ("present", "ret_mask", "mom_mask", "both_mask")) and got["nobody"]["y_mom"] == -1


def test_tabular_view_and_subset(spark):
    data, p = small_panel(spark)
    view = views.tabular_view(p, None, exclude="f1$")
    assert all(len(r["features"]) == 1 and r["y"] == 0 and not r["y_valid"] for r in view.collect())
    assert view.count() == len(data)
    kept = views.keep_encoded(F.array(*[F.lit(float(i)) for i in range(5)]), ["f1", "f2"], exclude="f1$")
    assert list(spark.range(1).select(kept).first()[0]) == [1.0, 3.0, 4.0]


def test_screening(spark):
    rows = [([1.0, 7.0, None, float(i)], True, True) for i in range(9)] + [([1.0, 7.0, 5.0, 9.0], True, True), ([2.0, 0.0, 0.0, 0.0], True, False)]
    view = spark.createDataFrame(rows, "features array<float>, y_valid boolean, usable boolean")
    names = ["constant", "dividend", "sparse", "good"]
    profile = screening.feature_profile(view, names, missing_drop_thresh=0.9, exclude="(?i)DIVIDEND")
    assert screening.kept_features(profile) == ["good"]
    got = {r["feature"]: r for r in profile.collect()}
    assert got["constant"]["variance"] == 0 and got["sparse"]["missing_rate"] == 0.9 and got["good"]["n_rows"] == 10
    aligned = screening.align_features(view, names, ["good", "constant"])
    assert list(aligned.first()["features"]) == [0.0, 1.0]


SPLIT = {"train_start": "2023-01-01", "train_end": "2024-01-05", "valid_start": "2024-01-05", "valid_end": "2024-01-08",
         "test_start": "2030-01-01", "test_end": "2031-01-01"}


def test_splits_clamp(spark):
    got = {r["split"]: (r["start_idx"], r["end_idx"]) for r in splits.split_ranges(calendar(spark), SPLIT, lookback=3).collect()}
    assert got == {"train": (2, 3), "valid": (4, 6), "test": (11, 11), "train_valid": (2, 6)}
    dropped = splits.split_ranges(calendar(spark), SPLIT, on_empty="drop").collect()
    assert "test" not in {r["split"] for r in dropped}
    days = splits.split_days(calendar(spark), splits.split_ranges(calendar(spark), SPLIT)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in days} == {"train": 4, "valid": 3, "test": 1}
    assert splits.day_slice(calendar(spark), 2, 4).count() == 3


def test_ranker_end_to_end(spark, tmp_path):
    rng = random.Random(7)
    data = []
    for t, day in enumerate(DAYS):
        for i in range(40):
            f = rng.gauss(0, 1)
            data.append((day, f"s{i}", [f, rng.gauss(0, 1), 7.0], f + rng.gauss(0, 0.3), True, True, "train" if t < 7 else "valid" if t < 9 else "test"))
    view = spark.createDataFrame(data, "date date, sid string, features array<float>, y float, y_valid boolean, usable boolean, split string")
    params = ranker.RankerParams(max_iter=4, max_depth=3, min_group_size=5, step_size=0.5)
    done = ranker.run(view, ["signal", "noise", "constant"], params, refit_before_test=True)
    model, predictions = done.model, done.predictions
    assert done.features == ["noise", "signal"] and 1 <= model.getNumTrees <= 4
    got = {r["split"]: r for r in done.metrics.collect()}
    assert got["test"]["rank_ic_mean"] > 0.7 and got["test"]["rank_ic_n_days"] == 3 and predictions.count() == len(data)
    ranker.save(model, str(tmp_path / "m"))
    aligned = screening.align_features(view, ["signal", "noise", "constant"], done.features)
    rows = ranker.model_rows(aligned, params)
    by_trees = {r["n_trees"]: r["rank_ic_mean"] for r in ranker.rank_ic_by_trees(model, rows).collect()}
    whole = ranker.rank_ic_summary(ranker.rank_ic_daily(ranker.predict(model, rows))).first()["rank_ic_mean"]
    assert sorted(by_trees) == list(range(1, model.getNumTrees + 1)) and by_trees[model.getNumTrees] == pytest.approx(whole)
    again = ranker.predict(ranker.load(str(tmp_path / "m")), rows)
    assert again.columns == ["date", "sid", "y_raw", "pred"]
    joined = again.join(predictions.withColumnRenamed("pred", "p2"), ["date", "sid"])
    assert joined.where("abs(pred - p2) > 1e-9").count() == 0
