from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import assets, labels

NAN = float("nan")


def calendar(spark, n=12):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return days, assets.with_day_index(spark.createDataFrame([(d,) for d in days], "date date"))


def panel(spark, days, closes, sid="a", opens=None):
    data = [(days[i], sid, (opens or closes)[i], c) for i, c in enumerate(closes)]
    return spark.createDataFrame(data, "date date, sid string, open double, close double").select(
        "date", "sid", F.struct("open", "close").alias("market")
    )


def labels_of(df):
    return [(r["label"]["value"], r["label"]["valid"], r["label"]["reason"]) for r in df.orderBy("sid", "date").collect()]


@pytest.mark.parametrize("formula", ["o1c2", " C0c1 ", "c10o3"])
def test_formula(formula):
    entry, a, exit_, b = labels.parse_formula(formula)
    assert f"{entry}{a}{exit_}{b}" == formula.strip().lower()


def test_bad_formula():
    for bad in ("c0", "x1c2", "c-1c2", "c1c2 c"):
        with pytest.raises(ValueError):
            labels.parse_formula(bad)
    with pytest.raises(ValueError):
        labels.ReturnRecipe("r")


def test_return_reasons(spark):
    days, cal = calendar(spark, 8)
    p = panel(spark, days, [10.0, 0.0, -1.0, NAN, None, 4.0, 5.0, 6.0])
    got = labels_of(labels.build_target(p, cal, "return_c1c2"))
    reasons = [r for _, _, r in got]
    assert reasons == ["missing_entry_price"] * 4 + ["", "", "insufficient_forward", "insufficient_history"]
    assert got[4][0] == pytest.approx(0.25) and all(v is None for v, ok, _ in got if not ok)
    exits = [r for _, _, r in labels_of(labels.build_target(p, cal, "return_c0c1"))]
    assert exits[0] == "missing_exit_price"


def test_day_outside_calendar(spark):
    days, cal = calendar(spark, 4)
    p = panel(spark, [*days, dt.date(2030, 1, 1)], [1.0, 2.0, 3.0, 4.0, 5.0])
    got = labels_of(labels.build_target(p, cal, "return_c0c1"))
    assert got[-1] == (None, False, "not_in_calendar") and got[0][0] == 1.0 and got[3][2] == "insufficient_forward"


def test_sparse_panel_looks_up_by_day_not_by_row(spark):
    days, cal = calendar(spark, 30)
    rng = random.Random(3)
    kept = {s: sorted(rng.sample(range(30), 18)) for s in "abc"}
    price = {(s, t): float(rng.randint(1, 9)) for s, ts in kept.items() for t in ts}
    data = [(days[t], s, v) for (s, t), v in price.items()]
    p = spark.createDataFrame(data, "date date, sid string, close double").select("date", "sid", F.struct(F.col("close").alias("open"), "close").alias("market"))
    got = labels.build_target(p, cal, "return_5d").collect()
    for r in got:
        t, s = days.index(r["date"]), r["sid"]
        far = price.get((s, t + 5))
        assert r["label"]["valid"] == (far is not None)
        if far is not None:
            assert r["label"]["value"] == pytest.approx((far - price[s, t]) / price[s, t], rel=1e-6)
        elif t + 5 >= 30:
            assert r["label"]["reason"] == "insufficient_forward"
        else:
            assert r["label"]["reason"] == "missing_exit_price"


@pytest.mark.parametrize(
    "line, want",
    [([1, 2, 3], 3), ([-1, 0, 1], 1), ([-1, 1, 1], 4), ([1, -1, -2], 0), ([1, -1, 1], 2), ([0, 0, 0], 2), ([0, 1, -1], 0),
     ([1, 0, -1, 1], 2), ([-3, -2, -1], 1), ([1, 0, -1], 3)],
)
def test_momentum_class(spark, line, want):
    df = spark.createDataFrame([([float(x) for x in line],)], "line array<double>")
    assert df.select(labels.momentum_class(F.col("line"))).first()[0] == want


def test_momentum_reasons(spark):
    days, cal = calendar(spark, 14)
    closes = [5.0] * 4 + [6.0] * 10
    closes[12] = 0.0
    got = labels_of(labels.build_target(panel(spark, days, closes), cal, "momentum_cls"))
    assert [g[2] for g in got] == ["insufficient_history"] * 4 + [""] * 2 + ["missing_close_in_window"] * 2 + ["insufficient_forward_window"] * 6
    assert got[4][0] == 3.0


def test_forward_filled_exit(spark):
    days, cal = calendar(spark, 6)
    p = panel(spark, days, [10.0, 10.0, None, None, 20.0, None])
    recipe = labels.ForwardFilledReturnRecipe("ff", "c0c2")
    got = labels_of(labels.build_targets(p, cal, [recipe]).select("date", "sid", F.col("ff").alias("label")))
    assert got[0] == (1.0, True, recipe.FILLED) and got[1] == (1.0, True, recipe.FILLED)
    assert got[2][2] == "missing_entry_price" and got[4][2] == "insufficient_forward"


def test_guards(spark):
    days, cal = calendar(spark, 10)
    p = panel(spark, days, [float(i + 1) for i in range(10)]).withColumn("list_date", F.lit(days[0])).withColumn("delist_date", F.lit(days[6]))
    p = labels.with_trading_day(p, cal)
    block = labels.build_targets(p, cal, [labels.make_recipe("return_5d")], keep=["td_idx", "list_date", "delist_date"])
    got = labels_of(labels.label_guards(block, cal, "return_5d", 5, min_listed_days=1))
    assert [g[2] for g in got] == ["STOCK_TOO_YOUNG", "", *["DELISTED_IN_WINDOW"] * 3, *["INSUFFICIENT_FORWARD_WINDOW"] * 5]


def test_custom_recipe_and_overrides(spark):
    class SpreadRecipe(labels.Recipe):
        def __init__(self, name, lag=1):
            self.name, self.lag = name, lag

        def required_columns(self):
            return ["market.close"]

        def offsets(self):
            return [("market.close", 0), ("market.close", -self.lag)]

        def reason(self, at, position):
            return F.when(self.value(at).isNull(), "no_value").otherwise("")

        def value(self, at):
            return at("market.close", 0) - at("market.close", -self.lag)

    labels.register_target(SpreadRecipe, labels.TargetSpec("spread", "regression", params={"lag": 2}))
    try:
        days, cal = calendar(spark, 5)
        p = panel(spark, days, [1.0, 2.0, 4.0, 8.0, 16.0])
        assert [g[0] for g in labels_of(labels.build_target(p, cal, "spread"))] == [None, None, 3.0, 6.0, 12.0]
        assert [g[0] for g in labels_of(labels.build_target(p, cal, "spread", lag=1))] == [None, 1.0, 2.0, 4.0, 8.0]
        with pytest.raises(ValueError):
            labels.build_target(p.drop("market"), cal, "spread")
    finally:
        labels._TARGETS.pop("spread")
    with pytest.raises(KeyError):
        labels.make_recipe("spread")


def test_requested_targets():
    cfg = {"targets": [{"name": "return_5d"}, {"name": "momentum_cls", "params": {"gap": 3}}]}
    assert labels.requested_targets(cfg) == [("return_5d", {}), ("momentum_cls", {"gap": 3})]
    assert labels.requested_targets(cfg, "momentum_cls") == [("momentum_cls", {"gap": 3})]
    assert labels.requested_targets({"target": {"name": "return_20d", "params": {"window": 3}}}) == [("return_20d", {"window": 3})]
    both = {**cfg, "target": {"name": "return_20d", "params": {"window": 3}}}
    assert labels.requested_targets(both) == labels.requested_targets(cfg) and labels.requested_targets(both, "return_20d") == [("return_20d", {"window": 3})]
    assert labels.requested_targets({}) == [("return_5d", {})]
    assert labels.requested_targets({}, "return_c0c1") == [("return_c0c1", {})]


def test_all_targets_share_one_window(spark):
    days, cal = calendar(spark, 12)
    p = labels.with_trading_day(panel(spark, days, [1.0] * 12), cal)
    df = labels.build_targets(p, cal, [labels.make_recipe(n) for n in labels.list_targets()])
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [first(") == 1
