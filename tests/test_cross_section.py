from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import cross_section as xs, losses

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
NAN = float("nan")


def day_frame(spark, values, name="y", day=DAYS[0]):
    return spark.createDataFrame([(day, f"s{i}", v) for i, v in enumerate(values)], f"date date, sid string, {name} double")


def bins_of(df):
    return [r["relevance"] for r in df.orderBy(F.length("sid"), "sid").collect()]


@pytest.mark.parametrize(
    "values, n_bins, want",
    [
        ([1.0, 1.0, 2.0, 3.0], 2, [0, 0, 1, 1]),
        ([5.0, 5.0, 5.0], 10, [0, 0, 0]),
        ([7.0], 10, [0]),
        ([NAN, 2.0, None, 1.0, 3.0], 3, [0, 1, 0, 0, 2]),
        ([float(i) for i in range(11)], 10, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]),
    ],
)
def test_relevance_bins(spark, values, n_bins, want):
    assert bins_of(xs.relevance_bins(day_frame(spark, values), "y", n_bins)) == want


def test_relevance_levels(spark):
    df = day_frame(spark, [0.5, 0.4, 0.3, 0.2, 0.1, 9.0]).withColumn("m", F.col("y") < 1)
    assert bins_of(xs.relevance_levels(df, "y", "m", 5)) == [4, 3, 2, 1, 0, 0]


def random_rows(n_days=4, n=60, seed=4):
    rng = random.Random(seed)
    return [
        (DAYS[d], f"s{i}", round(rng.gauss(0, 1), 1), rng.choice([0.0, 0.5, 1.0, rng.random()]), rng.random() < 0.8, rng.randrange(-1, 5))
        for d in range(n_days) for i in range(n)
    ]


COLUMNS = ["date", "sid", "y", "p", "m", "c"]
SCHEMA = "date date, sid string, y double, p double, m boolean, c int"


def test_rank_ic_matches_pandas_and_skips_degenerate_days(spark):
    data = random_rows(2)
    data += [(DAYS[2], f"s{i}", 1.0, float(i), True, 0) for i in range(5)]  # constant label
    data += [(DAYS[3], f"s{i}", float(i), float(i), True, 0) for i in range(2)]  # too few rows
    df = spark.createDataFrame(data, SCHEMA)
    pdf = pd.DataFrame(data, columns=COLUMNS)
    got = {r["date"]: r["rank_ic"] for r in xs.rank_ic_daily(df, "y", "p").collect()}
    want = {d: g.y.rank().corr(g.p.rank()) for d, g in pdf.groupby("date") if d in DAYS[:2]}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-12) for d in want)
    self_ic = xs.rank_ic_daily(df.withColumn("q", F.col("y")), "y", "q").where(F.col("date") == DAYS[0]).first()["rank_ic"]
    assert self_ic == pytest.approx(1.0)
    summary = xs.rank_ic_summary(xs.rank_ic_daily(df, "y", "p")).first()
    ics = np.array(list(want.values()))
    assert summary["rank_ic_mean"] == pytest.approx(ics.mean()) and summary["rank_ic_std"] == pytest.approx(ics.std(ddof=1))
    assert summary["rank_ic_n_days"] == 2 and summary["rank_ic_ir"] == pytest.approx(ics.mean() / ics.std(ddof=1))


def test_rank_ic_without_any_day(spark):
    df = spark.createDataFrame([(DAYS[0], "a", 1.0, 1.0)], "date date, sid string, y double, p double")
    row = xs.rank_ic_summary(xs.rank_ic_daily(df, "y", "p")).first()
    assert row["rank_ic_n_days"] == 0 and row["rank_ic_mean"] is None and row["rank_ic_ir"] is None


def test_ic_daily(spark):
    data = random_rows(1) + [(DAYS[1], "a", 1.0, 1.0, True, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    pdf = pd.DataFrame(data, columns=COLUMNS)
    g = pdf[pdf.m & (pdf.date == DAYS[0])].copy()
    g["h"] = [hashlib.md5(s.encode()).hexdigest() for s in g.sid]
    oy = g.sort_values(["y", "h"]).assign(o=range(len(g))).o
    op = g.sort_values(["p", "h"]).assign(o=range(len(g))).o
    rows = xs.ic_daily(df, "y", "p", "m").collect()
    assert [r["date"] for r in rows] == [DAYS[0]] and rows[0]["n_rows"] == len(g)
    assert rows[0]["ic"] == pytest.approx(g.y.corr(g.p), abs=1e-9)
    assert rows[0]["rank_ic"] == pytest.approx(oy.corr(op.reindex(oy.index)), abs=1e-9)


def test_small_groups_and_sizes(spark):
    data = random_rows(2, 5)[:7]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r["date"]: r["group_size"] for r in xs.group_sizes(df).collect()} == {DAYS[0]: 5, DAYS[1]: 2}
    assert xs.drop_small_groups(df, 3).count() == 5 and xs.drop_small_groups(df, 1) is df


def test_normalise(spark):
    df = day_frame(spark, [3.0, 1.0, 1.0, None, 5.0])
    got = [r["y"] for r in xs.normalise(df, "y", "rank").orderBy("sid").collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0, None, 1.0]
    got = [r["z"] for r in xs.normalise(df, "y", "zscore", "z").orderBy("sid").collect()]
    x = np.array([3.0, 1.0, 1.0, 5.0])
    assert got[3] is None and got[0] == pytest.approx((3 - x.mean()) / x.std(ddof=1))
    assert xs.normalise(df, "y").count() == 5
    with pytest.raises(ValueError):
        xs.normalise(df, "y", "other")


def test_sampling_prefers_present_and_is_reproducible(spark):
    df = spark.createDataFrame([(DAYS[0], f"s{i}", i % 3 == 0) for i in range(30)], "date date, sid string, present boolean")
    first = xs.sample_per_day(df, 15, "present").collect()
    again = xs.sample_per_day(df.repartition(7, "sid"), 15, "present").collect()
    assert {r["sid"] for r in first} == {r["sid"] for r in again} and len(first) == 15
    assert sum(r["present"] for r in first) == 10 and sorted(r["sample_pos"] for r in first) == list(range(15))
    assert {r["sid"] for r in xs.sample_per_day(df, 15, "present", seed=1).collect()} != {r["sid"] for r in first}


def test_short_days_are_filled_from_absent_instruments(spark):
    rows = [(DAYS[0], f"s{i}", i % 2 == 0) for i in range(4)] + [(DAYS[1], f"s{i}", True) for i in range(30)]
    df = spark.createDataFrame(rows, "date date, sid string, present boolean")
    instruments = spark.createDataFrame([(f"s{i}",) for i in range(60)], "sid string")
    got = xs.sample_per_day(df, 12, "present", instruments=instruments).collect()
    again = xs.sample_per_day(df, 12, "present", instruments=instruments.repartition(5)).collect()
    assert {(r["date"], r["sid"], r["sample_pos"]) for r in got} == {(r["date"], r["sid"], r["sample_pos"]) for r in again}
    for day, held in ((DAYS[0], {f"s{i}" for i in range(4)}), (DAYS[1], {f"s{i}" for i in range(30)})):
        chosen = [r for r in got if r["date"] == day]
        assert sorted(r["sample_pos"] for r in chosen) == list(range(12)) and len({r["sid"] for r in chosen}) == 12
        if day == DAYS[0]:
            assert held <= {r["sid"] for r in chosen} and sum(r["present"] for r in chosen) == 2
        else:
            assert {r["sid"] for r in chosen} <= held
    few = xs.sample_per_day(df, 100, "present", instruments=instruments).groupBy("date").count().collect()
    assert [r["count"] for r in few] == [60, 60]  # all instruments, if fewer than k exist


def all_pairs(rows, k, sigma=1.0):
    """(sum, pairs, dcg, idcg) straight from the definition."""
    order = sorted(rows, key=lambda r: (-r["s"], hashlib.md5(r["sid"].encode()).hexdigest()))
    d = {r["sid"]: 1 / math.log2(i + 2) if i < k else 0.0 for i, r in enumerate(order)}
    gain = {r["sid"]: 2.0 ** r["r"] - 1 for r in rows}
    idcg = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gain.values(), reverse=True)[:k]))
    total, n = 0.0, 0
    for a in rows:
        for b in rows:
            if a["m"] and b["m"] and a["r"] > b["r"]:
                w = min(10.0, abs(gain[a["sid"]] - gain[b["sid"]]) * abs(d[a["sid"]] - d[b["sid"]]) / (idcg + 1e-8))
                diff = max(-10.0, min(10.0, a["s"] - b["s"]))
                total += w * math.log1p(math.exp(-sigma * diff))
                n += 1
    return total, n, sum(gain[s] * d[s] for s in d), idcg


@pytest.mark.parametrize("k, sigma", [(5, 1.0), (50, 0.5), (200, 1.0)])
def test_pair_loss_equals_all_pairs(spark, k, sigma):
    rng = random.Random(k)
    data = [
        (DAYS[d], f"s{i}", rng.choice([-20.0, 0.0, 0.5, rng.gauss(0, 3)]), m := rng.random() < 0.85, rng.randrange(5) if m else 0)
        for d in range(3) for i in range(70)
    ]
    df = spark.createDataFrame(data, "date date, sid string, s double, m boolean, r int")
    got = {r["date"]: r for r in losses.lambda_rank_daily(df, "s", "r", "m", k, sigma).collect()}
    ndcg = {r["date"]: r for r in losses.ndcg_at_k(df, "s", "r", k).collect()}
    for day in DAYS[:3]:
        rows = [r.asDict() for r in df.where(F.col("date") == day).collect()]
        total, n, dcg, idcg = all_pairs(rows, k, sigma)
        assert got[day]["n_pairs"] == n and got[day]["pair_loss"] == pytest.approx(total, rel=1e-9)
        assert ndcg[day]["dcg"] == pytest.approx(dcg) and ndcg[day]["idcg"] == pytest.approx(idcg)
    pooled = losses.lambda_rank_loss(losses.lambda_rank_daily(df, "s", "r", "m", k, sigma).withColumn("g", F.lit(1)), ["g"]).first()
    want = sum(r["pair_loss"] for r in got.values()) / sum(r["n_pairs"] for r in got.values())
    assert pooled["lambda_rank_loss"] == pytest.approx(want)


def test_class_terms(spark):
    df = spark.createDataFrame(
        [(DAYS[0], [1.0, 3.0, 3.0], 1), (DAYS[0], [5.0, 0.0, 0.0], 2), (DAYS[0], [0.0, 0.0, 0.0], 7), (DAYS[0], [0.0, 0.0, 0.0], -1)],
        "date date, z array<double>, c int",
    )
    label = losses.clean_class(F.col("c"), 3)
    assert [r[0] for r in df.select(label).collect()] == [1, 2, -1, -1]
    assert [r[0] for r in df.select(losses.predicted_class(F.col("z"))).collect()] == [1, 0, 0, 0]
    got = [r[0] for r in df.select(losses.cross_entropy_term(F.col("z"), label)).collect()]
    assert got[0] == pytest.approx(-3 + math.log(math.e + 2 * math.exp(3))) and got[1] == pytest.approx(math.log(math.exp(5) + 2))
    assert got[2:] == [None, None]
    acc = losses.class_accuracy_daily(df, "c", "z", 3).first()
    assert (acc["n_labelled"], acc["accuracy"]) == (2, 0.5)


def test_masked_mse_with_nothing_masked_in(spark):
    df = spark.createDataFrame([(DAYS[0], 1.0, 3.0, False)], "date date, y double, p double, m boolean")
    assert losses.masked_mse(df, "y", "p", "m", ["date"]).first()["mse"] == 0.0


def test_overlapping_splits_are_ranked_apart(spark):
    rows = [(split, DAYS[0], str(i), float(i), True, True, float(-i)) for split in ("valid", "test") for i in range(4)]
    view = spark.createDataFrame(rows, "split string, date date, sid string, y double, y_valid boolean, usable boolean, pred double")
    out = xs.ranking_rows(view, min_group_size=4, n_bins=2)
    assert out.groupBy("split").count().collect() and {r["count"] for r in out.groupBy("split").count().collect()} == {4}
    assert xs.ranking_rows(view, min_group_size=5).count() == 0
    daily = xs.rank_ic_daily(out, by=["split", "date"]).collect()
    assert {(r["split"], r["n_pairs"]) for r in daily} == {("valid", 4), ("test", 4)} and all(r["rank_ic"] == pytest.approx(-1) for r in daily)


def test_rank_ic_of_several_scores_ranks_the_label_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"2024-01-{d:02d}", f"s{i}", rng.choice([None, float("nan"), round(rng.gauss(0, 1), 1), rng.gauss(0, 1)]), [float(rng.randint(0, 4)) for _ in range(3)])
            for d in range(1, 6) for i in range(3 if d == 1 else 40)]
    df = spark.createDataFrame(rows, "date string, sid string, y_raw double, scores array<double>")
    ranked, value_ranks = [], xs.value_ranks
    monkeypatch.setattr(xs, "value_ranks", lambda d, by, value: ranked.append((list(by), value)) or value_ranks(d, by, value))
    got = {(r["item"], r["date"]): (r["n_pairs"], r["rank_ic"]) for r in xs.rank_ic_of_scores(df, "item", F.col("scores")).collect()}
    assert ranked == [(["date"], "y_raw"), (["item", "date"], "_score")]
    monkeypatch.undo()
    for i in range(3):
        one = xs.rank_ic_daily(df.withColumn("pred", F.get("scores", F.lit(i))))
        want = {(i + 1, r["date"]): (r["n_pairs"], pytest.approx(r["rank_ic"], abs=1e-12)) for r in one.collect()}
        assert {k: v for k, v in got.items() if k[0] == i + 1} == want
