"""Ranking gradients against all pairs; rounds, resumption, stopping, storage."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelwright.operators import boosting
from panelwright.operators.boosting import BoostParams

SMALL = BoostParams(rounds=6, patience=3, learning_rate=0.3, max_depth=3, min_instances=5, feature_fraction=1.0, row_fraction=1.0, l2=0.1, k=8)


def brute(rows, p: BoostParams):
    """grad and hess of one day's rows (sid, score, relevance) by the sum over all pairs."""
    live = [r for r in rows if r[1] is not None and r[2] is not None]
    live.sort(key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    gain = (lambda r: float(r)) if p.gains is None else (lambda r: p.gains[r])
    disc = [1 / math.log2(i + 2) if i < p.k else 0.0 for i in range(len(live))]
    ideal = sum(g * d for g, d in zip(sorted((gain(r[2]) for r in live), reverse=True), disc))
    spread = live and live[0][1] > live[-1][1]
    g, h, total = [0.0] * len(live), [0.0] * len(live), 0.0
    for i in range(len(live)):
        for j in range(i + 1, len(live)):
            if live[i][2] == live[j][2]:
                continue
            hi, lo = (i, j) if live[i][2] > live[j][2] else (j, i)
            gap = live[hi][1] - live[lo][1]
            w = abs(gain(live[i][2]) - gain(live[j][2])) * abs(disc[i] - disc[j]) / (ideal + 1e-8)
            if p.normalise and spread:
                w /= 0.01 + abs(gap)
            q = 1 / (1 + math.exp(p.sigma * gap))
            g[hi] -= p.sigma * w * q
            g[lo] += p.sigma * w * q
            h[hi] += p.sigma**2 * w * q * (1 - q)
            h[lo] += p.sigma**2 * w * q * (1 - q)
            total += 2 * p.sigma * w * q
    scale = math.log2(1 + total) / total if p.normalise and total > 0 else 1.0
    out = {r[0]: (0.0, 0.0) for r in rows}
    return out | {r[0]: (scale * a, scale * b) for r, a, b in zip(live, g, h)}


@pytest.mark.parametrize("params", [BoostParams(k=5), BoostParams(k=50, normalise=False), BoostParams(k=7, sigma=2.0, gains=(0, 1, 3, 7, 15))])
def test_gradients_are_those_of_all_pairs(spark, params):
    rng = random.Random(3)
    days = {f"2024-01-{d:02d}": [(f"s{i}", rng.choice([None, *[round(rng.gauss(0, 1), 1) for _ in range(9)]]), rng.choice([None, 0, 1, 2, 3, 4, 4])) for i in range(30)] for d in range(1, 9)}
    days["2024-02-01"] = [("a", 1.0, 2)]
    days["2024-02-02"] = [(f"s{i}", 0.5, i % 3) for i in range(12)]  # one score only
    days["2024-02-03"] = [("a", None, 2), ("b", None, None)]
    rows = [(d, *r) for d, x in days.items() for r in x]
    df = spark.createDataFrame(rows, "date string, sid string, score double, relevance int").repartition(4)
    got = {(r.date, r.sid): (r.grad, r.hess) for r in boosting.rank_gradients(df, "score", "relevance", params).collect()}
    assert len(got) == len(rows)
    for d, x in days.items():
        for sid, (a, b) in brute(x, params).items():
            assert got[d, sid] == (pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12)), (d, sid)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for d in range(24):
        for i in range(40):
            x = [rng.gauss(0, 1) for _ in range(4)]
            y = x[0] - 0.5 * x[1] * x[2] + rng.gauss(0, 0.3)
            out.append(("train" if d < 16 else "valid", f"2024-01-{d + 1:02d}", f"s{i}", y, max(0, min(9, int(5 + 2 * y))), x))
    df = spark.createDataFrame(out, "split string, date string, sid string, y_raw double, relevance int, v array<double>")
    return df.withColumn("x", array_to_vector("v")).drop("v")


@pytest.fixture(scope="module")
def state(spark, rows):
    begun = boosting.start(rows, list("abcd"), 4)
    return boosting.boost(spark, begun, SMALL, boosting.mean_ndcg(SMALL))


def test_ndcg_rises_over_rounds(spark, rows, state):
    assert len(state.values) == len(state.model.trees) == 6 and state.values[-1] > state.values[0]
    begun, found = boosting.start(rows, list("abcd"), 4), []
    for _ in range(4):
        begun = boosting.boost_round(spark, begun, SMALL)
        scored = boosting.margins(spark, begun).where("split = 'train'")
        found.append(boosting.ndcg_daily(scored, "margin", "relevance", SMALL).agg(F.avg("ndcg")).first()[0])
    assert found == sorted(found) and found[-1] > found[0] + 0.02
    assert begun.model.leaves == state.model.leaves[:4]


def test_boosting_goes_on_where_it_stopped(spark, rows, state):
    one = boosting.boost(spark, boosting.start(rows, list("abcd"), 4), SMALL, boosting.mean_ndcg(SMALL), rounds=2)
    two = boosting.boost(spark, one, SMALL, boosting.mean_ndcg(SMALL), rounds=1)
    assert len(two.values) == 3 and two.values == state.values[:3] and two.model.leaves == state.model.leaves[:3]
    assert [t.toDebugString.split("\n", 1)[1] for t in two.model.trees] == [t.toDebugString.split("\n", 1)[1] for t in state.model.trees[:3]]


def test_a_metric_of_one_s_own_stops_after_patience(spark, rows):
    calls = []

    def falling(scored):
        assert set(scored.columns) == {"date", "sid", "y_raw", "relevance", "pred"} and scored.count() == 8 * 40
        calls.append(1)
        return scored.agg(F.lit(1.0 - len(calls) / 10).alias("value"))

    done = boosting.boost(spark, boosting.start(rows, list("abcd"), 4), BoostParams(**{**SMALL.__dict__, "patience": 2}), falling)
    assert len(done.values) == 3 and done.best_round == 1 and len(done.best.trees) == 1
    none = boosting.boost(spark, boosting.start(rows, list("abcd"), 4), SMALL, lambda df: df.agg(F.lit(None).cast("double").alias("value")), rounds=1)
    assert math.isnan(none.values[0]) and none.best_round == 1


def test_a_round_moves_no_vector_and_reads_as_much_as_the_first(spark, rows, state):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now, vectors = boosting.margins(spark, state), spark.read.table(state.vectors)
        graded = boosting.rank_gradients(now.where("split = 'train'"), "margin", "relevance", SMALL).select(*state.keys, "grad", "hess")
        plan = vectors.join(graded, state.keys)._jdf.queryExecution().executedPlan().toString()
        joined = plan[plan.index("SortMergeJoin"):]
        assert "hashpartitioning(split" not in joined and "Bucketed: true" in joined
        again = now.join(vectors, state.keys)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in again
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.table(state.table).columns == [*state.keys, "y_raw", "relevance", "margin", "leaf"]
    assert spark.read.table(state.table).count() == rows.count()


def test_a_stored_model_scores_alike_and_rejects_other_features(spark, rows, state, tmp_path):
    boosting.save(spark, state.best, str(tmp_path / "model"))
    scorer = boosting.load(spark, str(tmp_path / "model"))
    assert scorer.features == list("abcd")
    want = {(r.date, r.sid): r.margin for r in boosting.margins(spark, state).collect()} if state.best_round == 6 else None
    scored = scorer.pipeline.transform(rows)
    assert set(scored.columns) == {*rows.columns, "pred"} - {"x"}
    got = {(r.date, r.sid): r.pred for r in scored.collect()}
    assert want is None or got == pytest.approx(want)
    view = spark.createDataFrame([("2024-01-01", "a", [1.0, None, 2.0], True)], "date string, sid string, features array<float>, usable boolean")
    with pytest.raises(ValueError, match="expects the features"):
        scorer.score(view, ["a", "b", "c"])
    assert boosting.scoring_pipeline(boosting.Boosted()).transform(rows).first()["pred"] == 0.0


def test_empty_and_one_row_days(spark):
    empty = spark.createDataFrame([], "date string, sid string, score double, relevance int")
    assert boosting.rank_gradients(empty, "score", "relevance", SMALL).count() == 0
    assert boosting.ndcg_daily(empty, "score", "relevance", SMALL).count() == 0


def test_what_a_round_found_is_kept_and_its_sample_is_computed_once(spark, rows, state, monkeypatch):
    begun = boosting.start(rows, list("abcd"), 4)
    two = boosting.boost(spark, begun, SMALL, boosting.mean_ndcg(SMALL), rounds=2)
    for n, want in ((0, begun), (2, two)):
        back = state.after(n)
        assert back.values == want.values and back.model.leaves == want.model.leaves
        got = {(r.date, r.sid): r.margin for r in boosting.margins(spark, back).collect()}
        assert got == {(r.date, r.sid): r.margin for r in boosting.margins(spark, want).collect()}
    plans, fit = [], boosting.RandomForestRegressor.fit

    def watched(forest, sample):
        plans.append(sample._jdf.queryExecution().executedPlan().toString())
        return fit(forest, sample)

    monkeypatch.setattr(boosting.RandomForestRegressor, "fit", watched)
    boosting.boost_round(spark, begun, SMALL)
    # Fitting reads its sample several times, so neither gradients nor joins are left in it.
    assert len(plans) == 1 and (plans[0].startswith("InMemory") or "InMemoryTableScan" in plans[0] or "Join" not in plans[0])
