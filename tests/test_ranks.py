from __future__ import annotations

import datetime as dt
import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ranks

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3)]


def _values(kind: str, n: int, rng: random.Random) -> list[float | None]:
    pools = {
        "ties": lambda: float(rng.choice([-2, -1, 0, 0, 0, 1, 3])),
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 300),
        "narrow": lambda: 1.0 + rng.randrange(1 << 20) * 2.0**-52,
        "gappy": lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, 2.0, 4.0, 1.7e308]),
    }
    return [pools[kind]() for _ in range(n)]


def frame(spark, kind: str, n: int = 400, type_: str = "double", seed: int = 5):
    rng = random.Random(seed)
    data = [(rng.choice(DAYS[:2]) if rng.random() < 0.95 else DAYS[2], f"s{i}", v) for i, v in enumerate(_values(kind, n, rng))]
    if type_ == "float":
        data = [(d, s, None if v is None else float(np.float32(v))) for d, s, v in data]
    df = spark.createDataFrame(data, "date date, sid string, x double").withColumn("x", F.col("x").cast(type_))
    return df, pd.DataFrame(data, columns=["date", "sid", "x"]).astype({"x": float})


@pytest.mark.parametrize("kind, type_", [("ties", "float"), ("narrow", "double"), ("wide", "double"), ("gappy", "double"), ("ties", "double")])
def test_average_ranks_match_pandas(spark, kind, type_):
    df, pdf = frame(spark, kind, type_=type_)
    got = ranks.attach_ranks(df, ranks.value_ranks(df, ["date"], "x"), ["date"], "x", {"r": ranks.average_rank()})
    got = {r["sid"]: r["r"] for r in got.collect()}
    finite = pdf[np.isfinite(pdf.x)]
    want = finite.groupby("date").x.rank(method="average")
    assert len(got) == len(pdf)
    for sid, r in zip(finite.sid, want):
        assert got[sid] == r
    assert all(got[s] is None for s in set(pdf.sid) - set(finite.sid))


def test_digits_keep_order(spark):
    rng = random.Random(9)
    xs = ({struct.unpack("d", struct.pack("q", rng.randrange(-(1 << 63), 1 << 63)))[0] for _ in range(3000)}
          | {0.0, 5e-324, -5e-324, 1.0, 2.0, 4.0, 0.5, 1.7976931348623157e308, 2.2250738585072014e-308, 1023.9999999999999, 1024.0})
    xs = sorted(x for x in xs if np.isfinite(x))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    a, b = ranks.value_digits(F.col("x"), True)
    got = [(r["a"], r["b"]) for r in df.select("i", a.alias("a"), b.alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("descending", [False, True])
def test_ordinal_positions(spark, descending):
    df, pdf = frame(spark, "ties")
    got = ranks.ordinal_positions(df, ["date"], "x", "pos", descending)
    got = {r["sid"]: r["pos"] for r in got.collect()}
    pdf["h"] = [hashlib.md5(s.encode()).hexdigest() for s in pdf.sid]
    for _, day in pdf.groupby("date"):
        ordered = day.sort_values(["x", "h"], ascending=[not descending, True]).sid
        assert [got[s] for s in ordered] == list(range(len(day)))


def test_ordinal_positions_leave_missing_out(spark):
    df, pdf = frame(spark, "gappy")
    got = {r["sid"]: r["pos"] for r in ranks.ordinal_positions(df, ["date"], "x", "pos").collect()}
    finite = pdf[np.isfinite(pdf.x)]
    assert all(got[s] is None for s in set(pdf.sid) - set(finite.sid))
    for _, day in finite.groupby("date"):
        assert sorted(got[s] for s in day.sid) == list(range(len(day)))


def test_quantiles_match_numpy(spark):
    df, pdf = frame(spark, "wide")
    got = ranks.quantiles(df, ["date"], "x", {"a": 0.01, "b": 0.5, "c": 0.75, "d": 1.0})
    got = {r["date"]: tuple(r)[1:] for r in got.collect()}
    for day, x in pdf.groupby("date").x:
        assert got[day] == pytest.approx([x.quantile(q) for q in (0.01, 0.5, 0.75, 1.0)], rel=1e-12)


@pytest.mark.parametrize("k, cells", [(1, 4), (7, 3), (50, 64), (1000, 2)])
def test_top_k(spark, k, cells):
    df, pdf = frame(spark, "ties")
    got = ranks.top_k(df, ["date"], [F.col("x").desc(), F.md5("sid").asc()], k, cells=cells).collect()
    pdf["h"] = [hashlib.md5(s.encode()).hexdigest() for s in pdf.sid]
    for day, rows in pdf.groupby("date"):
        want = list(rows.sort_values(["x", "h"], ascending=[False, True]).sid[:k])
        assert [r["sid"] for r in sorted((r for r in got if r["date"] == day), key=lambda r: r["top_pos"])] == want


def test_dense_codes(spark):
    rng = random.Random(2)
    texts = {"".join(rng.choice("ab.1") for _ in range(rng.randrange(0, 16))) for _ in range(300)} | {"é", "z", "aaaaaaaaaaaaab", "aaaaaaaaaaaaaa"}
    df = spark.createDataFrame([(t,) for t in texts] * 2, "sid string")
    got = {r["sid"]: r["code"] for r in ranks.dense_codes(df, "sid", "code").collect()}
    assert got == {t: i for i, t in enumerate(sorted(texts, key=lambda t: t.encode()))}


def test_dense_codes_behind_a_long_prefix(spark):
    """Identifiers that share their first characters are dealt into ranges like any others; adaptive merging of small ranges is off here."""
    df = spark.range(20000).select(F.concat(F.lit("a-long-common-prefix-"), F.lpad("id", 6, "0")).alias("sid"), "id")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        got = ranks.dense_codes(df, "sid", "code")
        plan = got._jdf.queryExecution().executedPlan().toString()
        placed = got.join(df, "sid").select("code", "id").collect()
    finally:
        spark.conf.set(merging, before)
    assert "rangepartitioning(sid" in plan or "FileScan" in plan
    assert len(placed) == 20000 and all(r["code"] == r["id"] for r in placed)


def test_one_day_holding_most_rows_is_not_one_task(spark):
    """No shuffle of a rank is keyed on the day alone, except for the small digit counts."""
    df = spark.range(20000).select(
        F.lit(DAYS[0]).alias("date"), F.col("id").cast("string").alias("sid"), F.rand(1).alias("x")
    )
    ranked = ranks.attach_ranks(df, ranks.value_ranks(df, ["date"], "x"), ["date"], "x", {"r": ranks.average_rank()})
    sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20000 and ranked.select(F.sum("r")).first()[0] == 20000 * 20001 / 2
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "Window [row_number" not in plan and "rank(" not in plan
