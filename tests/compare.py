"""Run registered queries against their SQL twins: python tests/compare.py SF_DIR [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time() else v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=lambda t: tuple((x is not None, str(x)) for x in t))


def difference(spark_df, sql: str, con) -> str | None:
    """None when both sides agree, else a short account of the first difference."""
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"{dict(zip(got[0], a))} != {dict(zip(want[0], b))}"
    return None


def main() -> None:
    import __spark_entry__ as contract
    from tests.conftest import make_spark

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_spark(), duck(sf_dir)
    queries, oracle = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                diff = difference(df, oracle[name], con)
            else:
                diff = None if df.count() else "no rows"
        except Exception as err:
            diff = f"{type(err).__name__}: {str(err)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("orphans:", sorted(set(oracle) - set(queries)), "without sql:", sorted(set(queries) - set(oracle)), "bad:", bad)


if __name__ == "__main__":
    main()
