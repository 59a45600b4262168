"""WARC archives, vectors, mixing, packing and the pipeline against brute force, with odd rows."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import chosen_path, mixing, packing, queries, vector_join, warc
from panelwright.llm.common import shared_dir
from tests.compare import difference, duck


# --- WARC ----------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://b/\r\nx", "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"),
         (6, "u", "z" * 3_000_000), (None, "u", "<p>é</p>"), (None, "n", "only"), (7, "u", "\r\n\r\n"), (8, "u", "tail\r\n")]


def digest(html: str | None) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def warc_rows(spark, archive: str) -> list[tuple]:
    heads = warc.read(spark, archive, payload="none").filter("record_type = 'revisit'")
    full = warc.read(spark, archive).filter("record_type = 'response'")
    out = [(warc_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, None, bytes(r.payload)) for r in full.collect()]
    return out + [(warc_id(r.record_id), r.payload_bytes, r.declared_digest.removeprefix("sha1:"), r.record_type, warc_id(r.refers_to), None) for r in heads.collect()]


def warc_id(name: str | None) -> int | None:
    number = name[len("<urn:x-page:"):-1] if name else "none"
    return None if number == "none" else int(number)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_archives_round_trip(spark, compression, pushdown):
    before = spark.conf.get(warc.PUSHDOWN)
    spark.conf.set(warc.PUSHDOWN, pushdown)
    try:
        pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
        got = warc_rows(spark, warc.write_pages(pages, compression=compression, records_per_file=3))
        most = {}
        for page, _, html in PAGES:
            if page is not None or digest(html) not in most:
                most[digest(html)] = max(page or -1, most.get(digest(html), -1))
        expected = []
        for page, _, html in PAGES:
            body, d = (html or "").encode(), digest(html)
            first = (page if page is not None else -1) == most[d]
            expected.append((page, len(body), d, "response" if first else "revisit", None if first else most[d], body if first else None))
        assert sorted(got, key=str) == sorted(expected, key=str)
    finally:
        spark.conf.set(warc.PUSHDOWN, before)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    kinds = {warc_id(r.record_id): r.record_type for r in warc.read(spark, warc.write_pages(pages, min_bytes=3), payload="none").collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read(spark, warc.write_pages(pages.limit(0))).count() == 0


def test_predicates_reach_the_reader_and_foreign_records_are_read(spark, tmp_path):
    records = [b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 4\r\nWARC-Record-ID: <a>\r\n\r\nabcd\r\n\r\n",
               b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <b>\r\nX-Long: one\r\n two\r\nContent-Length: 6\r\n\r\n\r\n\r\nxy\r\n\r\n"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    before = spark.conf.get(warc.PUSHDOWN)
    spark.conf.set(warc.PUSHDOWN, "true")
    try:
        df = warc.read(spark, f"file://{tmp_path}").filter("record_type = 'resource' AND content_length > 3")
        rows = df.collect()
        assert [(r.record_id, bytes(r.payload), r.headers["x-long"]) for r in rows] == [("<b>", b"\r\n\r\nxy", "one two")] * 2
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan, plan
    finally:
        spark.conf.set(warc.PUSHDOWN, before)


def test_readers_skip_unwanted_payloads(tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 9000000\r\n\r\n" + b"\xff" * 9_000_000 + b"\r\n\r\n"
                                      + b"WARC/1.0\r\nWARC-Type: y\r\nContent-Length: 1\r\n\r\nq\r\n\r\n")
    reader = warc.WarcPushdownReader({"path": str(tmp_path), "payload": "full"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "y"), warc.EqualTo(("payload_bytes",), 1)]))
    assert len(left) == 1
    read = 0

    class Counting:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

    (part,) = reader.partitions()
    (batch,) = list(reader.read(part))
    assert batch.column("payload").to_pylist() == [b"q"] and read == 0
    assert isinstance(pafs.LocalFileSystem(), pafs.FileSystem)


# --- vectors -------------------------------------------------------------------------------------

def brute_nearest(rows: list[tuple], k: int) -> list[tuple]:
    best: dict[int, list] = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = max(best.get(i, v), v)
    out = []
    for q in sorted(best):
        if q % 50 == 0:
            a = np.array(best[q])
            near = sorted((-float(a @ np.array(v) / np.sqrt(a @ a) / np.sqrt(np.array(v) @ np.array(v))), i) for i, v in best.items() if i != q and len(v) == len(a))
            near = [(round(s, 12), i) for s, i in near]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k], 1)]
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_block": 3, "row_block": 20}, {"row_block": 2}])
def test_nearest_equals_brute_force(spark, blocks):
    rng = np.random.RandomState(4)
    rows = [(i, rng.randn(8).round(3).tolist()) for i in range(400)]
    rows += [(1_000 + i, rows[50][1]) for i in range(60)] + [(2_000, [-x for x in rows[0][1]]), (2_050, [0.0] * 8), (2_100, None), (2_150, [float("nan")] + [1.0] * 7),
             (2_200, [float("inf")] + [1.0] * 7), (2_250, []), (2_300, [1.0, 2.0]), (2_301, [2.0, 4.5]), (None, rows[0][1]), (100, rows[100][1]), (100, [9.0] * 8),
             (2_350, [None] + [1.0] * 7), (2_400, [1e200] * 8), (2_401, [1e-200] * 6 + [2e-200, 4e-200])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, dims int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_join.nearest(df, F.col("vec_id") % 50 == 0, **blocks).collect())
    scaled = [(i, [x / 1e200 for x in v] if i == 2_400 else [x * 1e200 for x in v] if i == 2_401 else v) for i, v in rows]
    expected = brute_nearest(scaled, 5)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-9)


def test_bounds_hold_and_tables_may_be_empty(spark):
    rng = np.random.RandomState(5)
    for x, centred in ((rng.randn(200, 1_500), False), (rng.randn(200, 300) + 2, True)):
        x, length = vector_join._units(x)
        u = x / length[:, None]
        mean = u.mean(axis=0) if centred else None
        codes, scale, along, decoded, error, rest = vector_join.quantise(x, length, mean)
        near = vector_join._products(codes, codes) * scale[:, None] * scale + along[:, None] + along + (mean @ mean if centred else 0)
        assert (np.abs(near - u @ u.T) <= decoded[:, None] * error + error[:, None] * rest + 1e-10).all()
    assert vector_join.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_few_pairs_of_a_tile_survive(shift):
    """With a common direction as well, which the mean takes off."""
    rng = np.random.RandomState(6)
    x, length = vector_join._units(rng.randn(3_000, 64) + shift)
    mean = (x / length[:, None]).mean(axis=0)
    codes, scale, along, decoded, error, rest = vector_join.quantise(x, length, mean)
    side = {"id": np.arange(3_000), "codes": codes, "scale": scale, "along": along, "decoded": decoded, "error": error, "rest": rest}
    asked = {n: a[:100] for n, a in side.items()}
    found = list(vector_join.survivors(asked, side, float(mean @ mean), 6))
    kept = {(r, c) for rows, columns, _, _ in found for r, c in zip(rows.tolist(), columns.tolist())}
    true = (x[:100] @ x.T) / length[:100, None] / length
    assert all((i, j) in kept for i in range(100) for j in np.argsort(-true[i])[:6].tolist()) and len(kept) < 100 * 40


def test_a_vector_of_a_third_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(3_000)] + [(50, [9.0, 9.0, 9.0]), (50, [1.0, 2.0, 3.0]), (60, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_join.nearest(df, F.col("vec_id") % 50 == 0, query_block=20, row_block=300).collect())
    best = {}
    for i, v in rows:
        if len(v) == 3:
            best[i] = max(best.get(i, v), v)
    expected = brute_nearest(sorted(best.items()), 5)
    assert [g[:3] for g in got] == [e[:3] for e in expected]


# --- mixing --------------------------------------------------------------------------------------

def source_rows(rng: random.Random) -> list[tuple]:
    rows = [(i, "big" if i % 3 else rng.choice(["a", "b", None]), rng.randrange(1, 200)) for i in range(6_000)]
    return rows + [(10_000 + i, "empty", 0) for i in range(5)] + [(20_000, "a", None), (5, "a", 7), (5, "a", 7), (None, None, 3)]


def test_exponent_meets_the_target(spark):
    df = spark.createDataFrame(source_rows(random.Random(1)), "doc_id long, source string, n long")
    totals = mixing.source_totals(df, "source", "n")
    shares = [r.share for r in totals.collect() if r.share > 0]
    a = mixing.solve_exponent(totals, entropy=0.95 * math.log(len(shares)))
    w = np.array(shares) ** a / (np.array(shares) ** a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.95 * math.log(len(shares)), abs=1e-6) and 0 < a < 1
    a = mixing.solve_exponent(totals, limit=2.0)
    assert max(shares) ** (1 - a) / min(shares) ** (1 - a) == pytest.approx(2, abs=1e-4)
    assert mixing.solve_exponent(totals, entropy=0.1) == 1.0


def test_mix_uses_rows_as_often_as_weights_say(spark):
    rows = source_rows(random.Random(2))
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, source string, n long, weight string")
    totals = mixing.source_totals(df, "source", "n")
    plan = mixing.weights(totals, 0.5, budget=400_000)
    out = mixing.mix(df, plan, "doc_id", "source", "n", block_rows=64)
    assert out.columns[:4] == ["doc_id", "source", "n", "weight"] and out.columns[4] == "weight_"
    want = {r.source: (r.repeats, r.tokens) for r in plan.collect()}
    used, times = collections.Counter(), collections.Counter()
    seen = out.collect()
    for r in seen:
        used[r.source] += r.n or 0
        times[(r.source, r.doc_id, r.n)] += 1
    for source, (repeats, tokens) in want.items():
        blocks = math.ceil(sum(1 for x in rows if x[1] == source) / 64)
        assert abs(used[source] - (repeats * tokens if tokens else 0)) <= 200 * blocks
    assert all(math.floor(want[s][0] + 1e-9) <= n <= math.ceil(want[s][0]) for (s, d, _), n in times.items() if d not in (5, None))
    places = collections.defaultdict(list)
    for r in seen:
        places[(r.source, r.block, r.epoch)].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    again = mixing.mix(df.repartition(5), plan, "doc_id", "source", "n", block_rows=64)
    assert again.select("doc_id", "epoch", "source").exceptAll(out.select("doc_id", "epoch", "source")).count() == 0


def test_rows_that_agree_spread_over_blocks(spark):
    df = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("n")).repartition(4)
    plan = mixing.weights(mixing.source_totals(df, "source", "n"), 1.0)
    out = mixing.mix(df, plan, "doc_id", "source", "n")
    sizes = [r["count"] for r in out.groupBy("block").count().collect()]
    assert sum(sizes) == 6_000 and max(sizes) < 2 * mixing.BLOCK_ROWS and out.columns[:3] == df.columns
    assert df.exceptAll(out.select(*df.columns)).count() == 0


def test_least_budget_uses_every_row(spark):
    df = spark.createDataFrame(source_rows(random.Random(3)), "doc_id long, source string, n long")
    totals = mixing.source_totals(df, "source", "n")
    out = mixing.mix(df, mixing.weights(totals, mixing.solve_exponent(totals, limit=2.0)), "doc_id", "source", "n")
    counts = [r["count"] for r in out.groupBy("source", "doc_id", "n").count().collect()]
    assert df.exceptAll(out.select(*df.columns)).count() == 0 and max(counts) <= 4
    empty = df.limit(0)
    none = mixing.source_totals(empty, "source", "n")
    assert mixing.mix(empty, mixing.weights(none, mixing.solve_exponent(none, limit=2.0)), "doc_id", "source", "n").count() == 0


# --- packing -------------------------------------------------------------------------------------

def test_packing_places_every_token_once(spark):
    rng = random.Random(6)
    rows = [(i if i % 11 else None, rng.choice([0, 1, 5, 80, 300, 511, 512, 513, 5_000, 40_000])) for i in range(700)] + [(3, None), (3, -4), (3, 17), (3, 17)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, n long, bin_id int")
    out = packing.pack(df, "doc_id", "n", shard_pieces=300).collect()
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in out:
        total[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    expected = collections.Counter()
    for i, n in rows:
        expected[i] += max(0, n or 0)
    assert total == expected and len(bins) < len(out)
    for own in bins.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and len({r.capacity for r in own}) == 1
        assert [r["at"] for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        used = sum(r.length for r in own)
        assert own[0].capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0


def test_pieces_go_where_they_leave_least_room():
    rng = random.Random(7)
    lengths = sorted((rng.randrange(1, 400) for _ in range(300)), reverse=True)
    sizes = (128, 256, 512)
    bins, offsets, caps, openings = packing.place(lengths, sizes, packing._hoped(lengths, sizes, [packing.sequence_cost(c) for c in sizes]))
    rooms: dict[int, int] = {}
    for i, (n, b) in enumerate(zip(lengths, bins)):
        fits = [r for r in rooms.values() if r >= n]
        if fits:
            assert rooms[b] == min(fits)
        else:
            assert b not in rooms
            left = sum(lengths[i + 1:])
            rooms[b] = min((packing.sequence_cost(c) / min(c, n + left), c) for c in sizes if c >= n)[1]
        rooms[b] -= n
    assert sum(lengths) >= 0.85 * sum(caps) and sum(openings.values()) == len(caps)


def paid(caps) -> float:
    return sum(map(packing.sequence_cost, caps))


def test_sizes_chosen_jointly_cost_less():
    rng = random.Random(1)
    mixes = [[rng.choice([rng.randrange(20, 120), rng.randrange(400, 900)]) for _ in range(4_000)], [rng.randrange(500, 620) for _ in range(4_000)],
             [rng.choice([350, 700, 1_500, 2_100]) for _ in range(4_000)], [min(8_192, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(4_000)]]
    gains = []
    for lengths in mixes:
        lengths.sort(reverse=True)
        price = [packing.sequence_cost(c) for c in packing.CAPACITIES]
        single = packing.place(lengths, packing.CAPACITIES, packing._hoped(lengths, packing.CAPACITIES, price))
        gains.append(1 - paid(packing.best_fit(lengths, packing.CAPACITIES)[2]) / paid(single[2]))
    assert min(gains) >= 0 and min(gains[:3]) > 0.01 and max(gains) > 0.2


def cheapest(lengths: list[int], sizes) -> float:
    """The least cost of all ways to put the pieces into bins."""
    best = [float("inf")]

    def go(i: int, bins: list[int]) -> None:
        spent = paid(min(c for c in sizes if c >= b) for b in bins)
        if spent >= best[0]:
            return
        if i == len(lengths):
            best[0] = spent
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_few_pieces_cost_nearly_the_least():
    rng, ratios = random.Random(3), []
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randrange(1, 400), rng.randrange(200, 1_500)]) for _ in range(rng.randrange(1, 9))), reverse=True)
        made = packing.best_fit(lengths, packing.CAPACITIES)
        ratios.append(paid(made[2]) / cheapest(lengths, packing.CAPACITIES))
        assert ratios[-1] >= 1 - 1e-9
    assert sum(ratios) / len(ratios) < 1.03 and max(ratios) < 1.3


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline_keeps_clean_documents_and_its_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, frames = [], [docs]
    for name, step in corpus_pipeline.STAGES:
        df = step(spark, frames[-1], sf)
        path = shared_dir(spark, "test-stage")
        df.write.parquet(path)
        frames.append(spark.read.parquet(path))
        names.append(name)
    assert all(f.columns == docs.columns for f in frames[:-1]) and len(names) == 5
    known, single, clean, mixed, packed = frames[1:]
    assert known.count() >= 0.99 * docs.count()
    links = chosen_path.near_duplicates(known)
    assert single.count() == links.filter("class_key is not null").select("class_key").distinct().count() + links.filter("class_key is null").count()
    assert clean.count() == single.count() and not any("password=" in (r.text or "") for r in clean.collect())
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    total = mixed.select(F.sum(packing.token_count("text"))).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == total


def test_pipeline_of_odd_rows(spark):
    texts = [None, "", "der und nicht das " * 30, "der und nicht das " * 30, "secret=abcdefgh the and of to " * 3, "the and of to in " * 40]
    docs = spark.createDataFrame([(i if i else None, t, ["de", "en", None][i % 3], ["s", None][i % 2], None, "x") for i, t in enumerate(texts * 2)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string")
    for df in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            df = step(spark, df, "")
            df.collect()


def test_registered():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert difference(queries.queries()[name](spark, sf), queries.oracle_sql()[name], duck(sf)) is None
