"""Nearest neighbours by a block matrix join.

Vectors that are equal form one class, which is searched once. Unit vectors less their mean are quantised to int8 with a scale of their own, and only these codes
go through the shuffle of the join: queries and candidates are dealt into blocks by a hash of their ids, and every (query block, candidate block) pair is
one task group: a tile. With u = m + a and v = m + b, the cosine is m.m + m.a + m.b + a.b; the first three are kept exactly for each vector, and products of the
int8 tiles give a.b up to a bound that follows from the sizes of the rounding errors (|a.b - a'.b'| <= |a'||b - b'| + |a - a'||b|). Candidates whose upper bound
reaches the k-th largest lower bound survive, first in their tile, then among all tiles. The survivors alone meet the original vectors, are
recomputed in double precision, and go through a heap of size k in every task before the last merge. The result is exact: nothing is pruned that could belong to it.

Defined cases: vectors null, empty, zero, or holding null or non-finite components take no part, nor do rows without id; of rows with the
same id the greatest vector (compared component by component) counts; an id is not its own neighbour; vectors of different
lengths are not compared; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import stage

QUERY_BLOCK = 2_048
ROW_BLOCK = 8_192
CHUNK = 1_024  # candidate rows of a product
CENTRED = 64  # lengths of vectors, the commonest, whose mean is taken off; the others only prune less
_CODES = "id long, asks boolean, dims int, codes binary, scale double, along double, decoded double, error double, rest double"
_PAIRS = pa.schema([("dims", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite, some component not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles scaled by a power of two, which changes no cosine and keeps squares finite, and their lengths."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def quantise(x: np.ndarray, length: np.ndarray, mean: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """int8 codes of the unit vectors less the mean, their scale, the product of mean and rest, and the lengths of the decoded rest, of the
    rounding error and of the rest."""
    u = x / length[:, None]
    along = np.zeros(len(u))
    if mean is not None:
        u = u - mean
        along = u @ mean
    scale = np.maximum(np.abs(u).max(axis=1), 1e-300) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, along, *(np.sqrt((m * m).sum(axis=1)) for m in (decoded, u - decoded, u))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exact: float32 holds sums below 2**24, so columns go in groups of a thousand."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1_000):
        out += a[:, at:at + 1_000].astype(np.float32) @ b[:, at:at + 1_000].astype(np.float32).T
    return out


def survivors(q: dict[str, np.ndarray], v: dict[str, np.ndarray], base: float, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Query and candidate places, lower and upper bound of the cosine, of every pair of a tile that can be among the query's k nearest."""
    least = np.full((len(q["id"]), k), -3.0)  # the k largest lower bounds of each query so far, the least of them first
    held: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(v["id"]), CHUNK):
        own = {n: x[at:at + CHUNK] for n, x in v.items()}
        near = _products(q["codes"], own["codes"]) * q["scale"][:, None] * own["scale"]
        near += base + q["along"][:, None] + own["along"]
        # What rounding in this sum can add is far below the last term.
        bound = q["decoded"][:, None] * own["error"] + q["error"][:, None] * own["rest"] + 1e-10
        low = near - bound
        best = np.partition(np.concatenate([least, low], axis=1), low.shape[1], axis=1)[:, low.shape[1]:]
        least = np.sort(best, axis=1)
        rows, columns = np.nonzero(near + bound >= least[:, :1])
        held.append((rows, columns + at, low[rows, columns], (near + bound)[rows, columns]))
    for rows, columns, low, high in held:
        keep = high >= least[rows, 0]
        yield rows[keep], columns[keep], low[keep], high[keep]


def _side(table: pa.Table) -> dict[str, np.ndarray]:
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(table.num_rows, -1)
    return {"codes": codes} | {n: table.column(n).to_numpy() for n in ("id", "scale", "along", "decoded", "error", "rest")}


def _one_per_id(part: DataFrame) -> DataFrame:
    """id, dims, v, asks: of rows with the same id and length the greatest vector. Only ids that repeat are gathered, by partial maxima."""
    repeated = stage(part.groupBy("id", "dims").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "dims"), "repeated-ids")
    if repeated.isEmpty():
        return part
    again = part.join(repeated, ["id", "dims"], "left_semi").groupBy("id", "dims").agg(F.max("v").alias("v"), F.max("asks").alias("asks"))
    return part.join(repeated, ["id", "dims"], "left_anti").unionByName(again.select(*part.columns))


def _means(part: DataFrame) -> dict[int, np.ndarray]:
    """Mean unit vector of the commonest lengths; it need not be exact, for it only makes codes finer."""
    square = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    common = [r.dims for r in part.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(CENTRED).collect()]
    sized = part.filter(F.col("dims").isin(common)).withColumn("size", square).filter("size > 1e-150 and size < 1e150")
    unit = array_to_vector(F.transform("v", lambda x: x.cast("double") / F.col("size")))
    found = sized.groupBy("dims").agg(vector_to_array(Summarizer.mean(unit)).alias("mean")).collect()
    return {r.dims: np.array(r["mean"]) for r in found}


def _encoded(classes: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = pa.Table.from_batches([batch]).filter(pa.array(dims == d))
                for at in range(0, own.num_rows, CHUNK):
                    part = own.slice(at, CHUNK)
                    x, length = _units(_matrix(part, "v"))
                    codes, *numbers = quantise(x, length, means.get(d))
                    columns = [part.column(n).combine_chunks() for n in ("id", "asks", "dims")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, numbers)],
                                                     ["id", "asks", "dims", "codes", "scale", "along", "decoded", "error", "rest"])

    return stage(classes.mapInArrow(encode, _CODES), "codes")


def _scored(k: int):
    """Cosines of (query_id, vec_id, q, v) rows in double precision; of a query's rows in a task only the k best go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}

        def flush() -> pa.RecordBatch:
            flat = [(*q, -vec, score) for q, h in heaps.items() for score, vec in h]
            heaps.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], ["dims", "query_id", "vec_id", "score"])

        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = pa.Table.from_batches([batch]).filter(pa.array(dims == d))
                for at in range(0, own.num_rows, CHUNK):
                    part = own.slice(at, CHUNK)
                    (q, q_length), (v, length) = (_units(_matrix(part, n)) for n in ("q", "v"))
                    scores = (q * v).sum(axis=1) / (q_length * length)
                    for query, vec, score in zip(part.column("query_id").to_pylist(), part.column("vec_id").to_pylist(), scores.tolist()):
                        heap = heaps.setdefault((d, query), [])
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -vec))
                        elif (score, -vec) > heap[0]:
                            heapq.heapreplace(heap, (score, -vec))
            if len(heaps) > 100_000:
                yield flush()
        yield flush()

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest cosine to each query row, nearest first.

    is_query selects the query rows. Codes of both sides are shuffled once into tiles: a query goes to every candidate block and
    a candidate to every query block.
    """
    part = rows.filter(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("id"), F.size(vector).alias("dims"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    part = stage(_one_per_id(part).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}), "vectors")  # 128 bits of hash stand for a vector
    same, wanted = ["dims", "h", "g"], k + 1  # a class may hold the query itself
    shared = stage(part.groupBy(*same).agg(F.min("id").alias("class"), F.max("asks").alias("any"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared-vectors")
    # Of a class only its least ids can be among the nearest; the least stands for it. Ranks are cut in the map tasks first.
    place = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    listed = part.select("id", *same).join(shared.select(*same), same, "left_semi").withColumn("place", place).filter(F.col("place") <= wanted)
    members = stage(listed.groupBy(*same).agg(F.min("id").alias("vec_id"), F.sort_array(F.collect_list("id")).alias("ids")).select("dims", "vec_id", "ids"), "class-members")
    marked = part.join(shared, same, "left")
    asking = marked.filter("asks").select(F.col("id").alias("query_id"), F.coalesce("class", "id").alias("asker"), "dims")
    classes = stage(marked.filter(F.col("class").isNull() | (F.col("class") == F.col("id"))).select("id", F.coalesce("any", "asks").alias("asks"), "dims", "v"), "class-vectors")
    means = _means(classes)
    codes = _encoded(classes, means)
    n_rows, n_queries = codes.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_queries / query_block))
    block = F.xxhash64("id")

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.drop("asks").select("*", F.pmod(block, F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    asked, candidates = dealt(codes.filter("asks"), "qblock", query_blocks, "cblock", row_blocks), dealt(codes, "cblock", row_blocks, "qblock", query_blocks)

    def tiles(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        mean = means.get(key[0].as_py())
        q, v = _side(left), _side(right)
        found = [pa.Table.from_arrays([pa.array(np.full(len(r), key[0].as_py(), np.int32)), pa.array(q["id"][r]), pa.array(v["id"][c]), pa.array(low), pa.array(high)], schema=_PAIRS)
                 for r, c, low, high in survivors(q, v, 0.0 if mean is None else float(mean @ mean), wanted)]
        return pa.concat_tables(found)

    keys = ("dims", "qblock", "cblock")
    pairs = stage(asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tiles, "dims int, query_id long, vec_id long, low double, high double"), "survivors")
    asks = ["dims", "query_id"]
    strong = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*asks).orderBy(F.desc("low"), "vec_id"))).filter(F.col("place") <= wanted)
    least = strong.groupBy(*asks).agg(F.when(F.count(F.lit(1)) == wanted, F.min("low")).otherwise(-3.0).alias("least"))
    pairs = stage(pairs.join(least, asks).filter(F.col("high") >= F.col("least")).select(*asks, "vec_id"), "candidates")
    vectors = classes.select("id", "dims", "v")
    joined = (pairs.join(vectors.withColumnRenamed("id", "vec_id"), ["dims", "vec_id"])
              .join(vectors.select(F.col("id").alias("query_id"), "dims", F.col("v").alias("q")), asks))
    scored = stage(joined.mapInArrow(_scored(wanted), "dims int, query_id long, vec_id long, score double"), "scored")

    def ranked(df: DataFrame, by: list[str], most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    opened = ranked(scored, asks, wanted).drop("rank").join(members, ["dims", "vec_id"], "left")
    opened = opened.select("dims", F.col("query_id").alias("asker"), F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id"), "score")
    found = asking.join(ranked(opened, ["dims", "asker"], wanted).drop("rank"), ["dims", "asker"]).filter(F.col("query_id") != F.col("vec_id"))
    return ranked(found.select("query_id", "vec_id", "score"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")
