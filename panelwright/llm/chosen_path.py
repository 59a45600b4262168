"""Near-duplicate join on word shingles by chosen paths.

A text is the set of its five-word shingles. Texts with equal sets form one class and are joined once. Every class has
min-hashes; a min-hash is a token of the set that similar sets share with the probability of their Jaccard similarity. In each
of several runs all sets are split on one or two sampled min-hashes (1/threshold on average), so that sets meet under a path of shared
tokens; buckets still large are split again on tokens chosen by their path. Small buckets, and large ones that a split leaves
mostly whole, are compared by brute force on the full sets. A pair at the threshold survives a run with a known probability;
there are as many runs as reach the target recall.

Brute force works on tiles of a bucket, whose intersections are products of 0/1 matrices. It emits counts and spanning links for each member, not pairs,
so a group of n texts costs rows in proportion to n. A pair that shares several buckets is counted in the first by rank (size, then path);
members who met in an earlier large bucket are not compared again.

Shingles are 32-bit hashes inside tiles and 64-bit ones elsewhere: of ten billion classes about three pairs would be taken for equal by chance.

Defined cases: null texts and texts without words link to nothing; a text of one to four words is one shingle; rows may repeat an id, a null id ranks
after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import long_array, mix, slices, stage, windows, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
DEPTH = 3
HASHES = 32
LEAF = 1_024  # members of a bucket that is compared without a further split
TILE = 4_096  # members of a tile at most; a bucket of over a quarter of them is cut in PARTS tiles, of an eighth at least, so that no task gets much more than others
PARTS = 24
TILE_TOKENS = 2_000_000
DENSE = 0.5  # a bucket whose largest part keeps this share is not split
COLUMNS = 2_048  # shingles of one product

_SEED = np.random.RandomState(7_919)
_XOR, _TIMES = (((_SEED.randint(0, 2**32, HASHES, dtype=np.uint64) << np.uint64(32)) | _SEED.randint(0, 2**32, HASHES, dtype=np.uint64)) for _ in range(2))
_TIMES = _TIMES | np.uint64(1)


# --- recall ----------------------------------------------------------------------------------------

def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold meets in a bucket at the given depth of one run."""
    more, p = 1 / threshold - 1, 1.0
    for _ in range(depth):
        one = threshold * p
        p = (1 - more) * one + more * (1 - (1 - one) ** 2)
    return p


def runs_for(threshold: float, recall: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))


def root_picks(threshold: float, runs: int) -> int:
    """Min-hashes that the roots of all runs use: one each, and a second in the share 1/threshold - 1 of them."""
    return runs + math.ceil(runs * (1 / threshold - 1))


# --- sets ------------------------------------------------------------------------------------------

def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Texts with words, and their sorted distinct shingles end to end with bounds."""
    w = words(texts)
    hashes, place = windows(w, size)
    bounds = np.searchsorted(place, w.first)
    filled = np.flatnonzero(np.diff(bounds)).tolist()
    sets = [np.unique(hashes[bounds[i]:bounds[i + 1]]) for i in filled]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return filled, flat, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketch(docs: DataFrame, id_column: str, text: str, picks: int, size: int = SHINGLE) -> DataFrame:
    """id, text_hash, and for texts with words: class, number of shingles, root paths, min-hashes and 32-bit shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            filled, flat, bounds = shingle_sets(batch.column("text"), size)
            n = np.diff(bounds)
            mins = np.empty((len(filled), HASHES), np.uint64)
            node, small = np.zeros(0, np.uint64), []
            if filled:
                for k in range(HASHES):
                    mins[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], bounds[:-1])
                node = mix(np.add.reduceat(flat, bounds[:-1]) ^ mix(np.add.reduceat(flat * flat, bounds[:-1]) + n.astype(np.uint64)))
                short = (flat >> np.uint64(32)).astype(np.uint32)
                small = [np.unique(short[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
            paths = mix(mins[:, :picks] + np.arange(1, picks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            every = np.full(batch.num_rows, -1)
            every[filled] = np.arange(len(filled))
            take = pa.array(every, mask=every < 0)
            columns = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), long_array(paths.ravel(), np.arange(len(filled) + 1) * picks),
                       pa.array([m.tobytes() for m in mins], pa.binary()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), *[c.take(take) for c in columns]],
                                             ["id", "text_hash", "node", "n", "paths", "mins", "shingles"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    made = rows.mapInArrow(describe, f"id {kind}, text_hash long, node long, n int, paths array<long>, mins binary, shingles binary")
    return stage(made.withColumn("row", F.monotonically_increasing_id()), "sketch")


# --- buckets ---------------------------------------------------------------------------------------

def _children(threshold: float, picks: int):
    """Split members of large buckets on one or two min-hashes chosen by their path."""
    more = 1 / threshold - 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy().view(np.uint64)
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint64).reshape(-1, HASHES)
            free = np.uint64(HASHES - picks)
            out = []
            for k in range(2):
                h = mix(path + np.uint64(0xA24BAED4963EE407 * (k + 1) % 2**64))
                use = np.ones(len(path), bool) if k == 0 else (mix(path) >> np.uint64(11)).astype(float) / 2.0**53 < more
                at = picks + (h % free).astype(np.int64)
                out.append((np.flatnonzero(use), mix(h ^ mins[np.arange(len(path)), at])[use]))
            rows = np.concatenate([o[0] for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[1] for o in out]).view(np.int64)), batch.column("path").take(pa.array(rows)),
                                              batch.column("node").take(pa.array(rows))], ["path", "parent", "node"])

    return split


def _sized(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of two members or more with their size and a fingerprint of the members; the members left."""
    sizes = stage(members.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("print")).filter("size > 1"), "bucket-sizes")
    return sizes, members.join(sizes.select("path", "size"), "path")


def _of_nodes(wide: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """wide (by row) with the columns of classes, for the classes of the members only: a shuffled join at every size, as their number grows with the data."""
    return wide.join(stage(members.select("node").distinct().join(classes, "node"), "member-classes").hint("merge"), "row").drop("row")


def buckets(classes: DataFrame, sketches: DataFrame, threshold: float, picks: int, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """path, node, size of every bucket to compare; buckets with the same members appear once."""
    members = classes.select(F.explode("paths").alias("path"), "node")
    leaves, prints, level = [], [], 1
    while True:
        sizes, members = _sized(members)
        large = sizes.filter(F.col("size") > leaf)
        if level == depth or large.isEmpty():
            leaves.append(members.select("path", "node", "size"))
            prints.append(sizes)
            break
        members = stage(members.select("path", "node", "size"), "bucket-members")
        leaves.append(members.filter(F.col("size") <= leaf))
        prints.append(sizes.filter(F.col("size") <= leaf))
        big = members.filter(F.col("size") > leaf)
        mins = _of_nodes(sketches.select("row", "mins"), big, classes.select("node", "row"))
        parts = stage(big.join(mins, "node").select("path", "node", "mins")
                      .mapInArrow(_children(threshold, picks), "path long, parent long, node long"), "bucket-parts")
        most = parts.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("part")).groupBy("parent").agg(F.max("part").alias("part"))
        whole = stage(large.join(most, large["path"] == most["parent"]).filter(F.col("part") >= DENSE * F.col("size")).select("path", "size", "print"), "bucket-whole")
        leaves.append(big.join(whole.select("path"), "path", "left_semi"))
        prints.append(whole)
        members = parts.join(whole.select(F.col("path").alias("parent")), "parent", "left_anti").select("path", "node")
        level += 1

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    chosen = stage(union(prints).groupBy("size", "print").agg(F.min("path").alias("path")).select("path"), "buckets-chosen")
    return stage(union(leaves).join(chosen, "path", "left_semi"), "buckets")


def _tiles(members: DataFrame, tile: int, tile_tokens: int) -> DataFrame:
    """path, low, high, side, node, earlier: a row for each tile pair that a member takes part in. earlier: the node's buckets of better rank.

    Buckets that make one tile have the pair (0, 0). In others members who share their first bucket, if they are many, form a
    group of tiles that is not paired with itself: that bucket has compared them.
    """
    rank = F.struct((-F.col("size")).alias("less"), "path")
    lists = members.groupBy("node").agg(F.sort_array(F.collect_list(rank)).alias("all"))
    members = members.join(lists, "node")  # a node has few buckets, so no key is large here
    own = F.struct((-F.col("size")).alias("less"), "path")
    members = stage(members.withColumn("earlier", F.transform(F.filter("all", lambda x: x < own), lambda x: x["path"]))
                    .withColumn("first", F.col("all")[0]["path"]).drop("all"), "bucket-ranks")
    weight = stage(members.groupBy("path").agg(F.sum(F.col("n").cast("long")).alias("tokens"), F.count(F.lit(1)).alias("count")), "bucket-weights")
    wide = (F.col("tokens") > tile_tokens) | (F.col("count") > tile / 4)
    single = members.join(weight.filter(wide).select("path"), "path", "left_anti").select(
        "path", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"), "node", "earlier")
    large = weight.filter(wide).select("path")
    if large.isEmpty():
        return single
    many = members.join(large, "path", "left_semi")
    firsts = stage(many.groupBy("path", "first").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("n").cast("long")).alias("tokens")), "bucket-firsts")
    group = F.when((F.col("first") != F.col("path")) & (F.col("count") >= tile / 4), F.col("first")).otherwise(F.col("path"))
    groups = firsts.withColumn("group", group).groupBy("path", "group").agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens"))
    held = F.least(F.lit(float(tile)), F.greatest(F.lit(tile / 8), F.col("count") / PARTS))
    parts = F.greatest(F.ceil(F.col("count") / held), F.ceil(F.col("tokens") / tile_tokens)).cast("int")
    layout = groups.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("group", parts.alias("parts")))).alias("layout"))
    index = F.flatten(F.transform("layout", lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda i: F.struct(x["group"].alias("group"), i.alias("part")))))
    layout = stage(layout.select("path", index.alias("layout")), "bucket-layout")
    named = firsts.select("path", "first", group.alias("group"))
    rows = many.join(stage(named, "bucket-groups"), ["path", "first"]).join(layout, "path")
    mine = F.filter("layout", lambda x: x["group"] == F.col("group"))
    here = F.struct("group", F.pmod(F.xxhash64("node"), F.size(mine)).cast("int").alias("part"))
    rows = rows.withColumn("here", (F.array_position("layout", here) - 1).cast("int"))
    partners = F.filter(F.transform("layout", lambda x, i: F.when((x["group"] == F.col("group")) & (F.col("group") != F.col("path")), F.lit(-1)).otherwise(i)),
                        lambda i: i >= 0)
    rows = rows.select("path", "node", "earlier", "here", F.explode(partners).alias("there"))
    paired = rows.select("path", F.least("here", "there").alias("low"), F.greatest("here", "there").alias("high"),
                         (F.col("here") > F.col("there")).cast("int").alias("side"), "node", "earlier")
    return single.unionByName(paired)


# --- brute force -----------------------------------------------------------------------------------

def _incidence(row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    out[row, column] = 1
    return out


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of values that each left set has in common with each right set. Of a tile with itself the diagonal is not meant: values
    of one member only, which near copies have many of, are left out."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    if not len(a) or not len(b):
        return out
    if left is right:
        common, times = np.unique(a, return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(a, b)
    rows = []
    for flat, sets in ((a, left), (b, right)):
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        rows.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        sides = []
        for (row, column), sets in zip(rows, (left, right)):
            inside = (column >= low) & (column < low + width)
            sides.append(_incidence(row[inside], column[inside] - low, (len(sets), width)))
        out += sides[0] @ sides[1].T
    return out


def compare(left: dict, right: dict | None, threshold: float) -> list[tuple[int, int, int, int]]:
    """(node, links to texts, links to documents, root) of the members of a tile, or of two. links: counted here first;
    root: least member among all that are linked here. Members without any link are left out."""
    other = left if right is None else right
    common = _shared(left["sets"], other["sets"])
    a, b = (np.array([len(s) for s in x["sets"]], np.float64) for x in (left, other))
    linked = common.astype(np.float64) * (1 + threshold) >= threshold * (a[:, None] + b) - 1e-6
    linked &= np.array(left["node"])[:, None] != np.array(other["node"])
    if not linked.any():
        return []
    new = linked & ~(_shared(left["earlier"], other["earlier"]) > 0) if any(map(len, left["earlier"])) and any(map(len, other["earlier"])) else linked
    copies, other_copies = np.array(left["copies"], np.float64), np.array(other["copies"], np.float64)
    nodes = np.array(left["node"] if right is None else left["node"] + right["node"], np.int64)
    texts, docs = new.sum(axis=1), new @ other_copies
    if right is not None:
        texts, docs = np.append(texts, new.sum(axis=0)), np.append(docs, copies @ new)
    root, size = nodes.copy(), len(left["node"])
    while True:  # the least node spreads along links
        x, y = (root, root) if right is None else (root[:size], root[size:])
        far = np.iinfo(np.int64).max
        up = np.minimum(x, _least(linked, y, far))
        new_root = up if right is None else np.append(up, np.minimum(y, _least(linked.T, up, far)))
        if (new_root == root).all():
            break
        root = new_root
    seen = linked.any(axis=1) if right is None else np.append(linked.any(axis=1), linked.any(axis=0))
    return [(n, int(t), int(d), r) for n, t, d, r, s in zip(nodes.tolist(), texts.tolist(), docs.tolist(), root.tolist(), seen.tolist()) if s]


def _least(linked: np.ndarray, value: np.ndarray, far: int, rows: int = 256) -> np.ndarray:
    return np.concatenate([np.where(linked[i:i + rows], value, far).min(axis=1) for i in range(0, len(linked), rows)])


def _compare_all(threshold: float):
    """Compare the members of each tile pair, which arrive together, and merge what is said of a node in this task."""
    names = ("node", "copies", "sets", "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ({n: [] for n in names}, {n: [] for n in names})
        links: dict[int, list[int]] = {}
        edges: set[tuple[int, int]] = set()

        def close() -> None:
            left, right = held
            if key is None or not left["node"] or (key[1] == key[2] and len(left["node"]) < 2) or (key[1] != key[2] and not right["node"]):
                return
            for node, texts, docs, root in compare(left, right if key[1] != key[2] else None, threshold):
                total = links.setdefault(node, [0, 0])
                total[0] += texts
                total[1] += docs
                if node != root:
                    edges.add((node, root))

        def flush() -> pa.RecordBatch:
            rows = [(n, t, d, n) for n, (t, d) in links.items()] + [(n, 0, 0, r) for n, r in edges]
            links.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["node", "texts", "docs", "root"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "low", "high", "side", "node", "copies", "shingles", "earlier")]
            for path, low, high, side, node, copies, shingles, earlier in zip(*columns):
                if (path, low, high) != key:
                    close()
                    key, held = (path, low, high), ({n: [] for n in names}, {n: [] for n in names})
                    if len(links) + len(edges) > 200_000:
                        yield flush()
                to = held[side]
                to["node"].append(node)
                to["copies"].append(copies)
                to["sets"].append(np.frombuffer(shingles, np.uint32))
                to["earlier"].append(np.array(earlier, np.int64))
        close()
        yield flush()

    return run


# --- components ------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes but the roots, by alternating large and small stars."""

    def measured(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = stage(df, "component-edges")
        return df, tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now, mark = measured(edges.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).filter("u > v").distinct())
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "component-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")
        now, after = measured(large.join(least, "u").select(pairs).select("p.u", "p.v").filter("u > v").distinct())
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the join --------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE,
                    recall: float = RECALL, leaf: int = LEAF, tile: int = TILE, tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """A row per row of docs: its id, text_hash, class_id (least id of all texts connected by links), class_key (the same classes as a number, null
    without words), copy_id (least id among texts with the same shingles), n_copies, n_links (other documents within the threshold, copies
    included), n_text_links (other sets of shingles within it) and class_size."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the number of samples assumes a threshold over a half")
    picks = root_picks(threshold, runs_for(threshold, recall, DEPTH))
    if picks >= HASHES:
        raise ValueError(f"a recall of {recall} at {threshold} needs more than {HASHES} min-hashes")
    sketches = sketch(docs, id_column, text, picks, size)
    classes = stage(sketches.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("copy_id"), F.min("row").alias("row"), F.max("n").alias("n"), F.first("paths").alias("paths")), "classes")
    members = buckets(classes, sketches, threshold, picks, leaf=leaf).join(classes.select("node", "n"), "node")
    rows = stage(_tiles(members, tile, tile_tokens), "tiles")
    shingles = _of_nodes(sketches.select("row", "shingles"), rows, classes.select("node", "row", "copies"))
    compared = (rows.join(shingles, "node").select("path", "low", "high", "side", "node", "copies", "shingles", "earlier")
                .repartition("path", "low", "high").sortWithinPartitions("path", "low", "high", "side", "node"))
    found = stage(compared.mapInArrow(_compare_all(threshold), "node long, texts long, docs long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.filter("node != root").select("node", "root"))
    joined = stage(classes.drop("paths", "row").join(links, "node", "left").join(roots, "node", "left")
                   .withColumn("class_key", F.coalesce("root", "node")), "class-links")
    whole = stage(joined.groupBy("class_key").agg(F.min("copy_id").alias("class_id"), F.sum("copies").alias("class_size")), "class-ids")
    nodes = stage(joined.join(whole, "class_key"), "class-rows")

    def output(class_id: str, key: Column, copy_id: str, copies: Column, linked: Column, texts: Column, members: Column) -> list[Column]:
        return [F.col("id").alias(id_column), F.col("text_hash"), F.col(class_id).alias("class_id"), key.alias("class_key"), F.col(copy_id).alias("copy_id"),
                copies.alias("n_copies"), linked.alias("n_links"), texts.alias("n_text_links"), members.alias("class_size")]

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    texts = F.coalesce("texts", none)
    full = sketches.filter("node is not null").select("id", "text_hash", "node").join(nodes, "node").select(
        *output("class_id", F.col("class_key"), "copy_id", F.col("copies"), F.coalesce("docs", none) + F.col("copies") - 1, texts, F.col("class_size")))
    empty = sketches.filter("node is null").select(*output("id", F.lit(None).cast("long"), "id", one, none, none, one))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the least id. Rows of the class that repeat that id go as well, but one."""
    found = near_duplicates(docs, id_column, text, **options).filter("class_size > 1")
    found = stage(found.select(id_column, "text_hash", "class_key", "class_id"), "near-duplicates")
    lost = stage(found.filter(~F.col(id_column).eqNullSafe(F.col("class_id"))).select(F.col(id_column).alias("lost_id"), F.col("text_hash").alias("lost_hash")).distinct(), "lost").hint("merge")
    hashed = F.xxhash64(text)
    kept = docs.join(lost, docs[id_column].eqNullSafe(lost["lost_id"]) & (hashed == lost["lost_hash"]), "left_anti")
    repeated = stage(found.filter(F.col(id_column).eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("class_key"), "repeated")
    if repeated.isEmpty():
        return kept
    keys = found.join(repeated, "class_key", "left_semi").select(F.col(id_column).alias("again_id"), F.col("text_hash").alias("again_hash"), "class_key").distinct()
    marked = kept.join(stage(keys, "again"), kept[id_column].eqNullSafe(F.col("again_id")) & (F.xxhash64(text) == F.col("again_hash")), "left")
    single = marked.filter("class_key is null").select(*[kept[c] for c in docs.columns])
    return single.unionByName(marked.filter("class_key is not null").dropDuplicates(["class_key"]).select(*[kept[c] for c in docs.columns]))
