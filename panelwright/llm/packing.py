"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths.

A text longer than the largest capacity is cut into pieces, all full but the last; no token is dropped. Pieces
are dealt evenly over shards of bounded size, without a key, so no source or id can fill a shard. In a shard they are
placed longest first into the open bin with the least room that holds them; if there is none, a bin is opened. The sizes to open are chosen jointly: whole
placements under several rules and size tables are priced and the cheapest is kept. At the end
each bin shrinks to the smallest capacity that holds its contents.

Defined cases: null, zero and negative lengths count as 0 and take a place in a bin without room of their own; ids may be null or repeat,
every row is placed; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import WORD, stage

CAPACITIES = (512, 1_024, 2_048, 4_096, 8_192)
SHARD_PIECES = 32_768
LOOK_AHEAD = (1, 2, 4, 8)
KINDS_TRIED = 16  # kinds of length whose size is varied in the search; the others keep the best common size
_OUT = "piece int, start long, length long, bin_id long, position int, at long, capacity long"


def token_count(text: str) -> Column:
    """Words and one end token; a null text has the end token only."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) + 1).cast("long")


def sequence_cost(capacity: int, overhead: float = 64.0, quadratic: float = 16_384.0) -> float:
    """Cost of one sequence: a share linear in its length, one quadratic (attention), one fixed."""
    return overhead + capacity + capacity * capacity / quadratic


Rule = Callable[[int, int], int]  # (pieces placed so far, length of the next one) -> capacity of the bin to open for it


def place(lengths: Sequence[int], sizes: Sequence[int], rule: Rule) -> tuple[list[int], list[int], list[int], Counter]:
    """For pieces in falling length and rising sizes: bin and offset of each, the final capacity of each bin, and how often a kind of length opened one."""
    rooms: list[int] = []  # distinct rooms of open bins, rising
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets, openings = [], [], Counter()
    for at, n in enumerate(lengths):
        i = bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
        else:
            room = rule(at, n)
            openings[kind_of(n)] += 1
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room in open_bins:
            open_bins[room].append(b)
        else:
            open_bins[room] = [b]
            insort(rooms, room)
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used], openings


def kind_of(n: int) -> tuple[int, int]:
    """Lengths within a quarter of an octave."""
    return n.bit_length(), n >> max(0, n.bit_length() - 3)


def _hoped(lengths: Sequence[int], sizes: Sequence[int], price: Sequence[float]) -> Rule:
    """The size that costs least for each token it could hold of all that are left."""
    left = [*accumulate(reversed(lengths))][::-1]
    return lambda at, n: min((p / max(1, min(c, left[at])), c) for p, c in zip(price, sizes) if c >= n)[1]


def _looking_ahead(lengths: Sequence[int], sizes: Sequence[int], price: Sequence[float], steps: int) -> Rule:
    """The size that costs least for each token, once shrunk, if it took the largest pieces that fit of those left, up to `steps` of them."""
    rising = lengths[::-1]

    def rule(at: int, n: int) -> int:
        best = None
        for c in sizes:
            if c >= n:
                room, left, fill = c - n, len(rising) - at - 1, n
                for _ in range(steps):
                    left = bisect_right(rising, room, 0, left) - 1
                    if left < 0 or not rising[left]:
                        break
                    fill, room = fill + rising[left], room - rising[left]
                found = (price[bisect_left(sizes, fill)] / max(1, fill), c)
                best = found if best is None else min(best, found)
        return best[1]

    return rule


def _by_kind(sizes: Sequence[int], chosen: dict[tuple[int, int], int]) -> Rule:
    return lambda at, n: next(c for c in sizes if c >= max(n, chosen.get(kind_of(n), 0)))


def best_fit(lengths: Sequence[int], capacities: Sequence[int], cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """For pieces in falling length: bin and offset of each, and the final capacity of each bin.

    What a size is worth to one piece depends on the sizes that all others open, so whole placements are compared, each with its bins shrunk to their contents:
    those of rules that look at the pieces left, and those of a size for each kind of length, where the kinds that open most bins try every other
    size in turn and keep it if the sum falls."""
    sizes = sorted(capacities)
    price = [cost(c) for c in sizes]
    paid = dict(zip(sizes, price))

    def tried(rule: Rule) -> tuple[float, tuple]:
        made = place(lengths, sizes, rule)
        return sum(map(paid.__getitem__, made[2])), made

    def cheaper(a: tuple, b: tuple) -> tuple:
        return b if b[0] < a[0] else a

    best = reduce(cheaper, [tried(r) for r in (_hoped(lengths, sizes, price), *[_looking_ahead(lengths, sizes, price, k) for k in LOOK_AHEAD])])
    kinds = {kind_of(n) for n in lengths}
    starts = [{k: c for k in kinds} for c in sizes]
    chosen = min(starts, key=lambda s: tried(_by_kind(sizes, s))[0])
    own = tried(_by_kind(sizes, chosen))
    for kind, _ in sorted(own[1][3].items(), key=lambda x: (-x[1], x[0]))[:KINDS_TRIED]:
        for c in sizes:
            trial = {**chosen, kind: c}
            found = tried(_by_kind(sizes, trial))
            if found[0] < own[0]:
                own, chosen = found, trial
    bins, offsets, caps, _ = cheaper(best, own)[1]
    return bins, offsets, caps


def pack(rows: DataFrame, id_column: str, length: str, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per piece: the id, piece (from 0), start and length within its text, bin_id, position and offset `at` in the bin, capacity."""
    largest = max(capacities)
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    sizes = stage(rows.select(F.col(id_column), size.alias("total")), "packing")
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / largest) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select(F.col(id_column).alias("id"), "piece", (F.col("piece").cast("long") * largest).alias("start"),
                           F.least(F.lit(largest), F.col("total") - F.col("piece").cast("long") * largest).cast("long").alias("length"))
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    kind = sizes.schema[id_column].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        bins, offsets, caps = best_fit(table.column("length").to_pylist(), capacities)
        first = TaskContext.get().partitionId() << 33
        filled = [0] * len(caps)
        positions = []
        for b in bins:
            positions.append(filled[b])
            filled[b] += 1
        table = (table.append_column("bin_id", pa.array([first + b for b in bins], pa.int64()))
                 .append_column("position", pa.array(positions, pa.int32())).append_column("at", pa.array(offsets, pa.int64()))
                 .append_column("capacity", pa.array([caps[b] for b in bins], pa.int64())))
        yield from table.to_batches(max_chunksize=10_000)

    placed = pieces.repartition(shards).mapInArrow(place, f"id {kind}, {_OUT}")
    return placed.withColumnRenamed("id", id_column)
