"""A day x instrument cube stored as tiles: a bit for every cell, values for those that exist.

A tile covers `tile_days` days of 64 instruments. Its map has one 64-bit word a day, a bit an instrument; values of the cells present are packed one
after the other, by day and instrument. An absent cell costs a bit, and a tile without any cell is not stored. Cells are grouped by
tile, so a group holds at most 64 * tile_days rows and neither a long day nor a long-lived instrument fills a task.
Readers scan only tiles that a slice touches, by the tile coordinates in the files; coverage reads the maps alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.operators.ranks import dense_codes

WORD = 64  # instruments of a tile: one bit each of a day's word
TILE_DAYS = 16
MASKS = ("present", "ret_mask", "mom_mask", "both_mask")


@dataclass(frozen=True)
class Cube:
    """`tiles` (tile_t, tile_n, map, x, y_ret, y_mom, masks), `days` (t, date), `instruments` (n, sid); `width` values a cell."""

    tiles: DataFrame
    days: DataFrame
    instruments: DataFrame
    width: int
    tile_days: int


def write_cube(view: DataFrame, calendar: DataFrame, path: str, width: int, tile_days: int = TILE_DAYS) -> Cube:
    """Store an encoded view (date, sid, td_idx, x, present, y_ret, y_mom and masks; one row a cell) and return its reader."""
    spark = view.sparkSession
    calendar.select(F.col("td_idx").alias("t"), "date").write.parquet(f"{path}/days")
    dense_codes(view, "sid", "n").select("n", "sid").write.parquet(f"{path}/instruments")
    codes = spark.read.parquet(f"{path}/instruments")
    flags = F.lit(0)
    for i, m in enumerate(MASKS):
        flags = flags.bitwiseOR(F.when(F.col(m), 1 << i).otherwise(0))
    bit = F.pmod(F.col("n"), F.lit(WORD)).cast("int")
    cell = F.struct(F.pmod(F.col("td_idx"), F.lit(tile_days)).cast("int").alias("day"), bit.alias("bit"), "x", F.col("y_ret").cast("float").alias("y_ret"),
                    F.col("y_mom").cast("byte").alias("y_mom"), flags.cast("byte").alias("masks"))
    tiles = (view.join(codes, "sid").withColumn("_cell", cell)
             .groupBy(F.floor(F.col("td_idx") / tile_days).cast("int").alias("tile_t"), F.floor(F.col("n") / WORD).cast("int").alias("tile_n"))
             .agg(F.sort_array(F.collect_list("_cell")).alias("cells")))

    def word(day: Column) -> Column:
        ours = F.filter("cells", lambda c: c["day"] == day)
        return F.aggregate(ours, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c["bit"])))

    def part(name: str) -> Column:
        return F.transform("cells", lambda c: c[name])

    packed = tiles.select("tile_t", "tile_n", F.transform(F.sequence(F.lit(0), F.lit(tile_days - 1)), word).alias("map"), F.flatten(part("x")).alias("x"),
                          *[part(name).alias(name) for name in ("y_ret", "y_mom", "masks")])
    packed.sortWithinPartitions("tile_t", "tile_n").write.parquet(f"{path}/tiles")
    return read_cube(spark, path, width, tile_days)


def read_cube(spark: SparkSession, path: str, width: int, tile_days: int = TILE_DAYS) -> Cube:
    return Cube(*[spark.read.parquet(f"{path}/{part}") for part in ("tiles", "days", "instruments")], width, tile_days)


def _set(words: Column, day: Column, bit: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.get(words, day), bit).bitwiseAND(F.lit(1).cast("long")) == 1


def _touched(cube: Cube, first: int | None, last: int | None, sids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The tiles that a slice touches, and its instruments."""
    tiles, instruments = cube.tiles, cube.instruments
    if first is not None:
        tiles = tiles.where(F.col("tile_t") >= first // cube.tile_days)
    if last is not None:
        tiles = tiles.where(F.col("tile_t") <= last // cube.tile_days)
    if sids is not None:
        instruments = instruments.join(sids.select("sid").distinct(), "sid", "left_semi")
        tiles = tiles.join(instruments.select(F.floor(F.col("n") / WORD).cast("int").alias("tile_n")).distinct(), "tile_n", "left_semi")
    return tiles, instruments


def _opened(cube: Cube, tiles: DataFrame, absent: bool) -> DataFrame:
    """t, n and the values of every cell of the tiles, or of those present. Cells are cut out before they become rows, so no row carries its tile along."""
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cube.tile_days - 1)), lambda d: F.transform(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.struct(d.alias("day"), b.alias("bit"), _set(F.col("map"), d, b).alias("here")))))
    def at(p: Column) -> list[Column]:
        return [(F.col("tile_t") * cube.tile_days + p["day"]).alias("t"), (F.col("tile_n").cast("long") * WORD + p["bit"]).alias("n")]

    def stored(p: Column, i: Column) -> Column:
        return F.struct(*at(p), F.slice("x", i * cube.width + 1, cube.width).alias("x"), *[F.get(name, i).alias(name) for name in ("y_ret", "y_mom", "masks")])

    def empty(p: Column) -> Column:
        return F.struct(*at(p), F.array_repeat(F.lit(0.0).cast("float"), cube.width).alias("x"), F.lit(0.0).cast("float").alias("y_ret"),
                        F.lit(-1).cast("byte").alias("y_mom"), F.lit(0).cast("byte").alias("masks"))

    cells = F.transform(F.filter(places, lambda p: F.coalesce(p["here"], F.lit(False))), stored)
    if absent:
        cells = F.concat(cells, F.transform(F.filter(places, lambda p: ~F.coalesce(p["here"], F.lit(False))), empty))
    return tiles.select(F.inline(cells))


def read_cells(cube: Cube, first: int | None = None, last: int | None = None, sids: DataFrame | None = None, absent: bool = False) -> DataFrame:
    """(date, sid, td_idx, x, present, y_ret, y_mom, masks) of the days first..last and the given instruments, by default all.

    absent: cells without a panel row come too, as zeros with class -1 and masks off; meant for slices, since these rows are not stored anywhere."""
    tiles, instruments = _touched(cube, first, last, sids)
    days = cube.days
    if first is not None:
        days = days.where(F.col("t") >= first)
    if last is not None:
        days = days.where(F.col("t") <= last)
    if absent:  # tiles without any cell as well
        low, high = (days.agg(F.floor(f("t") / cube.tile_days)).scalar() for f in (F.min, F.max))
        grid = instruments.select(F.floor(F.col("n") / WORD).cast("int").alias("tile_n")).distinct().withColumn("tile_t", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        tiles = grid.join(tiles, ["tile_t", "tile_n"], "left")
    cells = _opened(cube, tiles, absent).join(F.broadcast(days), "t").join(instruments, "n")
    masks = [(F.col("masks").bitwiseAND(F.lit(1 << i).cast("byte")) != 0).alias(m) for i, m in enumerate(MASKS)]
    return cells.select("date", "sid", F.col("t").cast("int").alias("td_idx"), "x", "y_ret", "y_mom", *masks)


def coverage_by_day(cube: Cube) -> DataFrame:
    """(date, td_idx, n_cells) of every day, from the maps alone."""
    word = cube.tiles.select("tile_t", F.posexplode("map").alias("day", "word"))
    found = word.groupBy((F.col("tile_t") * cube.tile_days + F.col("day")).alias("t")).agg(F.sum(F.bit_count("word")).alias("n_cells"))
    return cube.days.join(found, "t", "left").select("date", F.col("t").alias("td_idx"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def coverage_by_instrument(cube: Cube) -> DataFrame:
    """(sid, n_cells) of every instrument, from the maps alone."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.struct(b.alias("bit"), F.aggregate(
        F.col("map"), F.lit(0).cast("long"), lambda a, w: a + F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1).cast("long"))).alias("k")))
    found = cube.tiles.select("tile_n", F.inline(bits)).groupBy((F.col("tile_n").cast("long") * WORD + F.col("bit")).alias("n")).agg(F.sum("k").alias("n_cells"))
    return cube.instruments.join(found, "n").select("sid", "n_cells")
