"""Mixing of sources by temperature, with DataFrame operations only.

A source with share p of the tokens gets weight p**a / sum(p**a). The exponent a (one over the temperature) is bisected, by
aggregates over the source totals, to the value that meets a target entropy, or the least that keeps every source within a
repetition limit. The weights are then realised: a source's rows are dealt into blocks of bounded size, each block uses all its rows as
often as its weight says in whole passes, and a permutation of the block up to its token budget for the rest.
No window is larger than a block, so one source with most of the rows is no obstacle.

Defined cases: a null source is a source; null or negative token counts count as 0; a source without tokens has weight 0 and each
of its rows is used once; with no budget given the budget is the least that uses every row; an empty table gives an empty
result; helper columns are named apart from the table's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import fresh, stage

BLOCK_ROWS = 512
BROADCAST_SOURCES = 10_000  # with names of usual length well under a megabyte; beyond it a shuffled join
POINTS = 31  # exponents tried in a pass: five levels of bisection at once
PASSES = 6


def source_totals(rows: DataFrame, source: str, tokens: str) -> DataFrame:
    """source, tokens, n (rows) and share of all tokens."""
    size = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    totals = stage(rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("n")), "source-totals")
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))


def _measures(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """Per exponent: sum of p**a, entropy of the weights, and the largest and least of weight over share (up to the sum)."""
    tried = totals.filter("share > 0").select("share", F.explode(F.array(*map(F.lit, sorted(set(exponents))))).alias("a"))
    power, gain = F.pow("share", "a"), F.pow("share", F.col("a") - 1)
    found = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(gain).alias("most"), F.min(gain).alias("least"))
    return {r.a: (r.z, math.log(r.z) - r.a * r.s / r.z, r.most, r.least) for r in found.collect()}


def solve_exponent(totals: DataFrame, entropy: float | None = None, limit: float | None = None, budget_share: float | None = None,
                   highest: float = 1.0) -> float:
    """The exponent that meets a target entropy (nats), raised if need be to where no source repeats more than `limit` times.

    highest: the sharpest exponent allowed; at 1 a corpus more even than the target is left as it is.
    budget_share: budget over all tokens; None is the least budget that uses every row. Entropy falls and repetition
    falls as the exponent rises, up to 1 for the latter, so each is bracketed and cut to a 32nd in every pass.
    """

    def bisect(too_low, low: float, high: float) -> float:
        for _ in range(PASSES):
            step = (high - low) / (POINTS + 1)
            points = [low + step * (i + 1) for i in range(POINTS)]
            measures = _measures(totals, points)
            below = [a for a in points if a in measures and too_low(measures[a])]
            low = max(below, default=low)
            high = min(low + step, high)
        return (low + high) / 2

    def repeats(m: tuple[float, float, float, float]) -> float:
        return m[2] / m[3] if budget_share is None else budget_share * m[2] / m[0]

    ends = _measures(totals, [0.0, 1.0, highest])
    if not ends:
        return 1.0
    a = 1.0
    if entropy is not None:
        a = bisect(lambda m: m[1] > entropy, 0.0, highest) if ends[0.0][1] > entropy > ends[highest][1] else (0.0 if ends[0.0][1] <= entropy else highest)
    elif limit is not None:
        a = 0.0
    if limit is not None and a < 1 and repeats(ends[1.0]) <= limit and repeats(_measures(totals, [a])[a]) > limit:
        a = max(a, bisect(lambda m: repeats(m) > limit, a, 1.0))
    return a


def weights(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """totals with weight and repeats, the passes over the source that its weight asks for."""
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    row = totals.select(power.alias("p"), "tokens").agg(F.sum("p"), F.max(F.when(F.col("p") > 0, F.col("tokens") / F.col("p")))).first()
    z, most = (row[0] or 1.0), (row[1] or 0.0)
    wanted = most * z if budget is None else float(budget)
    weight = power / F.lit(z)
    return totals.withColumn("weight", weight).withColumn(
        "repeats", F.when(F.col("tokens") > 0, weight * F.lit(wanted) / F.col("tokens")).otherwise(1.0))


def mix(rows: DataFrame, plan: DataFrame, id_column: str, source: str, tokens: str, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per use of an input row: its columns, and weight, epoch (from 0), block and position (from 1) in the block's permutation of that epoch.

    Rows of a block share source and a hash of id and tokens. Rows that agree in all three more often than a block holds, null ids for one, are told apart by a
    number stored with them and spread as well.
    """
    n_sources = plan.count()
    columns, counted = rows.columns, F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    alike = fresh(rows, "like_id", "like_source", "like_size", "alike", "number")
    (like_id, like_source, like_size, many, number), same = alike, F.lit(False)
    heavy = stage(rows.groupBy(F.col(id_column).alias(like_id), F.col(source).alias(like_source), counted.alias(like_size)).agg(F.count(F.lit(1)).alias(many))
                  .filter(F.col(many) > block_rows), "mix-alike")
    if not heavy.isEmpty():
        rows = stage(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
        met = F.col(id_column).eqNullSafe(F.col(like_id)) & F.col(source).eqNullSafe(F.col(like_source)) & (counted == F.col(like_size))
        rows, same = rows.join(heavy, met, "left").drop(like_id, like_source, like_size), F.col(many).isNotNull()
    names = fresh(rows, "mix_source", "mix_n", "weight", "repeats", "block", "epoch", "position", "size", "order", "upto", "whole", "total")
    key, n, weight, repeats, block, epoch, position, size, order, upto, whole, total = names
    side = plan.select(F.col("source").alias(key), F.col("n").alias(n), F.col("weight").alias(weight), F.col("repeats").alias(repeats))
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    df = rows.join(side, F.col(source).eqNullSafe(F.col(key)), "inner")

    def shuffled(*parts: Column) -> Column:
        known = [F.lit(seed), *parts, F.col(id_column).cast("string"), F.col(size)]
        return F.when(same, F.xxhash64(*known, F.col(number))).otherwise(F.xxhash64(*known)) if number in df.columns else F.xxhash64(*known)

    df = (df.withColumn(size, F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)))
          .withColumn(block, F.pmod(shuffled(F.lit("block")), F.ceil(F.col(n) / block_rows)))
          .withColumn(order, shuffled(F.lit("part")))
          .withColumn(whole, F.floor(F.col(repeats) + 1e-9)))
    group = Window.partitionBy(key, block)
    df = (df.withColumn(upto, F.sum(size).over(group.orderBy(order, id_column).rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn(total, F.sum(size).over(group)))
    share = F.col(repeats) - F.col(whole)
    more = (share > 1e-9) & (F.col(upto) - F.col(size) / 2 <= share * F.col(total))  # a row counts as reached at its middle
    df = (df.withColumn(whole, (F.col(whole) + F.when(more, 1).otherwise(0)).cast("int")).filter(F.col(whole) > 0)
          .withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(whole) - 1))))
    df = df.withColumn(position, F.row_number().over(
        Window.partitionBy(key, block, epoch).orderBy(shuffled(F.lit("epoch"), F.col(epoch)), id_column)))
    return df.select(*columns, weight, epoch, block, position)
