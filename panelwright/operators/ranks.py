"""Exact ranks inside groups of any size.

A day's cross-section may hold a third of all rows, so no operator here gathers a group in
one task. Ranks come from prefix sums over the distinct values of a group:

1. count rows per (group, value) - partial aggregation absorbs heavily repeated values;
2. walk down "digits" of the value, monotone integers of bounded range: the running count
   before a digit is a window over at most a few million rows per group, whatever the data;
3. the offsets add up along the digits to the number of rows before each value.

Rows pick up their rank by an equi-join on (group, value); a value shared by very many rows
is a skewed join key on one side only, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from panelwright.functions.missing import is_finite
from panelwright.operators.staging import stage


def _exponent(a: Column) -> Column:
    return F.when(a == 0, -1100).otherwise(F.least(F.floor(F.log2(a)), F.lit(1023)).cast("int"))


def value_digits(v: Column, double_precision: bool) -> list[Column]:
    """Monotone digits of a double: sign, exponent and 10 mantissa bits, then 21 more bits.

    Equal values have equal digits and order is preserved (log2 need only be monotone, not exact).
    A group has at most 2 * 2,124 * 1,026 first digits and 2^21 second digits under each;
    what remains under the last digit is at most 2^13 (float) or 2^21 (double) distinct values.
    """
    a = F.abs(v)
    e = _exponent(a)
    scaled = F.when(a == 0, F.lit(0.0)).otherwise(a / F.pow(F.lit(2.0), e)) * 1024
    top = F.floor(scaled)
    sign = F.when(v < 0, -1).otherwise(1)
    digits = [sign * ((e + 1100) * 4096 + top)]
    if double_precision:
        digits.append(sign * F.floor((scaled - top) * float(1 << 21)))
    return digits


def prefix_counts(values: DataFrame, by: Sequence[str], value: str, digits: Sequence[Column]) -> DataFrame:
    """Add `before`, `group_n` and `group_values` to distinct (by, value, n) rows."""
    names = [f"_d{i}" for i in range(len(digits))]
    # Digits are declared non-null, so the joins below infer no filters and both sides share one exchange.
    keyed = values.withColumns({n: F.coalesce(d, F.lit(0)) for n, d in zip(names, digits)})
    leaf = W.partitionBy(*by, *names).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = keyed.withColumn("before", F.coalesce(F.sum("n").over(leaf), F.lit(0)))
    for depth in range(len(names), 0, -1):
        path, parent = names[:depth], [*by, *names[: depth - 1]]
        running = W.partitionBy(*parent).orderBy(names[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        nodes = keyed.groupBy(*by, *path).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_values"))
        offset = [F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")]
        if depth == 1:
            whole = W.partitionBy(*parent)
            offset += [F.sum("_n").over(whole).alias("group_n"), F.sum("_values").over(whole).alias("group_values")]
        nodes = nodes.select(*by, *path, *offset)
        out = out.join(nodes, [*by, *path]).withColumn("before", F.col("before") + F.col("_offset")).drop("_offset")
    return out.drop(*names)


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct finite value, ascending:

    `_value`, `n` rows equal to it, `before` rows below it, `group_n` finite rows and
    `group_values` distinct values of the group.
    """
    exact_float = isinstance(df.schema[value].dataType, T.FloatType)
    v = F.col(value).cast("double")
    counts = df.where(is_finite(F.col(value))).groupBy(*by, v.alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_counts(counts, by, "_value", value_digits(F.col("_value"), double_precision=not exact_float))


def average_rank() -> Column:
    """Rank from 1, ties sharing their mean, as an expression over `value_ranks` columns."""
    return F.col("before") + (F.col("n") + 1) / 2


def attach_ranks(df: DataFrame, ranks: DataFrame, by: Sequence[str], value: str, columns: dict[str, Column]) -> DataFrame:
    """Left-join expressions over `value_ranks` columns to the rows holding the value.

    Rows without a finite value get NULLs. Their join key is a hash of the row, so that a feed
    that is mostly missing does not send all its NULLs to one task; should the hash equal
    some value, the match is discarded (and adds no rows: a rank row is unique per value).
    """
    finite = is_finite(F.col(value))
    spread = F.xxhash64(*df.columns).cast("double")
    left = df.withColumns({"_finite": finite, "_value": F.when(finite, F.col(value).cast("double")).otherwise(spread)})
    right = ranks.select(*by, "_value", *[c.alias(f"_rank_{n}") for n, c in columns.items()])
    found = [F.when(F.col("_finite"), F.col(f"_rank_{n}")).alias(n) for n in columns]
    return left.join(right, [*by, "_value"], "left").select(*[c for c in df.columns if c not in columns], *found)


def ordinal_positions(
    df: DataFrame, by: Sequence[str], value: str, name: str, descending: bool = False, tie: str = "sid"
) -> DataFrame:
    """Position from 0 by value inside the group; equal values in md5 order of `tie`.

    Ties are numbered inside (group, value, cell), the cells being 4,096 md5 prefixes, and each cell adds
    the count of the cells before it. A value held by one row has no ties and needs no such count.
    """
    start = F.col("group_n") - F.col("before") - F.col("n") if descending else F.col("before")
    rows = attach_ranks(df, value_ranks(df, by, value), by, value, {"_start": start, "_n": F.col("n")})
    rows = rows.withColumns(
        {"_v": F.when(F.col("_n").isNotNull(), F.col(value).cast("double")), "_hash": F.md5(F.col(tie))}
    ).withColumn("_cell", F.substring("_hash", 1, 3))
    rows = stage(rows)
    cell = [*by, "_v", "_cell"]
    rows = rows.repartition(*cell).withColumn("_in_cell", F.row_number().over(W.partitionBy(*cell).orderBy("_hash", tie)) - 1)
    running = W.partitionBy(*by, "_v").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.where(F.col("_n") > 1)
        .groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*cell, F.coalesce(F.sum("_c").over(running), F.lit(0)).alias("_cell_start"))
    )
    position = F.col("_start") + F.coalesce(F.col("_cell_start"), F.lit(0)) + F.col("_in_cell")
    return rows.join(offsets, cell, "left").select(*df.columns, position.cast("long").alias(name))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name.

    A quantile lies between two order statistics, and `before`/`n` say which values those
    are; nothing collects a group's values.
    """
    ranks = value_ranks(df, by, value)
    picks = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("group_n") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    found = ranks.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n in probabilities
        ],
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, spread: str = "sid", cells: int = 64) -> DataFrame:
    """The first k rows of each group with their position `top_pos` from 0.

    Winners are found per (group, cell) first, then among at most cells * k candidates;
    both rank filters prune inside the map tasks before shuffling.
    """
    cell = F.pmod(F.xxhash64(spread), F.lit(cells))
    near = W.partitionBy(*by, "_cell").orderBy(*order)
    final = W.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_cell", cell)
        .withColumn("_near", F.row_number().over(near))
        .where(F.col("_near") <= k)
        .withColumn("_place", F.row_number().over(final))
        .where(F.col("_place") <= k)
        .withColumn("top_pos", F.col("_place") - 1)
        .drop("_cell", "_near", "_place")
    )


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 in their order.

    The values are dealt into ranges of about equal size, whatever prefixes they share, and numbered inside each range; a range
    adds the size of those before it. The only window without a key is over one row a range. The ranges are stored, so that
    a re-read numbers the same rows.
    """
    part = "_part"
    dealt = stage(df.select(column).dropna().distinct().repartitionByRange(column).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = F.sum("_size").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(part).orderBy(column)) - 1
    return dealt.withColumn("_place", place).join(starts, part).select(column, (F.col("_start") + F.col("_place")).alias(name))
