"""Feature screening on training rows: variance and missing rate per feature."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.missing import is_missing


def feature_moments(rows: DataFrame, width: int | None = None) -> DataFrame:
    """(position, n_rows, n_missing, variance) of every feature of (features) rows, in one pass whose buffer is a few vectors. No rows give no features.

    Where `width` says how many features are wanted, vectors are put together item by item in compiled code; else by lambdas, which are several times slower.
    Missing values go into one vector as zeros and into another as NaN, which least and greatest pass over; the second has that many more items that are not zero.
    With N rows, m of them missing and mean a over all N, the squared deviations of the present values are those of all less a * a * N * m / (N - m),
    with a relative rounding error of about 1e-16 * a * a * m / (variance * N). Where least and greatest present value agree the variance is exactly 0.
    """
    sizes = []
    if width is not None:
        sizes = [F.min(F.size("features")).alias("size"), F.max(F.size("features")).alias("most")]

    def vector(item: Callable[[Column], Column]) -> Column:
        items = F.transform("features", item) if width is None else F.array(*[item(F.get("features", F.lit(i))) for i in range(width)])
        return array_to_vector(items)

    def filled(missing: float) -> Callable[[Column], Column]:
        return lambda x: F.when(is_missing(x), F.lit(missing)).otherwise(x.cast("double"))

    rows = rows.select("features", vector(filled(0.0)).alias("all"), vector(filled(float("nan"))).alias("own"))
    found = rows.groupBy(F.lit("every row").alias("_one")).agg(
        Summarizer.metrics("count", "mean", "variance", "numNonZeros").summary(F.col("all")).alias("all"),
        Summarizer.metrics("min", "max", "numNonZeros").summary(F.col("own")).alias("own"),
        *sizes,
    )
    found = found.select("*", F.col("all.count").alias("n"), *[vector_to_array(F.col(c)).alias(n) for c, n in (
        ("all.mean", "mean"), ("all.variance", "variance"), ("all.numNonZeros", "some"), ("own.min", "low"), ("own.max", "high"), ("own.numNonZeros", "marked"))])
    each = F.arrays_zip("mean", "variance", "some", "marked", "low", "high")
    if width is not None:
        # The summariser sees the wanted items alone, so it is told here what the rows have.
        alike = F.when(F.col("size") == F.col("most"), F.col("size")).otherwise(F.raise_error(F.lit("rows have unlike numbers of features")).cast("int"))
        each = F.slice(each, F.lit(1), alike)
    each = found.select("n", F.posexplode(each).alias("position", "f"))
    n, lost = F.col("n"), F.col("f.marked") - F.col("f.some")
    present = n - lost
    squares = F.col("f.variance") * (n - 1) - F.col("f.mean") * F.col("f.mean") * n * lost / present
    variance = F.when(present <= 0, F.lit(None).cast("double")).when(F.col("f.low") == F.col("f.high"), 0.0).otherwise(squares / present)
    return each.select("position", n.alias("n_rows"), lost.cast("long").alias("n_missing"),
                       F.when(variance < 0, 0.0).otherwise(variance).alias("variance"))


def feature_profile(
    view: DataFrame, names: Sequence[str], missing_drop_thresh: float = 0.98, exclude: str | None = None
) -> DataFrame:
    """(feature, n_rows, variance, missing_rate, kept) over usable, labelled rows of a tabular view: one scan, one row a panel row."""
    stats = feature_moments(view.where(F.col("y_valid") & F.col("usable")).select("features"), len(names))
    stats = stats.withColumn("missing_rate", F.col("n_missing") / F.col("n_rows"))
    listed = [(i, n, not (exclude and re.search(exclude, f"feature.{n}"))) for i, n in enumerate(names)]
    wanted = view.sparkSession.createDataFrame(listed, "position int, feature string, wanted boolean")
    varies = (F.col("variance") > 0) & (F.col("variance") < float("inf"))
    filled = F.col("missing_rate") < missing_drop_thresh
    return wanted.join(stats, "position", "left").select(
        "feature",
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        "variance",
        "missing_rate",
        (F.col("wanted") & F.coalesce(varies & filled, F.lit(False))).alias("kept"),
    )


def kept_features(profile: DataFrame) -> list[str]:
    """The kept names, one per feature column, in name order."""
    return [r["feature"] for r in profile.where("kept").orderBy("feature").collect()]


def align_features(view: DataFrame, have: Sequence[str], want: Sequence[str]) -> DataFrame:
    """Project the feature array onto the training list and order; a wanted feature that is absent is an error."""
    index = {n: i for i, n in enumerate(have)}
    if absent := [n for n in want if n not in index]:
        raise ValueError(f"the view lacks the features {absent}")
    picked = F.array(*[F.get("features", F.lit(index[n])) for n in want])
    return view.withColumn("features", picked)
