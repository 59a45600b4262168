"""Parquet and CSV sources and sinks. Everything stays lazy; pruning reaches the scan."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwright.functions.identifiers import normalise_date
from panelwright.functions.schema import feature_names, struct_fields
from panelwright.operators.staging import scratch_dir

# Names under which a calendar file may hold its dates, in order of preference.
CALENDAR_DATE_NAMES = ("date", "trade_date", "datetime", "calendar_date")


def yearly_paths(spark: SparkSession, directory: str, start_year: int | None = None, end_year: int | None = None) -> list[str]:
    """Files, or folders as Spark writes them, named ``year=YYYY.parquet`` within an inclusive year range; other names are skipped."""
    listing = spark.read.option("recursiveFileLookup", "true").schema("date string").parquet(directory)
    chosen = set()
    for uri in listing.inputFiles():
        m = re.match(r"(.*/year=(\d+)\.parquet)(/[^/]+)?$", unquote(uri))
        if m and (start_year is None or int(m[2]) >= start_year) and (end_year is None or int(m[2]) <= end_year):
            chosen.add(m[1])
    if not chosen:
        raise FileNotFoundError(f"no yearly parquet in [{start_year}, {end_year}] under {directory}")
    return sorted(chosen)


def yearly_groups(spark: SparkSession, directory: str, start_year: int | None = None, end_year: int | None = None) -> list[DataFrame]:
    """The years of a yearly directory, one table per schema, with the file position kept for "keep first".

    Nanosecond timestamps come as 64-bit numbers (`normalise_date` reads them); that is a session setting, switched on here.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    groups: dict[str, list[str]] = {}
    for path in yearly_paths(spark, directory, start_year, end_year):
        groups.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    name = F.regexp_extract("_metadata.file_path", r"(year=\d+\.parquet(?:/[^/]+)?)$", 1)
    position = [name.alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return [spark.read.parquet(*paths).select("*", *position) for paths in groups.values()]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column whose type differs is double if all its types are numeric, else text."""
    kinds: dict[str, set[str]] = {}
    numeric: dict[str, bool] = {}
    for df in frames:
        for field in df.schema:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
            numeric[field.name] = numeric.get(field.name, True) and isinstance(field.dataType, T.NumericType)
    drifted = {n: "double" if numeric[n] else "string" for n, k in kinds.items() if len(k) > 1}
    out = None
    for df in frames:
        df = df.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in drifted.items() if n in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_yearly(
    spark: SparkSession,
    directory: str,
    start_year: int | None = None,
    end_year: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """All years, columns unioned and drifting types made one, with the file position kept for "keep first"."""
    df = union_all(yearly_groups(spark, directory, start_year, end_year))
    return df.select(*columns, "_file", "_row") if columns else df


def read_date_range(spark: SparkSession, path: str, start: str, end: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with start <= date < end. Tables written by `write_panel` also prune year folders."""
    df = spark.read.parquet(path)
    d = F.col("date")
    df = df.where((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    if "year" in df.columns:
        first, last = int(start[:4]), int(end[:4])
        df = df.where(F.col("year").between(first, last))
    return df.select(*columns) if columns else df


def write_panel(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "overwrite", files_per_year: int = 16, whole: bool = True) -> None:
    """Write a keyed table partitioned by year, each file ordered by (date, sid). Without `whole`, overwriting replaces only the years that df holds.

    A year's instruments are dealt over `files_per_year` cells by a hash, and a cell is one file at most, whatever the size of a day (adaptive execution merges small ones).
    Unlike range bounds, which sample their input first, this computes the table once.
    """
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    (
        df.withColumn("year", F.year("date"))
        .repartition("year", F.pmod(F.xxhash64("sid"), F.lit(files_per_year)))
        # The year first, so that the writer finds its rows in order and does not sort them again.
        .sortWithinPartitions("year", "date", "sid")
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def replace_years(df: DataFrame, path: str, files_per_year: int = 16) -> None:
    """Put the years that df holds in place of those stored by `write_panel`; other years' files are not touched, and years new to the store are added.

    The store's schema is the contract: df must have its columns and no others, and each is cast to the stored type. Rows are written aside and moved in
    when the job commits, so a failed or repeated job leaves the store with whole years.
    """
    spark = df.sparkSession
    held = spark.read.parquet(path).drop("year").schema
    if set(df.columns) != set(held.names):
        raise ValueError(f"the store has the columns {sorted(held.names)}, the rows have {sorted(df.columns)}")
    write_panel(df, path, held, "overwrite", files_per_year, whole=False)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> str:
    """Store a table in buckets of its keys, each one sorted file, and return its name. Tables with the same keys and number of buckets
    join on all of them without an exchange. Keys that a row holds once spread over the buckets evenly."""
    spark = df.sparkSession
    name = f"panelwright_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_dir(spark, "buckets")).saveAsTable(name)
    return name


def read_calendar_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct open dates of a CSV, inclusive range; rows that hold no date are dropped."""
    raw = spark.read.csv(path, header=True)
    name = next((c for c in CALENDAR_DATE_NAMES if c in raw.columns), raw.columns[0])
    dates = raw.select(normalise_date(F.col(name)).alias("date")).dropna()
    return in_date_range(dates, start, end).distinct().withColumn("is_open", F.lit(True))


def in_date_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def read_feature_rows(panel: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(date, sid, features array<float>) in sorted-name order; one pruned projection."""
    names = list(names) if names is not None else feature_names(panel)
    values = [F.col(f"feature.`{n}`").cast("float") for n in names]
    return panel.select("date", "sid", F.array(*values).alias("features"))


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """A target table, or None when nothing has been written at the path yet."""
    try:
        return spark.read.parquet(path).select("date", "sid", "label")
    except Exception as err:  # the reader reports an absent path as an analysis error
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise


def table_profile(df: DataFrame) -> DataFrame:
    """Columns (structs opened) with type, and the row count."""
    spark = df.sparkSession
    described = []
    for field in df.schema:
        inner = struct_fields(df, field.name)
        described += [(f"{field.name}.{n}", field.dataType[n].dataType.simpleString()) for n in inner] or [
            (field.name, field.dataType.simpleString())
        ]
    names = spark.createDataFrame(described, "column_name string, column_type string")
    return names.withColumn("row_count", df.agg(F.count(F.lit(1))).scalar())


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("date", "sid", "y_raw", "pred").write.mode("overwrite").option("header", True).csv(path)


def append_run_metrics(metrics: DataFrame, run_id: str, path: str) -> None:
    """Append (split, metric, value) rows of one run to the shared metrics table."""
    metrics.select(F.lit(run_id).alias("run_id"), "split", "metric", "value").write.mode("append").parquet(path)


def append_run_features(spark: SparkSession, names: list[str], run_id: str, path: str) -> None:
    rows = [(run_id, i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "run_id string, position int, feature string").write.mode("append").parquet(path)
