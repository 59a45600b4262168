"""Session settings, and the one place where a lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Adaptive execution with skewed-join splitting, UTC days. All are runtime settings."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def staging_dir(spark: SparkSession) -> str | None:
    """The shared folder named by spark.checkpoint.dir, if one is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; on a local master without one, in this machine's temporary folder."""
    folder = staging_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="panelwright-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition small rows that are about to be expanded.

    Adaptive execution merges small shuffle partitions by their bytes before the expansion,
    which would put a whole panel in one task; an explicit count is left alone.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *columns)


def stage(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and return a scan of it. Without a shared folder it is persisted on the
    executors' disks instead, which runs nothing yet and is recomputed where an executor is lost.

    Used for narrow tables whose recomputation would repeat the panel joins. The files are in
    shared storage, so a lost executor costs a re-read, not the upstream plan, and their
    sizes give the planner true statistics.
    """
    folder = staging_dir(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
