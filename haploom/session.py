"""Session helpers shared by operators: where intermediate tables go and how many partitions to use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the cluster names none (tests on one machine) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java_dir.get() if java_dir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="haploom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Whether a query's shuffle files go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation. The shuffles behind it go as soon as it is written, and
    not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
