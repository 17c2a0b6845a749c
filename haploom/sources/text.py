"""Lines of text files with their order, and ordered writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path) -> DataFrame:
    """path, ord, line. ``ord`` grows with a line's place in its file (ids are given by split, in order,
    and splits of a file follow each other); compressed files are one split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a log of tab-separated files with headers; earlier ones stay."""
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_lines(rows: DataFrame, path: str, by: list, header: list[str] | None = None, single: bool = False) -> None:
    """Write the column ``line`` in order, after header lines. ``single``: as one file, for small results."""
    body = rows.select(F.lit(1).alias("__k"), *[c.alias(f"__o{i}") if not isinstance(c, str) else F.col(c).alias(f"__o{i}") for i, c in enumerate(by)], "line")
    order = [f"__o{i}" for i in range(len(by))]
    if header:
        spark = rows.sparkSession
        top = spark.createDataFrame([(0, i, x) for i, x in enumerate(header)], "__k int, __i int, line string")
        body = body.withColumn("__i", F.lit(0)).unionByName(top, allowMissingColumns=True)
        order = ["__i", *order]
    out = body.orderBy("__k", *order).select("line")
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)
