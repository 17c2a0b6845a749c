"""Alignment chains between two assemblies, as the blocks that ``intervals.lift_over`` takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_chain(spark: SparkSession, path) -> DataFrame:
    """path, chain, score, chrom, start, end, target, target_start, strand: the ungapped blocks of each chain.

    A chain is a header (12 fields after the word) and lines of size, gap and target gap, up to a blank line.
    ``target_start`` counts on the target's forward strand, where a block of strand '-' runs backwards.
    """
    records = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), "\n").alias("all"))
    body = records.select("path", F.filter("all", lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("all")).where(F.get("all", F.lit(0)).startswith("chain"))
    h = F.split(F.col("all")[0], r"\s+")
    head = body.select("path", h[12].alias("chain"), h[1].cast("long").alias("score"), h[2].alias("chrom"), h[5].cast("long").alias("t0"), h[7].alias("target"), h[8].cast("long").alias("size"), h[9].alias("strand"), h[10].cast("long").alias("q0"), F.slice("all", 2, 1_000_000_000).alias("blocks"))
    rows = head.select("*", F.posexplode("blocks").alias("n", "line")).drop("blocks")
    part = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("long"), F.lit(0))
    sized = rows.select("*", number(0).alias("len"), number(1).alias("dt"), number(2).alias("dq"))
    before = W.partitionBy("path", "chain", "chrom", "t0").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    ahead = lambda gap: F.coalesce(F.sum(F.col("len") + F.col(gap)).over(before), F.lit(0))
    laid = sized.withColumn("start", F.col("t0") + ahead("dt")).withColumn("q", F.col("q0") + ahead("dq"))
    forward = F.when(F.col("strand") == "-", F.col("size") - F.col("q") - F.col("len")).otherwise(F.col("q"))
    return laid.select("path", "chain", "score", "chrom", "start", (F.col("start") + F.col("len")).alias("end"), "target", forward.alias("target_start"), "strand")
