"""Sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.operators.chunked import SIZE, stitch
from haploom.operators.order import running_sum
from haploom.operators.sequences import wrapped
from haploom.sources.text import lines


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """path, contig, seq: the name ends at the first blank."""
    order = W.partitionBy("path").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = lines(spark, path).where(F.trim("line") != "").withColumn("n", F.sum(F.col("line").startswith(">").cast("int")).over(order)).where("n > 0")
    name = F.max(F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S*)", 1)))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").startswith(">"), F.struct("ord", F.trim("line").alias("s"))))), lambda x: x["s"]), "")
    return rows.groupBy("path", "n").agg(name.alias("contig"), seq.alias("seq")).drop("n")


def read_chunks(spark: SparkSession, path, size: int = SIZE) -> DataFrame:
    """path, contig, chunk, bases: the same records in rows of ``size`` bases (see ``operators.chunked``).

    Which record a line belongs to, and where it stands in it, are sums over the lines before it, taken by ranges of
    lines: no task holds a contig. A record without bases has no rows. The parts that one Spark job wrote into a folder are one file, in
    their order, so that a record may go on in the next part; its path is then the folder.
    """
    named = r"/part-(\d+)-([0-9a-f-]{36})(?:-c(\d+))?[^/]*$"
    part, job, file = (F.regexp_extract("path", named, i) for i in (1, 2, 3))
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    rows = lines(spark, path).select(F.regexp_replace("path", named, "").alias("path"), job.alias("job"), number(part).alias("part"), number(file).alias("file"), "ord", "line")
    rows = rows.withColumn("head", F.col("line").startswith(">")).withColumn("text", F.trim("line")).where("text <> ''")
    own, by = ["path", "job"], ["part", "file", "ord"]
    told = running_sum(rows, by, F.col("head").cast("long"), own, "n").withColumn("n", F.col("n") + F.col("head").cast("long")).where("n > 0")
    names = told.where("head").select(*own, F.col("n").alias("record"), F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig"))
    placed = running_sum(told.where("NOT head").select(*own, "n", *by, "text"), by, F.length("text").cast("long"), [*own, "n"], "to")
    parts = placed.select(*own, F.col("n").alias("record"), "to", F.length("text").cast("long").alias("n"), F.col("text").alias("bases"))
    return stitch(parts, [*own, "record"], size).join(names, [*own, "record"]).select("path", "contig", "chunk", "bases")


def write_chunks(store: DataFrame, path: str) -> None:
    """Chunks (of a size that lines of 60 divide) as records in lines of 60, in order; a file part for each range."""
    first = F.when(F.col("chunk") == 0, F.concat(F.lit(">"), "contig", F.lit("\n"))).otherwise("")
    store.orderBy("contig", "chunk").select(F.concat(first, wrapped(F.col("bases"))).alias("value")).write.mode("overwrite").text(path)


def fetch(sequences: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (contig, start, end; 0-based, half open) with their sequence."""
    return ranges.join(sequences.select("contig", F.col("seq").alias("__seq")), "contig").withColumn("seq", F.substring(F.col("__seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("__seq")


def write_fasta(sequences: DataFrame, path: str) -> None:
    """Records in lines of 60, one file part for each range of contigs."""
    sequences.orderBy("contig").select(F.concat(F.lit(">"), "contig", F.lit("\n"), wrapped(F.col("seq"))).alias("value")).write.mode("overwrite").text(path)
