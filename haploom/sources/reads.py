"""Read-support tables: a '#' header with founders, then set, contig, binned position, count by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.sources.text import lines, write_lines

COLUMNS = "gameteSet\trefContig\trefPosBinned\tcount"


def read_reads(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """path, ord, gamete_set, contig, pos, count. Bad rows are left out, or fail if ``strict``; parts of a set
    that are no numbers are dropped."""
    parts = F.split("line", "\t")
    body = lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("gameteSet"))
    number = (lambda c: c.cast("long")) if strict else (lambda c: c.try_cast("long"))
    members = F.filter(F.transform(F.split(parts[0], ","), lambda x: (F.trim(x).cast("int") if strict else F.trim(x).try_cast("int"))), lambda x: x.isNotNull())
    rows = body.select("path", "ord", members.alias("gamete_set"), F.get(parts, 1).alias("contig"), number(F.get(parts, 2)).alias("pos"), number(F.get(parts, 3)).cast("int").alias("count"))
    return rows if strict else rows.where("contig IS NOT NULL AND pos IS NOT NULL AND count IS NOT NULL")


def read_founders(spark: SparkSession, path) -> DataFrame:
    """path, name, founder, reads, weight from the header; a missing total counts as 1. The name ends at ':'."""
    head = lines(spark, path).where(F.col("line").startswith("#")).withColumn("line", F.expr("substring(line, 2)"))
    total = head.where(F.col("line").startswith("TotalUniqueCounts:")).groupBy("path").agg(F.max(F.trim(F.substring_index("line", ":", -1)).try_cast("long")).alias("total"))
    parts = F.split("line", "\t")
    rows = head.where(F.size(parts) >= 3).select("path", F.substring_index(parts[0], ":", 1).alias("name"), parts[1].try_cast("int").alias("founder"), parts[2].try_cast("long").alias("reads")).where("founder IS NOT NULL")
    return rows.join(total, "path", "left").withColumn("weight", F.col("reads") / F.coalesce("total", F.lit(1))).drop("total")


def read_metadata(spark: SparkSession, path) -> DataFrame:
    """path, version, command, total_unique_counts, sample (the file's name without extension)."""
    head = lines(spark, path).where(F.col("line").startswith("#"))
    value = lambda start, sep: F.max(F.when(F.col("line").startswith(start), F.trim(F.expr(f"substring(line, {len(start) + 1})"))))
    out = head.groupBy("path").agg(value("#version=", "=").alias("version"), value("#Command:", ":").alias("command"), value("#TotalUniqueCounts:", ":").try_cast("long").alias("total_unique_counts"))
    return out.withColumn("sample", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def missing_founders(founders: DataFrame) -> DataFrame:
    """Indices below the largest that no founder has; an index table must have none."""
    top = founders.agg(F.max("founder").alias("m"))
    return top.select(F.explode(F.sequence(F.lit(0), "m")).alias("founder")).join(founders, "founder", "left_anti")


def preview(rows: DataFrame, n: int = 100) -> DataFrame:
    """The first rows of a file."""
    return rows.orderBy("ord").limit(n)


def write_reads(sites: DataFrame, founders: DataFrame, path: str) -> None:
    """sites (contig, pos, gamete_set, count) with the founders' header; empty sets are allowed. Founders are few."""
    total = sites.agg(F.sum("count")).first()[0] or 0
    header = [f"#TotalUniqueCounts: {total}", "#gamete\tgameteIndex\tcount"]
    header += [f"#{r['name']}:{r['founder']}\t{r['founder']}\t{r['reads']}" for r in founders.orderBy("founder").select("name", "founder", "reads").toLocalIterator()]
    body = sites.select("contig", "pos", F.concat_ws("\t", F.array_join("gamete_set", ","), "contig", F.col("pos").cast("string"), F.col("count").cast("string")).alias("line"))
    write_lines(body, path, ["contig", "pos"], [*header, COLUMNS])
