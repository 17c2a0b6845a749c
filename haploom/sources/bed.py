"""Intervals, lengths and keys by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.functions.scalar import is_chromosome, sample_of_bed
from haploom.sources.text import lines, write_lines


def read_bed(spark: SparkSession, path, fields: int = 3) -> DataFrame:
    """path, ord, chrom, start, end, extra: rows of three fields or more (``fields``: 5, where both parents must be
    there); comments, tracks, headers and rows whose places are no numbers are left out."""
    parts = F.split("line", "\t")
    body = lines(spark, path).where(~F.col("line").rlike("^(#|track|browser)") & (F.size(parts) >= max(fields, 3)))
    rows = body.select("path", "ord", parts[0].alias("chrom"), parts[1].try_cast("long").alias("start"), parts[2].try_cast("long").alias("end"), F.slice(parts, 4, 1000).alias("extra"))
    return rows.where("start IS NOT NULL AND `end` IS NOT NULL")


def read_paths(spark: SparkSession, path) -> DataFrame:
    """sample, ord, chrom, start, end, parent1, parent2 (parent1 where there is none); files of one sample join."""
    rows = read_bed(spark, path).where(F.size("extra") >= 1)
    return rows.select(sample_of_bed(F.col("path")).alias("sample"), "path", "ord", "chrom", "start", "end", F.col("extra")[0].alias("parent1"), F.coalesce(F.get("extra", F.lit(1)), F.col("extra")[0]).alias("parent2"))


def read_lengths(spark: SparkSession, path, chromosomes_only: bool = False) -> DataFrame:
    """path, chrom, length of FASTA index files."""
    parts = F.split("line", "\t")
    rows = lines(spark, path).where(F.size(parts) >= 2).select("path", parts[0].alias("chrom"), parts[1].try_cast("long").alias("length")).where("length IS NOT NULL")
    return rows.where(is_chromosome(F.col("chrom"))) if chromosomes_only else rows


def read_answer_key(spark: SparkSession, path, version: int = 2) -> DataFrame:
    """chrom, start, end, founder: distinct rows of a key (version 1: fields 3 to 6; version 2: the first four)."""
    parts = F.split("line", "\t")
    at = 2 if version == 1 else 0
    rows = lines(spark, path).where(F.size(parts) >= at + 4)
    return rows.select(parts[at].alias("chrom"), parts[at + 1].try_cast("long").alias("start"), parts[at + 2].try_cast("long").alias("end"), parts[at + 3].alias("founder")).where("start IS NOT NULL AND `end` IS NOT NULL").dropDuplicates()


def read_samples(spark: SparkSession, path) -> DataFrame:
    """sample, first, second: the assemblies of each sample (two or three fields, no header)."""
    parts = F.split("line", "\t")
    return lines(spark, path).where(F.size(parts) >= 2).select(parts[0].alias("sample"), parts[1].alias("first"), F.coalesce(F.get(parts, F.lit(2)), parts[1]).alias("second"))


def require(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``wanted`` with what is known of each key; a key that is not known raises an error when it is read."""
    joined = wanted.join(known.withColumn("__known", F.lit(True)), key, "left")
    return joined.withColumn(key, F.when(F.col("__known").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no entry for {key} "), F.col(key).cast("string"))))).drop("__known")


def write_bed(rows: DataFrame, path: str, columns: list[str], by: list[str], single: bool = False) -> None:
    """Rows with a header by tabs, in order."""
    body = rows.select(*by, F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))
    write_lines(body, path, by, ["\t".join(columns)], single)


def write_bed_files(rows: DataFrame, path: str, columns: list[str], by: list[str]) -> list[str]:
    """A file ``{sample}_{contig}_imputed.bed`` for each sample and contig (``chrom``), with a header, in order; the names written.

    Each file is one task's rows, sorted; only the files' names come to the driver, which gives them theirs where they lie.
    """
    spark = rows.sparkSession
    name = F.concat(F.col("sample"), F.lit("_"), F.col("chrom"), F.lit("_imputed.bed"))
    body = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    lines_ = rows.select(name.alias("__name"), F.lit(1).alias("__k"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(by)), body.alias("value"))
    heads = rows.select(name.alias("__name")).distinct().select("__name", F.lit(0).alias("__k"), F.lit("\t".join(columns)).alias("value"))
    order = ["__name", "__k", *(f"__o{i}" for i in range(len(by)))]
    laid = lines_.unionByName(heads, allowMissingColumns=True).repartition("__name").sortWithinPartitions(*order)
    laid.select("__name", "value").write.mode("overwrite").partitionBy("__name").text(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    for folder in fs.listStatus(at):
        if folder.isDirectory() and folder.getPath().getName().startswith("__name="):
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            own = jvm.java.net.URLDecoder.decode(folder.getPath().getName()[7:], "UTF-8")
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(at, own))
            fs.delete(folder.getPath(), True)
            done.append(own)
    return sorted(done)


def write_bed_by_sample(rows: DataFrame, path: str) -> None:
    """A folder for each sample and contig, tab-separated with a header."""
    rows.repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "start").write.mode("overwrite").partitionBy("sample", "chrom").option("sep", "\t").option("header", True).csv(path)
