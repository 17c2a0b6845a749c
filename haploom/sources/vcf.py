"""Variant files as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.sources.text import lines, write_lines

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def read_vcf(spark: SparkSession, path, samples: list[str] | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """path, ord, chrom, pos, ref, alt, info, sample, gt: one row for each record and (wanted) sample.
    Parts of a folder that a Spark job wrote share one header."""
    text = lines(spark, path).withColumn("home", F.regexp_replace("path", "/part-[^/]*$", ""))
    names = text.where(F.col("line").startswith("#CHROM")).select("home", F.slice(F.split("line", "\t"), 10, 1_000_000).alias("names"))
    parts = F.split("line", "\t")
    rows = text.where(~F.col("line").startswith("#") & (F.size(parts) >= 8)).select("path", "home", "ord", parts[0].alias("chrom"), parts[1].try_cast("long").alias("pos"), parts[3].alias("ref"), parts[4].alias("alt"), parts[7].alias("info"), F.get(parts, F.lit(8)).alias("format"), F.slice(parts, 10, 1_000_000).alias("calls")).where("pos IS NOT NULL")
    if region:
        rows = rows.where((F.col("chrom") == region[0]) & F.col("pos").between(region[1], region[2]))
    # few homes, each with one header: by a join on the home all its records would meet in one task
    each = rows.join(F.broadcast(names), "home").select("*", F.posexplode("calls").alias("i", "call")).withColumn("sample", F.get("names", F.col("i")))
    if samples is not None:
        each = each.where(F.col("sample").isin(samples))
    at = F.array_position(F.split("format", ":"), "GT")
    return each.select("path", "ord", "chrom", "pos", "ref", "alt", "info", "sample", F.when(at > 0, F.get(F.split("call", ":"), (at - 1).cast("int"))).alias("gt"))


def read_blocks(spark: SparkSession, path) -> DataFrame:
    """ord, contig, start, end, is_ref, alt of a sample's blocks (gVCF): END of INFO ends a reference block;
    alt is null for the reference, '.' for no call, else the called allele."""
    one = read_vcf(spark, path)
    end = F.regexp_extract("info", r"(?:^|;)END=(\d+)", 1)
    first = F.regexp_extract("gt", r"^([0-9.]+)", 1)
    alts = F.filter(F.split("alt", ","), lambda a: a != "<NON_REF>")
    called = F.when(first == "0", F.lit(None).cast("string")).when(first.isin(".", ""), ".").otherwise(F.get(alts, (first.try_cast("int") - 1)))
    return one.select("ord", F.col("chrom").alias("contig"), F.col("pos").alias("start"), F.when(end != "", end.cast("long")).otherwise(F.col("pos") + F.length("ref") - 1).alias("end"), (F.size(alts) == 0).alias("is_ref"), called.alias("alt"))


def write_vcf(genotypes: DataFrame, sites: DataFrame, path: str) -> None:
    """genotypes (sample, chrom, pos, gt) at sites (chrom, pos, ref, alt), a generic header; samples are few, absent ones './.'."""
    samples = sorted(r[0] for r in genotypes.select("sample").distinct().toLocalIterator())
    wide = genotypes.groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("m"))
    calls = [F.coalesce(F.try_element_at("m", F.lit(s)), F.lit("./.")) for s in samples]
    body = sites.join(wide, ["chrom", "pos"], "left").select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *calls).alias("line"))
    header = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#" + "\t".join([*FIXED, *samples])]
    write_lines(body, path, ["chrom", "pos"], header)


def write_sites(compared: DataFrame, path: str, mode: str = "all") -> None:
    """Compared sites by tabs, in order."""
    from haploom.operators.variants import written_sites

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    rows = written_sites(compared, mode).select("chrom", "pos", "ref", F.concat_ws("\t", "kind", "chrom", F.col("pos").cast("string"), "ref", *(text(c) for c in ("t.alt", "t.gt", "i.alt", "i.gt"))).alias("line"))
    write_lines(rows, path, ["chrom", "pos", "ref"], ["\t".join(["kind", "chrom", "pos", "ref", "t_alt", "t_gt", "i_alt", "i_gt"])])
