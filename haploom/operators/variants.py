"""Genotypes and the allele-aware comparison of two variant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref"]


def parse_gt(gt: Column) -> Column:
    """Allele indices of a genotype as text, or null: '/' parts before '|', any missing part makes it null."""
    g = F.trim(gt)
    parts = F.when(F.contains(g, F.lit("/")), F.split(g, "/")).otherwise(F.split(g, r"\|"))
    bad = g.isNull() | g.isin(".", "./.", ".|.", "") | F.exists(parts, lambda p: p.isin(".", ""))
    return F.when(~bad, parts)


def missing_gt(gt: Column) -> Column:
    """Whether a genotype is written as missing (not merely unreadable)."""
    g = F.trim(gt)
    return g.isNull() | (g == "") | F.contains(g, F.lit("."))


def alleles(ref: Column, alt: Column, gt: Column, phased: bool = False) -> Column:
    """Allele strings of a genotype, sorted unless phase counts; null for a bad or too large index."""
    all_ = F.concat(F.array(ref), F.when(alt.isNull() | (alt == "."), F.array().cast("array<string>")).otherwise(F.split(alt, ",")))
    picked = F.transform(parse_gt(gt), lambda p: F.try_element_at(all_, F.when(F.expr("true") & (p.try_cast("int") >= 0), p.try_cast("int") + 1)))
    whole = F.when(~F.exists(picked, lambda a: a.isNull()), picked)
    return whole if phased else F.array_sort(whole)


def allele_score(truth: Column, imputed: Column, phased: bool = False) -> Column:
    """Share of the truth's alleles that the imputed ones match, as multisets or place by place."""
    if phased:
        same = F.size(F.filter(F.arrays_zip(truth.alias("t"), imputed.alias("i")), lambda z: z["t"] == z["i"]))
    else:
        n = lambda arr, a: F.size(F.filter(arr, lambda x: x == a))
        same = F.aggregate(F.transform(F.array_distinct(truth), lambda a: F.least(n(truth, a), n(imputed, a))), F.lit(0), lambda x, y: x + y)
    return F.when(F.size(truth) > 0, same / F.size(truth)).otherwise(0.0)


def info_value(info: Column, name: str) -> Column:
    """The last whole-number value of a key of an INFO field, else null."""
    found = F.filter(F.split(info, ";"), lambda x: F.startswith(x, F.lit(name + "=")) & F.substring_index(x, "=", -1).try_cast("long").isNotNull())
    return F.substring_index(F.try_element_at(found, F.lit(-1)), "=", -1).try_cast("long")


def compare(truth: DataFrame, imputed: DataFrame, missing_as_ref: bool = False, phased: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Full outer comparison by (chrom, pos, ref): kind, alleles and score of each pair of records.

    Records of one key pair one to one in the order of (alt, info, gt). ``extra``: further key columns,
    such as a sample.
    """
    key = [*(extra or []), *KEY]
    order = W.partitionBy(*key).orderBy("alt", "info", "gt")
    t = truth.withColumn("dup", F.row_number().over(order)).select(*key, "dup", F.struct("alt", "info", "gt").alias("t"))
    i = imputed.withColumn("dup", F.row_number().over(order)).select(*key, "dup", F.struct("alt", "info", "gt").alias("i"))
    both = t.join(i, [*key, "dup"], "full_outer")
    ta, ia = alleles(F.col("ref"), F.col("t.alt"), F.col("t.gt"), phased), alleles(F.col("ref"), F.col("i.alt"), F.col("i.gt"), phased)
    as_ref = F.transform(ta, lambda a: F.col("ref"))
    left_only, right_only = F.col("i").isNull(), F.col("t").isNull()
    tm, im = missing_gt(F.col("t.gt")), missing_gt(F.col("i.gt"))
    judged = both.withColumn("t_alleles", ta).withColumn("i_alleles", F.when(missing_as_ref & (left_only | (im & F.col("t").isNotNull())), as_ref).otherwise(ia) if missing_as_ref else ia)
    same = F.when(F.col("t_alleles") == F.col("i_alleles"), "MATCH_ALLELE").otherwise("MISMATCH_ALLELE")
    truth_null = F.when(tm, "TRUTH_MISSING_GT").otherwise("GT_UNPARSEABLE")
    kind = (
        F.when(left_only, F.when(F.col("t_alleles").isNull(), truth_null).otherwise(same) if missing_as_ref else F.lit("MISSING_IN_IMPUTED_SITE"))
        .when(right_only, "EXTRA_IN_IMPUTED_SITE")
        .when(F.col("t_alleles").isNull() & F.col("i_alleles").isNull(), F.when(tm & im, "BOTH_MISSING_GT").otherwise("GT_UNPARSEABLE"))
        .when(F.col("t_alleles").isNull(), truth_null)
        .when(F.col("i_alleles").isNull(), F.when(im, "IMPUTED_MISSING_GT").otherwise("GT_UNPARSEABLE"))
        .otherwise(same)
    )
    return judged.withColumn("kind", kind).withColumn("score", F.when(F.col("kind").isin("MATCH_ALLELE", "MISMATCH_ALLELE"), allele_score(F.col("t_alleles"), F.col("i_alleles"), phased)))


def counters(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each kind, records on either side, and concordance with and without partial credit.

    ``identical_strict``: nothing but matches, so neither other sites nor genotypes that are missing or cannot be read.
    """
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = ["MATCH_ALLELE", "MISMATCH_ALLELE", "MISSING_IN_IMPUTED_SITE", "EXTRA_IN_IMPUTED_SITE", "TRUTH_MISSING_GT", "IMPUTED_MISSING_GT", "BOTH_MISSING_GT", "GT_UNPARSEABLE"]
    out = compared.groupBy(*(by or [])).agg(F.count("t").alias("truth_records"), F.count("i").alias("imputed_records"), *(n(k).alias(k.lower()) for k in kinds), F.sum("score").alias("credit"))
    compared_n = F.col("match_allele") + F.col("mismatch_allele")
    strict = sum((F.col(k.lower()) for k in kinds[2:]), F.col("mismatch_allele")) == 0
    return out.withColumn("concordance", F.col("match_allele") / F.nullif(compared_n, F.lit(0))).withColumn("partial_concordance", F.col("credit") / F.nullif(compared_n, F.lit(0))).withColumn("identical_strict", strict)


def frequency_bins(compared: DataFrame, bins: int = 20, partial: bool = False) -> DataFrame:
    """Correct and total sites by bins of frequency: of the allele at homozygous sites (``hom``), of the
    rarer allele at heterozygous ones (``het``, always with partial credit). Also the squared correlation
    of alternative allele counts in each bin, null where either side does not vary."""
    ac, an = info_value(F.col("t.info"), "AC"), info_value(F.col("t.info"), "AN")
    seen = compared.where(F.col("kind").isin("MATCH_ALLELE", "MISMATCH_ALLELE")).withColumn("__p", ac / F.nullif(an, F.lit(0))).where("__p IS NOT NULL")
    alt = F.col("t.alt")
    af = F.when(F.array_contains("t_alleles", alt), F.col("__p")).otherwise(1 - F.col("__p"))
    hom = F.size(F.array_distinct("t_alleles")) == 1
    value = F.when(hom, af).otherwise(F.least(F.col("__p"), 1 - F.col("__p")))
    right = F.when(F.col("t_alleles") == F.col("i_alleles"), 1.0).otherwise(F.when(hom & F.lit(not partial), 0.0).otherwise(F.col("score")))
    alts = F.split(alt, ",")
    n = lambda side: F.size(F.filter(side, lambda a: F.array_contains(alts, a)))
    table = seen.select(F.when(hom, "hom").otherwise("het").alias("zygosity"), F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int").alias("bin"), right.alias("right"), n(F.col("t_alleles")).cast("double").alias("x"), n(F.col("i_alleles")).cast("double").alias("y"))
    varied = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return table.groupBy("zygosity", "bin").agg(F.count("*").alias("total"), F.sum("right").alias("correct"), F.when(varied, F.pow(F.corr("x", "y"), 2)).alias("r2"))


def written_sites(compared: DataFrame, mode: str = "all") -> DataFrame:
    """Rows that a comparison file holds: all, ``matched`` sites only, or ``mismatches`` only (which count
    missing and extra sites, but no missing genotypes)."""
    kinds = {"matched": ["MATCH_ALLELE", "MISMATCH_ALLELE"], "mismatches": ["MISMATCH_ALLELE", "MISSING_IN_IMPUTED_SITE", "EXTRA_IN_IMPUTED_SITE"]}
    return compared if mode == "all" else compared.where(F.col("kind").isin(*kinds[mode]))


def panel_concordance(sites: DataFrame, panel: DataFrame, keys: list[str], called: str, truth: str) -> DataFrame:
    """Each site's alleles of the called and of the true founder in a panel (chrom, pos, member, allele),
    and whether they are the same; a founder that the panel lacks there has a null allele and no match."""
    one = panel.select("chrom", "pos", F.col("member").alias(called), F.col("allele").alias("called_allele"))
    two = panel.select("chrom", "pos", F.col("member").alias(truth), F.col("allele").alias("true_allele"))
    joined = sites.join(one, ["chrom", "pos", called], "left").join(two, ["chrom", "pos", truth], "left")
    return joined.withColumn("same", F.coalesce(F.col("called_allele") == F.col("true_allele"), F.lit(False)))


def panel_genotypes(variants: DataFrame, intervals: DataFrame, panel: DataFrame, bucket: int) -> DataFrame:
    """Genotypes of samples from their intervals and a panel: the last interval (by ``ord``) that holds a
    variant (start + 1 to end) names two panel members, whose first alleles are joined; no call as '.'.

    ``variants``: chrom, pos. ``intervals``: sample, chrom, start, end, parent1, parent2, ord.
    ``panel``: chrom, pos, member, allele.
    """
    from haploom.operators.intervals import interval_join

    laid = intervals.withColumn("low", F.col("start") + 1)
    hit = interval_join(variants.select("chrom", "pos").distinct(), laid, ["chrom"], "pos", "low", "end", bucket)
    best = hit.groupBy("sample", "chrom", "pos").agg(F.max_by(F.struct("parent1", "parent2"), "ord").alias("pair")).select("sample", "chrom", "pos", "pair.*")
    one = panel.select("chrom", "pos", F.col("member").alias("parent1"), F.col("allele").alias("a1"))
    two = panel.select("chrom", "pos", F.col("member").alias("parent2"), F.col("allele").alias("a2"))
    joined = best.join(one, ["chrom", "pos", "parent1"], "left").join(two, ["chrom", "pos", "parent2"], "left")
    return joined.select("sample", "chrom", "pos", F.concat_ws("/", F.coalesce("a1", F.lit(".")), F.coalesce("a2", F.lit("."))).alias("gt"))
