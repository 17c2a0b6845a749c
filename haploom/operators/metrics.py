"""Summaries and evaluation measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.session import staged


def reads_summary(reads: DataFrame, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Rows, distinct positions, smallest and largest position of each contig."""
    return reads.groupBy(contig).agg(F.count("*").alias("n_rows"), F.count_distinct(pos).alias("n_pos"), F.min(pos).alias("min_pos"), F.max(pos).alias("max_pos"))


def founder_weights(counts: DataFrame, founder: str = "founder", n: str = "n") -> DataFrame:
    """Reads of each founder and their share of all."""
    by = counts.groupBy(founder).agg(F.sum(n).alias("reads"))
    total = by.agg(F.sum("reads").alias("__t"))
    return by.crossJoin(F.broadcast(total)).withColumn("weight", F.col("reads") / F.col("__t")).drop("__t")


def interval_summary(bed: DataFrame) -> DataFrame:
    """Rows, extent, coverage, mean size, distinct parents and ordered pairs of each chromosome."""
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    return bed.groupBy("chrom").agg(F.count("*").alias("n_rows"), F.min("start").alias("min_start"), F.max("end").alias("max_end"), F.sum(size).alias("coverage"), F.avg(size).alias("mean_size"), F.count_distinct("parent1").alias("n_parents"), F.count_distinct(F.struct("parent1", "parent2")).alias("n_pairs"))


def parent_stats(bed: DataFrame) -> DataFrame:
    """Regions and coverage of each parent in either place, and the chromosomes it is on."""
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    long = bed.select("chrom", size.alias("s"), F.explode(F.array(F.struct(F.lit(1).alias("place"), F.col("parent1").alias("parent")), F.struct(F.lit(2).alias("place"), F.col("parent2").alias("parent")))).alias("e")).select("chrom", "s", "e.*")
    one, two = F.col("place") == 1, F.col("place") == 2
    return long.where("parent IS NOT NULL").groupBy("parent").agg(
        F.count_if(one).alias("regions1"), F.count_if(two).alias("regions2"), F.sum(F.when(one, F.col("s")).otherwise(0)).alias("coverage1"), F.sum(F.when(two, F.col("s")).otherwise(0)).alias("coverage2"), F.count_distinct("chrom").alias("n_chroms")
    )


def parent_contribution(path: DataFrame, keys: list[str], pos: str, parent: str) -> DataFrame:
    """Percent of the distance to the next site that each parent holds, positive distances only."""
    w = W.partitionBy(*keys).orderBy(pos)
    d = path.withColumn("__d", F.lead(pos).over(w) - F.col(pos)).where("__d > 0").groupBy(parent).agg(F.sum("__d").alias("distance"))
    total = d.agg(F.sum("distance").alias("__t"))
    return d.crossJoin(F.broadcast(total)).withColumn("percent", F.bround(100.0 * F.col("distance") / F.col("__t"), 2)).drop("__t")


def mode_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each key, the smallest of equal ones, and the rows of the key."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    rank = W.partitionBy(*keys).orderBy(F.col(value).isNull(), F.desc("__n"), value)
    top = n.withColumn("__all", F.sum("__n").over(W.partitionBy(*keys))).withColumn("__r", F.row_number().over(rank)).where("__r = 1")
    return top.select(*keys, F.col(value).alias("mode"), F.col("__all").alias("size"))


def spectrum(sites: DataFrame, cells: str = "features") -> DataFrame:
    """How many sites have each number of founders present."""
    return sites.groupBy(F.size(F.filter(cells, lambda x: x != 0)).alias("present")).agg(F.count("*").alias("n_sites"))


def spectrum_summary(sites: DataFrame, keys: list[str], cells: str = "features") -> DataFrame:
    """Mean and median number of founders present at a site, and the share of sites without any."""
    n = F.size(F.filter(cells, lambda x: x != 0))
    return sites.groupBy(*keys).agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.avg((n == 0).cast("double")).alias("zero_share"))


def value_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, mean and standard deviation of a value for each key, and over all rows (null key); a null key is left out."""
    known = df.where(F.col(key).isNotNull())
    return known.groupingSets([[F.col(key)], []], F.col(key)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """How often each value occurs, and its share of all rows; the sum is taken over the counts, not over the rows."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__t")))).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def label_support(sites: DataFrame, keys: list[str], label: str, cells: str = "features") -> DataFrame:
    """Of each key's sites: the share without a label (null, negative or beyond the cells), and of the others the share
    where the labelled founder has reads."""
    known = (F.col(label) >= 0) & (F.col(label) < F.size(cells))
    return sites.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((~F.coalesce(known, F.lit(False))).cast("double")).alias("unlabelled"), F.avg(F.when(known, (F.get(cells, F.col(label)) > 0).cast("double"))).alias("supported"))


def mean_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The correlation of two values within each key, averaged over keys."""
    return df.groupBy(*keys).agg(F.corr(x, y).alias("__c")).agg(F.avg("__c").alias("mean_corr"))


def switch_cost_by_truth(df: DataFrame, keys: list[str], by: str, h1: str, h2: str, p1: str, p2: str, cost: float) -> DataFrame:
    """Mean cost of the switches into a site, at truly heterozygous and homozygous sites: ``cost`` for each called founder
    that the site before did not have. A key's first site has none."""
    from haploom.operators.sites import switches

    w = W.partitionBy(*keys).orderBy(by)
    moved = df.withColumn("__s", switches(F.col(p1), F.col(p2), F.lag(p1).over(w), F.lag(p2).over(w)))
    return moved.groupBy((F.col(h1) != F.col(h2)).alias("true_het")).agg(F.count("*").alias("n"), (F.avg(F.coalesce("__s", F.lit(0))) * cost).alias("mean_cost"))


def stratified(df: DataFrame, band: str, correct: str, names: tuple[str, ...] = ("n", "accuracy")) -> DataFrame:
    """Rows and mean correctness in each band and in all of them (band 'all')."""
    out = df.groupingSets([[F.col(band)], []], F.col(band)).agg(F.count("*").alias(names[0]), F.avg(F.col(correct).cast("double")).alias(names[1]), F.grouping(band).alias("__g"))
    return out.withColumn(band, F.when(F.col("__g") == 1, "all").otherwise(F.col(band))).drop("__g")


def switch_band(n) -> object:
    """Bands of switches: 0, 1-2, 3-5, 6+."""
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")


def tie_band(n) -> object:
    """Bands of equally good founders: 1, 2-3, 4-6, 7-12, 13+."""
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 12, "7-12").otherwise("13+")


def breakpoints(path: DataFrame, keys: list[str], t: str, label: str) -> DataFrame:
    """Places just before a change of label."""
    w = W.partitionBy(*keys).orderBy(t)
    return path.withColumn("__b", F.lag(label).over(w)).where(F.col("__b") != F.col(label)).select(*keys, (F.col(t) - 1).alias(t))


def breakpoint_prf(pred: DataFrame, true: DataFrame, keys: list[str], t: str, tol: int) -> DataFrame:
    """Precision, recall and F1 of predicted breakpoints within a tolerance, over all keys together."""
    from haploom.operators.intervals import within_tolerance

    n = lambda df, name: df.agg(F.count("*").alias(name))
    hit_p, hit_t = within_tolerance(pred, true, keys, t, tol), within_tolerance(true, pred, keys, t, tol)
    row = n(hit_p, "tp_prec").crossJoin(n(pred, "n_pred")).crossJoin(n(hit_t, "tp_rec")).crossJoin(n(true, "n_true"))  # four single rows
    out = row.withColumn("precision", F.col("tp_prec") / F.greatest("n_pred", F.lit(1))).withColumn("recall", F.col("tp_rec") / F.greatest("n_true", F.lit(1)))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def pair_accuracy(df: DataFrame, p1: str, p2: str, h1: str, h2: str) -> DataFrame:
    """Share of sites with the right unordered pair, and of right founders with half credit for each."""
    lo, hi = F.least(p1, p2) == F.least(h1, h2), F.greatest(p1, p2) == F.greatest(h1, h2)
    return df.agg(F.count("*").alias("n"), F.avg((lo & hi).cast("double")).alias("pair_acc"), F.avg((lo.cast("double") + hi.cast("double")) / 2).alias("hap_acc"))


def _alike(cells: DataFrame, keys: list[str], t: str, founder: str, value: str, truth: str) -> tuple[DataFrame, DataFrame]:
    """Sites with the segments of one true founder; and whether each founder is like the truth all along a segment."""
    from haploom.operators.islands import with_segments

    # a site's cells stay together until its segment is known: one row of founders a site, and no join with itself
    gathered = cells.groupBy(*keys, t, truth).agg(F.collect_list(F.struct(F.col(founder).alias("f"), F.col(value).alias("v"))).alias("__cells"))
    segments = with_segments(gathered, [truth], [t], keys, "segment")
    own = F.get(F.filter("__cells", lambda c: c["f"] == F.col(truth)), F.lit(0))["v"]
    known = segments.withColumn("__true", own).where("__true IS NOT NULL")
    laid = known.select(*keys, "segment", "__true", F.explode("__cells").alias("c")).select(*keys, "segment", F.col("c.f").alias(founder), (F.col("c.v") == F.col("__true")).alias("__like"))
    return segments.drop("__cells"), laid.groupBy(*keys, "segment", founder).agg(F.bool_and("__like").alias("__same"))


def ceilings(cells: DataFrame, keys: list[str], t: str, founder: str, value: str, truth: str, carried: DataFrame, called: DataFrame) -> DataFrame:
    """By windows: the ceiling from reads alone, that among carried founders, what lies between (headroom), the
    segments where fewer are carried than indistinguishable, and errors of a call with those within the set.

    Arguments as of ``ceiling``; ``called`` holds keys, t and ``called``.
    """
    segments, every = _alike(cells, keys, t, founder, value, truth)
    same, seg = every.where("__same").drop("__same"), [*keys, "segment"]
    counted = lambda df, name: df.groupBy(*seg).agg(F.count("*").alias(name))
    each = counted(segments, "l").join(counted(same, "s"), seg, "left").join(counted(same.join(carried, [*keys, founder], "left_semi"), "k"), seg, "left")
    s, k = F.coalesce("s", F.lit(1)), F.coalesce("k", F.lit(0))
    share = lambda n: F.sum(F.col("l") / n) / F.sum("l")
    sized = each.groupBy(*keys).agg(F.sum("l").alias("n_sites"), share(s).alias("read_ceiling"), share(F.greatest(k, F.lit(1))).alias("carried_ceiling"), F.count_if(s > k).alias("n_dropped"))
    wrong = segments.join(called, [*keys, t]).where(F.col("called") != F.col(truth)).withColumnRenamed("called", founder)
    told = wrong.join(same.withColumn("__in", F.lit(1)), [*seg, founder], "left").groupBy(*keys).agg(F.count("*").alias("errors"), F.count("__in").alias("errors_alike"))
    out = sized.withColumn("headroom", F.col("carried_ceiling") - F.col("read_ceiling")).join(told, keys, "left")
    return out.fillna(0, ["errors", "errors_alike"])


def ceiling(cells: DataFrame, keys: list[str], t: str, founder: str, value: str, truth: str, carried: DataFrame | None = None) -> DataFrame:
    """Best accuracy that identical founders allow, by windows.

    ``cells``: keys, t, founder, value (0/1) and the true founder of the site. In a run of one true
    founder, a founder is indistinguishable if its value is the truth's at every site; a run of length L
    with S such founders can be right L / S times. ``carried`` (keys, founder) restricts S, 1 at least.
    """
    segments, same = _alike(cells, keys, t, founder, value, truth)
    if carried is not None:
        same = same.join(carried, [*keys, founder], "left_semi")
    sets = same.groupBy(*keys, "segment").agg(F.greatest(F.count_if("__same"), F.lit(1)).alias("s"))
    sizes = segments.groupBy(*keys, "segment").agg(F.count("*").alias("l"))
    each = sizes.join(sets, [*keys, "segment"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    return each.groupBy(*keys).agg(F.sum("l").alias("n_sites"), (F.count("*") - 1).alias("switches"), F.sum(F.col("l") / F.col("s")).alias("expected"))


def affinity(cells: DataFrame, individual: list[str], founder: str, value: str) -> DataFrame:
    """Mean match rate of each individual and founder, and less the individual's mean."""
    rate = cells.groupBy(*individual, founder).agg(F.avg(value).alias("rate"))
    return rate.withColumn("centred", F.col("rate") - F.avg("rate").over(W.partitionBy(*individual)))


def hot_and_cold(df: DataFrame, value: str, rate: str, share: float = 0.1) -> DataFrame:
    """Mean of a value where a rate is in its lowest and in its highest share; borders by sketches of bounded size
    (off by a millionth of the rows at most)."""
    both = df.where(F.col(value).isNotNull() & F.col(rate).isNotNull())
    edges = both.agg(F.percentile_approx(rate, [share, 1 - share], 1_000_000).alias("__edges"))
    laid = both.crossJoin(F.broadcast(edges))
    mean = lambda inside: F.avg(F.when(inside, F.col(value)))
    return laid.agg(mean(F.col(rate) <= F.col("__edges")[0]).alias("cold"), mean(F.col(rate) >= F.col("__edges")[1]).alias("hot"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of the rows with both values, equal values sharing their mean rank."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(col: str) -> DataFrame:
        # values are dealt by range; each range is ranked on its own, after the rows of the ranges before it
        n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n"))
        laid = staged(n.repartitionByRange(col).withColumn("__p", F.spark_partition_id()), "ranges")
        sums = laid.groupBy("__p").agg(F.sum("__n").alias("__all"))
        before = sums.select("__p", F.coalesce(F.sum("__all").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        below = F.sum("__n").over(W.partitionBy("__p").orderBy(col).rowsBetween(W.unboundedPreceding, -1))
        ranked = laid.withColumn("__below", F.coalesce(below, F.lit(0))).join(before, "__p")
        return ranked.select(F.col(col), (F.col("__before") + F.col("__below") + (F.col("__n") + 1) / 2).alias(f"__r_{col}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"__r_{x}", f"__r_{y}").alias("rho"))


def array_stats(df: DataFrame, value: str) -> DataFrame:
    """Smallest, largest and mean finite value, and whether others occur."""
    v = F.col(value)
    fine = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    kept = F.when(fine, v)
    return df.agg(F.min(kept).alias("low"), F.max(kept).alias("high"), F.avg(kept).alias("mean"), F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(F.abs(v) == F.lit(float("inf"))), F.lit(False)).alias("has_inf"))


def path_hits(path: DataFrame, reads: DataFrame, keys: list[str], parent: str, members: str) -> DataFrame:
    """Share of sites whose parent is among the founders read there."""
    return path.join(reads, keys).agg(F.count("*").alias("n"), F.avg(F.array_contains(members, F.col(parent)).cast("double")).alias("accuracy"))


def top_rank_of_truth(counts: DataFrame, keys: list[str], founder: str, n: str, truth: DataFrame) -> DataFrame:
    """Median rank of the true founder by reads, and how often it is among the first three."""
    ranked = counts.withColumn("__rank", F.rank().over(W.partitionBy(*keys).orderBy(F.desc(n))))
    own = truth.join(ranked, [*keys, founder])
    return own.agg(F.count("*").alias("n"), F.median("__rank").alias("median_rank"), F.avg((F.col("__rank") <= 3).cast("double")).alias("top3"))


def read_diagnostics(counts: DataFrame, sites: DataFrame, keys: list[str], founder: str, n: str, truth: str) -> DataFrame:
    """Mean reads of a site, share of sites without any, and how often the true founder (of ``sites``) has a read."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__n"))
    own = counts.select(*keys, F.col(founder).alias(truth), F.col(n).alias("__own"))
    joined = sites.join(total, keys, "left").join(own, [*keys, truth], "left")
    reads, has = F.coalesce("__n", F.lit(0)), F.coalesce(F.col("__own") > 0, F.lit(False))
    return joined.agg(F.count("*").alias("n_sites"), F.avg(reads).alias("mean_reads"), F.avg((reads == 0).cast("double")).alias("zero_share"), F.avg(has.cast("double")).alias("founder_has_read"))


def het_by_truth(df: DataFrame, p1: str, p2: str, h1: str, h2: str) -> DataFrame:
    """Sites that are truly heterozygous or not, and the share called heterozygous among them."""
    return df.groupBy((F.col(h1) != F.col(h2)).alias("true_het")).agg(F.count("*").alias("n"), F.avg((F.col(p1) != F.col(p2)).cast("double")).alias("called_het"))


def best_of_grid(scores: DataFrame, params: list[str], score: str) -> DataFrame:
    """The parameters of the best score, the smallest of equal ones."""
    return scores.agg(F.max(F.struct(F.col(score), *((-F.col(p)).alias(p) for p in params))).alias("b")).select(*((-F.col(f"b.{p}")).alias(p) for p in params), F.col(f"b.{score}").alias(score))


def by_class(df: DataFrame, keys: list[str], correct: str) -> DataFrame:
    """Rows and accuracy for every combination of keys, for each key alone, and for all (null: all)."""
    cols = [F.col(k) for k in keys]
    return df.groupingSets([cols, *[[c] for c in cols], []], *cols).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def founders_per_individual(df: DataFrame, keys: list[str], h1: str, h2: str, unknown: int) -> DataFrame:
    """Distinct founders over both haplotypes, unknown ones left out."""
    long = df.select(*keys, F.explode(F.array(h1, h2)).alias("__f")).where(F.col("__f") != unknown)
    return long.groupBy(*keys).agg(F.count_distinct("__f").alias("n_founders"))


def masked_accuracy(df: DataFrame, keys: list[str], cells: str, p1: str, p2: str) -> DataFrame:
    """Of masked sites: how often either decoded founder matches what was held out, and how often any could."""
    hit = (F.get(cells, F.col(p1)) != 0) | (F.get(cells, F.col(p2)) != 0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("either"), F.avg(F.exists(cells, lambda x: x != 0).cast("double")).alias("ceiling"))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's part of its key's sum."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(W.partitionBy(*keys)))


def span_share(trees: DataFrame, keys: list[str], span: str, frequency: str) -> DataFrame:
    """Part of the length where a founder is present, and its mean frequency weighted by span."""
    total = F.sum(span)
    return trees.groupBy(*keys).agg((F.sum(F.when(F.col(frequency) > 0, F.col(span)).otherwise(0)) / total).alias("present"), (F.sum(F.col(span) * F.col(frequency)) / total).alias("frequency"))
