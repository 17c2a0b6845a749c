"""All queries over the driver's tables: name -> (DataFrame function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import intervals, islands, kernels, lattice, metrics, order, simulate, sites, variants, windows
from haploom.plans import views as V
from haploom.plans.views import K, with_views
from haploom.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
LETTERS = [f"f{i}" for i in range(K)]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """An array of cells as columns f0, f1, ..."""
    return df.select(*keys, *(F.col("features")[i].cast("long").alias(c) for i, c in enumerate(LETTERS)))


WIDE = ", ".join(f"CAST(max(CASE WHEN founder = {i} THEN x END) AS BIGINT) AS f{i}" for i in range(K))


# --- reads and sites -------------------------------------------------------------------------


@query(with_views("SELECT contig, count(*) AS n_rows, count(DISTINCT pos) AS n_pos, min(pos) AS min_pos, max(pos) AS max_pos FROM reads GROUP BY contig", "reads"))
def reads_summary(s, d):
    return metrics.reads_summary(V.reads(s, d))


@query(with_views("SELECT contig, pos, founder, n FROM counts", "counts"))
def founder_counts(s, d):
    return V.counts(s, d)


@query(with_views("SELECT founder, CAST(sum(n) AS BIGINT) AS reads, round(sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM counts), 6) AS weight FROM counts GROUP BY founder", "counts"))
def founder_weights(s, d):
    return metrics.founder_weights(V.counts(s, d)).withColumn("weight", F.round("weight", 6))


@query(with_views("SELECT contig, pos, array_to_string(list_sort(list_distinct(flatten(list(members)))), ',') AS members, CAST(sum(n) AS BIGINT) AS n FROM reads GROUP BY contig, pos", "reads"))
def collapse_sites(s, d):
    c = sites.collapse_sets(V.reads(s, d), ["contig", "pos"], "members", "n")
    return c.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query(with_views(f"SELECT contig, pos, {WIDE} FROM cells GROUP BY contig, pos", "cells"))
def site_features(s, d):
    return wide(V.features(s, d), "contig", "pos")


@query(with_views(f"SELECT contig, pos, {WIDE.replace('THEN x', 'THEN CAST(x > 0 AS INTEGER)')} FROM cells GROUP BY contig, pos", "cells"))
def multihot_sites(s, d):
    c = sites.collapse_sets(V.reads(s, d), ["contig", "pos"], "members", "n")
    return wide(c.withColumn("features", sites.multihot(F.col("members"), K)), "contig", "pos")


@query(with_views("SELECT contig, pos, bin_count AS n_present FROM (SELECT contig, pos, count(*) FILTER (x > 0) AS bin_count FROM cells GROUP BY contig, pos)", "cells"))
def packed_popcount(s, d):
    packed = V.features(s, d).withColumn("bits", sites.pack_bits(F.col("features")))
    return packed.select("contig", "pos", F.bit_count("bits").cast("long").alias("n_present"))


@query(
    with_views(
        f"""SELECT e.contig, e.bin, {', '.join(f'CAST(least(coalesce(max(CASE WHEN b.founder = {i} THEN b.x END), 0), 127) AS BIGINT) AS f{i}' for i in range(K))}
        FROM every e LEFT JOIN binned b ON b.contig = e.contig AND b.bin = e.bin GROUP BY e.contig, e.bin""",
        "counts",
        more="binned AS (SELECT contig, pos // 50 AS bin, founder, sum(n) AS x FROM counts GROUP BY ALL), every AS (SELECT contig, unnest(range(max(pos) // 50 + 1)) AS bin FROM reads GROUP BY contig)",
    )
)
def dense_bins(s, d):
    r = V.reads(s, d).withColumn("bin", scalar.bin_of(F.col("pos"), 50))
    last = r.groupBy("contig").agg(F.max("bin").alias("last_bin"))
    return wide(sites.fill_bins(sites.features(r, ["contig", "bin"], "members", "n", K), ["contig"], "bin", last, K), "contig", "bin")


@query(with_views("SELECT present, count(*) AS n_sites FROM (SELECT contig, pos, count(*) FILTER (x > 0) AS present FROM cells GROUP BY contig, pos) GROUP BY present", "cells"))
def site_frequency_spectrum(s, d):
    return metrics.spectrum(V.features(s, d)).withColumn("present", F.col("present").cast("long"))


@query(
    with_views(
        """SELECT contig, pos, CAST(CASE WHEN hi > lo THEN floor((pos - lo) / CAST(hi - lo AS DOUBLE) * 127) ELSE 0 END AS INTEGER) AS pos_minmax, round((pos - mean) / (sd + 1e-8), 6) AS pos_z, round(log10(pos + 1), 6) AS pos_log
        FROM (SELECT contig, pos, min(pos) OVER w AS lo, max(pos) OVER w AS hi, avg(pos) OVER w AS mean, stddev_pop(pos) OVER w AS sd FROM path WINDOW w AS (PARTITION BY contig))""",
        "path",
    )
)
def positional_embedding(s, d):
    p = sites.positional(V.path(s, d), ["contig"], "pos")
    return p.select("contig", "pos", "pos_minmax", F.round("pos_z", 6).alias("pos_z"), F.round("pos_log", 6).alias("pos_log"))


# --- paths and intervals ----------------------------------------------------------------------


@query(with_views('SELECT chrom, start, "end", parent1, parent2, n_sites FROM bed', "bed"))
def bed_runs(s, d):
    return V.bed(s, d)


@query(with_views('SELECT chrom, count(*) AS n_rows, min(start) AS min_start, max("end") AS max_end, CAST(sum("end" - start) AS BIGINT) AS coverage, round(avg("end" - start), 6) AS mean_size, count(DISTINCT parent1) AS n_parents, count(DISTINCT (parent1, parent2)) AS n_pairs FROM bed GROUP BY chrom', "bed"))
def bed_summary(s, d):
    return metrics.interval_summary(V.bed(s, d)).withColumn("mean_size", F.round("mean_size", 6))


@query(
    with_views(
        """SELECT parent, count(*) FILTER (place = 1) AS regions1, count(*) FILTER (place = 2) AS regions2, CAST(sum(CASE WHEN place = 1 THEN s ELSE 0 END) AS BIGINT) AS coverage1,
        CAST(sum(CASE WHEN place = 2 THEN s ELSE 0 END) AS BIGINT) AS coverage2, count(DISTINCT chrom) AS n_chroms
        FROM (SELECT chrom, "end" - start AS s, 1 AS place, parent1 AS parent FROM bed UNION ALL SELECT chrom, "end" - start, 2, parent2 FROM bed) GROUP BY parent""",
        "bed",
    )
)
def bed_parent_stats(s, d):
    return metrics.parent_stats(V.bed(s, d))


@query(
    with_views(
        """SELECT chrom, parent, ord, CAST(s AS BIGINT) AS start, CAST(greatest(e, s) AS BIGINT) AS "end" FROM (
        SELECT b.chrom, parent, ord, CASE WHEN lag("end") OVER w IS NULL THEN 0 ELSE floor((lag("end") OVER w + start) / 2.0) END AS s,
        CASE WHEN lead(start) OVER w IS NULL THEN coalesce(length, "end") ELSE floor(("end" + lead(start) OVER w) / 2.0) END AS e
        FROM spans b LEFT JOIN lengths l ON l.chrom = b.chrom WINDOW w AS (PARTITION BY b.chrom ORDER BY start, "end"))""",
        "lengths",
    )
)
def bed_contiguous(s, d):
    return intervals.make_contiguous(V.spans(s, d), V.lengths(s, d)).select("chrom", "parent", "ord", "start", "end")


@query(
    with_views(
        """SELECT * FROM (SELECT b.chrom, parent, ord, CAST(coalesce(lag("end") OVER w, 0) AS BIGINT) AS start, CAST(CASE WHEN lead(start) OVER w IS NULL THEN coalesce(length, "end") ELSE "end" END AS BIGINT) AS "end"
        FROM spans b LEFT JOIN lengths l ON l.chrom = b.chrom WINDOW w AS (PARTITION BY b.chrom ORDER BY start, "end")) WHERE start <> "end\"""",
        "lengths",
    )
)
def adjust_coords(s, d):
    return intervals.adjust_coords(V.spans(s, d), V.lengths(s, d)).select("chrom", "parent", "ord", "start", "end")


@query(with_views('SELECT chrom, ord, CAST(sum("end" - start) OVER w AS BIGINT) AS fa_end, CAST(sum("end" - start) OVER w - ("end" - start) AS BIGINT) AS fa_start FROM spans WINDOW w AS (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING)', "spans"))
def fasta_offsets(s, d):
    return intervals.running_offsets(V.spans(s, d), ["chrom"], ["start", "end"], F.col("end") - F.col("start")).select("chrom", "ord", "fa_end", "fa_start")


_SITES = "wanted AS (SELECT DISTINCT 'chr' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS chrom, l_orderkey * 3 + l_linenumber AS pos FROM lineitem)"


def _wanted(s, d):
    return V.table(s, d, "lineitem").select(V.contig(F.col("l_suppkey"), 3).alias("chrom"), (F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("pos")).distinct()


@query(with_views('SELECT w.chrom, w.pos, CAST(coalesce(arg_max(parent, ord), -1) AS INTEGER) AS parent FROM wanted w LEFT JOIN spans b ON b.chrom = w.chrom AND w.pos >= b.start AND w.pos <= b."end" GROUP BY w.chrom, w.pos', "spans", more=_SITES))
def bin_label_fill(s, d):
    return intervals.label_points(_wanted(s, d), V.spans(s, d), ["chrom"], "pos", "start", "end", "parent", "ord", 16, default=-1)


@query(
    with_views(
        """SELECT h.sample, h.chrom, h.pos, coalesce(a.allele, '.') || '/' || coalesce(b.allele, '.') AS gt FROM (
          SELECT t.ord % 2 AS sample, w.chrom, w.pos, arg_max(t.parent, t.ord) AS p1, arg_max((t.parent + 1) % 7, t.ord) AS p2
          FROM (SELECT DISTINCT chrom, pos FROM wanted) w JOIN spans t ON t.chrom = w.chrom AND w.pos BETWEEN t.start + 1 AND t."end" GROUP BY ALL) h
        LEFT JOIN panel a ON a.pos = h.pos AND a.chrom = h.chrom AND a.member = h.p1 LEFT JOIN panel b ON b.pos = h.pos AND b.chrom = h.chrom AND b.member = h.p2""",
        "spans",
        more=_SITES + ", panel AS (SELECT chrom, pos, m AS member, CASE WHEN (pos + m) % 3 = 0 THEN 'A' ELSE 'C' END AS allele FROM wanted CROSS JOIN (SELECT unnest(range(6)) AS m))",
    )
)
def range_join_panel(s, d):
    w = _wanted(s, d)
    laid = V.spans(s, d).withColumn("sample", F.col("ord") % 2).withColumnRenamed("parent", "parent1").withColumn("parent2", (F.col("parent1") + 1) % 7)
    panel = w.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("allele", F.when((F.col("pos") + F.col("member")) % 3 == 0, "A").otherwise("C"))
    return variants.panel_genotypes(w, laid, panel, 16)


@query(
    with_views(
        """SELECT l.chrom, l.pos, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR hi - l.pos > l.pos - lo THEN lo ELSE hi END AS nearest
        FROM (SELECT w.chrom, w.pos, b.start AS lo FROM wanted w ASOF LEFT JOIN spans b ON w.chrom = b.chrom AND w.pos >= b.start) l
        JOIN (SELECT w.chrom, w.pos, b.start AS hi FROM wanted w ASOF LEFT JOIN spans b ON w.chrom = b.chrom AND w.pos <= b.start) h ON l.chrom = h.chrom AND l.pos = h.pos""",
        "spans",
        more=_SITES,
    )
)
def nearest_site(s, d):
    starts = V.spans(s, d).select("chrom", F.col("start").alias("at"))
    return intervals.nearest_site(_wanted(s, d), starts, ["chrom"], "pos", "at", bucket=1 << 14)


@query(with_views("SELECT w.chrom, w.pos, CAST(1000000 + w.pos - b.start AS BIGINT) AS target_pos FROM wanted w JOIN spans b ON b.chrom = w.chrom AND w.pos >= b.start AND w.pos < b.\"end\"", "spans", more=_SITES))
def lift_over(s, d):
    blocks = V.spans(s, d).select("chrom", "start", "end", F.lit(1000000).alias("target_start"), F.lit("+").alias("strand"))
    return intervals.lift_over(_wanted(s, d), blocks, ["chrom"], "pos", 16).select("chrom", "pos", F.col("target_pos").cast("long").alias("target_pos"))


@query(with_views("SELECT contig, CAST(sum(c) AS BIGINT) AS crossovers FROM (SELECT contig, CASE WHEN p1 <> lag(p1) OVER (PARTITION BY contig ORDER BY pos) THEN 1 ELSE 0 END AS c FROM path) GROUP BY contig", "path"))
def path_crossovers(s, d):
    return islands.crossovers(V.path(s, d), ["contig"], ["pos"], ["p1"])


@query(with_views("SELECT p1, CAST(sum(dist) AS BIGINT) AS distance, round_even(100.0 * sum(dist) / (SELECT sum(dist) FROM dists), 2) AS percent FROM dists GROUP BY p1", "path", more="dists AS (SELECT p1, lead(pos) OVER (PARTITION BY contig ORDER BY pos) - pos AS dist FROM path QUALIFY dist > 0)"))
def parent_contribution(s, d):
    return metrics.parent_contribution(V.path(s, d), ["contig"], "pos", "p1")


@query(with_views("SELECT pos, CAST(arg_max(p1, (n, -p1)) AS INTEGER) AS mode, CAST(sum(n) AS BIGINT) AS size FROM (SELECT pos, p1, count(*) AS n FROM path GROUP BY ALL) GROUP BY pos", "path"))
def mode_per_site(s, d):
    return metrics.mode_per_key(V.path(s, d), ["pos"], "p1")


@query(with_views("SELECT count(*) AS n, round(avg(CASE WHEN list_contains(members, p1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM path JOIN (SELECT contig, pos, flatten(list(members)) AS members FROM reads GROUP BY ALL) r USING (contig, pos)", "path"))
def path_hits(s, d):
    r = sites.collapse_sets(V.reads(s, d), ["contig", "pos"], "members", "n")
    return metrics.path_hits(V.path(s, d), r, ["contig", "pos"], "p1", "members").withColumn("accuracy", F.round("accuracy", 6))


@query(with_views("SELECT chrom, count(*) AS n FROM (SELECT contig AS chrom FROM path UNION ALL SELECT chrom FROM spans) GROUP BY chrom", "path", "spans"))
def union_paths(s, d):
    return V.path(s, d).select(F.col("contig").alias("chrom")).unionByName(V.spans(s, d).select("chrom")).groupBy("chrom").agg(F.count("*").alias("n"))


def _span_contigs(s, d):
    """Contigs are few and joined once each, by broadcast: their rows would all meet in one task."""
    return F.broadcast(V.spans(s, d).select(F.col("chrom").alias("contig")).distinct())


@query(with_views("SELECT DISTINCT contig FROM path WHERE contig NOT IN (SELECT chrom FROM spans)", "path", "spans"))
def anti_missing_contigs(s, d):
    return V.path(s, d).select("contig").distinct().join(_span_contigs(s, d), "contig", "left_anti")


@query(with_views("SELECT contig, count(*) AS n FROM path WHERE contig IN (SELECT chrom FROM spans) GROUP BY contig", "path", "spans"))
def semi_covered_contigs(s, d):
    return V.path(s, d).groupBy("contig").agg(F.count("*").alias("n")).join(_span_contigs(s, d), "contig", "left_semi")


# --- variants ---------------------------------------------------------------------------------

_GT = """CASE WHEN gt IS NULL OR trim(gt) IN ('.', './.', '.|.', '') THEN NULL ELSE string_split(trim(gt), CASE WHEN contains(gt, '/') THEN '/' ELSE '|' END) END"""
_COMPARED = f"""ta AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt, info, gt) AS dup, {_GT} AS parts, list_concat([ref], string_split(alt, ',')) AS pool FROM truth),
ia AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt, info, gt) AS dup, {_GT} AS parts, list_concat([ref], string_split(alt, ',')) AS pool FROM imputed),
tb AS (SELECT *, CASE WHEN list_bool_and(list_transform(parts, lambda p: try_cast(p AS INTEGER) IS NOT NULL AND try_cast(p AS INTEGER) < len(pool))) THEN list_sort(list_transform(parts, lambda p: pool[try_cast(p AS INTEGER) + 1])) END AS alleles FROM ta),
ib AS (SELECT *, CASE WHEN list_bool_and(list_transform(parts, lambda p: try_cast(p AS INTEGER) IS NOT NULL AND try_cast(p AS INTEGER) < len(pool))) THEN list_sort(list_transform(parts, lambda p: pool[try_cast(p AS INTEGER) + 1])) END AS alleles FROM ia),
compared AS (SELECT coalesce(t.chrom, i.chrom) AS chrom, coalesce(t.pos, i.pos) AS pos, coalesce(t.ref, i.ref) AS ref, coalesce(t.dup, i.dup) AS dup, t.gt AS t_gt, i.gt AS i_gt, t.alleles AS t_alleles, i.alleles AS i_alleles, t.alt AS t_alt, t.info AS info,
  t.chrom IS NOT NULL AS in_t, i.chrom IS NOT NULL AS in_i,
  CASE WHEN i.chrom IS NULL THEN 'MISSING_IN_IMPUTED_SITE' WHEN t.chrom IS NULL THEN 'EXTRA_IN_IMPUTED_SITE'
    WHEN t.alleles IS NULL AND i.alleles IS NULL THEN CASE WHEN contains(t.gt, '.') AND contains(i.gt, '.') THEN 'BOTH_MISSING_GT' ELSE 'GT_UNPARSEABLE' END
    WHEN t.alleles IS NULL THEN CASE WHEN contains(t.gt, '.') THEN 'TRUTH_MISSING_GT' ELSE 'GT_UNPARSEABLE' END
    WHEN i.alleles IS NULL THEN CASE WHEN contains(i.gt, '.') THEN 'IMPUTED_MISSING_GT' ELSE 'GT_UNPARSEABLE' END
    WHEN t.alleles = i.alleles THEN 'MATCH_ALLELE' ELSE 'MISMATCH_ALLELE' END AS kind
  FROM tb t FULL JOIN ib i ON t.chrom = i.chrom AND t.pos = i.pos AND t.ref = i.ref AND t.dup = i.dup),
scored AS (SELECT *, CASE WHEN kind IN ('MATCH_ALLELE', 'MISMATCH_ALLELE') THEN list_sum(list_transform(list_distinct(t_alleles), lambda a: least(len(list_filter(t_alleles, lambda x: x = a)), len(list_filter(i_alleles, lambda x: x = a))))) / CAST(len(t_alleles) AS DOUBLE) END AS score FROM compared)"""


def _compared(s, d):
    return variants.compare(V.truth(s, d), V.imputed(s, d))


@query(with_views("SELECT chrom, pos, ref, CAST(dup AS INTEGER) AS dup, kind, round(score, 6) AS score FROM scored", "truth", "imputed", more=_COMPARED))
def vcf_compare_sites(s, d):
    return _compared(s, d).select("chrom", "pos", "ref", "dup", "kind", F.round("score", 6).alias("score"))


@query(
    with_views(
        """SELECT count(*) FILTER (in_t) AS truth_records, count(*) FILTER (in_i) AS imputed_records, count(*) FILTER (kind = 'MATCH_ALLELE') AS match_allele, count(*) FILTER (kind = 'MISMATCH_ALLELE') AS mismatch_allele,
        count(*) FILTER (kind = 'MISSING_IN_IMPUTED_SITE') AS missing_in_imputed_site, count(*) FILTER (kind = 'EXTRA_IN_IMPUTED_SITE') AS extra_in_imputed_site, count(*) FILTER (kind = 'TRUTH_MISSING_GT') AS truth_missing_gt,
        count(*) FILTER (kind = 'IMPUTED_MISSING_GT') AS imputed_missing_gt, count(*) FILTER (kind = 'BOTH_MISSING_GT') AS both_missing_gt, count(*) FILTER (kind = 'GT_UNPARSEABLE') AS gt_unparseable, round(sum(score), 4) AS credit,
        round(count(*) FILTER (kind = 'MATCH_ALLELE') / CAST(count(*) FILTER (kind IN ('MATCH_ALLELE', 'MISMATCH_ALLELE')) AS DOUBLE), 6) AS concordance,
        round(sum(score) / count(*) FILTER (kind IN ('MATCH_ALLELE', 'MISMATCH_ALLELE')), 6) AS partial_concordance, count(*) = count(*) FILTER (kind = 'MATCH_ALLELE') AS identical_strict FROM scored""",
        "truth",
        "imputed",
        more=_COMPARED,
    )
)
def vcf_counts(s, d):
    c = variants.counters(_compared(s, d))
    return c.withColumn("credit", F.round("credit", 4)).withColumn("concordance", F.round("concordance", 6)).withColumn("partial_concordance", F.round("partial_concordance", 6))


@query(
    with_views(
        """SELECT zygosity, CAST(least(floor(value * 20), 19) AS INTEGER) AS bin, count(*) AS total, round(sum(correct), 4) AS correct,
          round(CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN pow(corr(x, y), 2) END, 6) AS r2 FROM (
          SELECT CASE WHEN len(list_distinct(t_alleles)) = 1 THEN 'hom' ELSE 'het' END AS zygosity,
            CASE WHEN len(list_distinct(t_alleles)) = 1 THEN CASE WHEN list_contains(t_alleles, t_alt) THEN p ELSE 1 - p END ELSE least(p, 1 - p) END AS value,
            CASE WHEN t_alleles = i_alleles THEN 1.0::DOUBLE WHEN len(list_distinct(t_alleles)) = 1 THEN 0.0::DOUBLE ELSE score END AS correct,
            CAST(len(list_filter(t_alleles, lambda a: list_contains(string_split(t_alt, ','), a))) AS DOUBLE) AS x, CAST(len(list_filter(i_alleles, lambda a: list_contains(string_split(t_alt, ','), a))) AS DOUBLE) AS y
          FROM (SELECT *, CASE WHEN contains(info, 'AC=') THEN CAST(regexp_extract(info, 'AC=(\\d+)', 1) AS DOUBLE) / CAST(regexp_extract(info, 'AN=(\\d+)', 1) AS DOUBLE) END AS p FROM scored
                WHERE kind IN ('MATCH_ALLELE', 'MISMATCH_ALLELE')) WHERE p IS NOT NULL) GROUP BY ALL""".replace("\\\\", "\\"),
        "truth",
        "imputed",
        more=_COMPARED,
    )
)
def vcf_frequency_bins(s, d):
    return variants.frequency_bins(_compared(s, d)).withColumn("correct", F.round("correct", 4)).withColumn("r2", F.round("r2", 6))


# --- windows ----------------------------------------------------------------------------------

_KNN = """sums AS (SELECT contig, pos, founder, sum(x) OVER (PARTITION BY contig, founder ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY s DESC, founder DESC) AS r FROM sums)"""


@query(with_views("SELECT contig, pos, founder AS p1, founder AS p2 FROM ranked WHERE r = 1", "cells", more=_KNN))
def knn_haploid(s, d):
    return windows.knn(V.features(s, d), ["contig"], ["pos"], K, 11).select("contig", "pos", "p1", "p2")


@query(
    with_views(
        """SELECT contig, pos, f1 AS p1, CASE WHEN coalesce((s1 - s2) / CAST(nullif(s1 + s2, 0) AS DOUBLE), 0) < 0.9 THEN f2 ELSE f1 END AS p2 FROM (
          SELECT contig, pos, max(CASE WHEN r = 1 THEN founder END) AS f1, max(CASE WHEN r = 2 THEN founder END) AS f2, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2
          FROM ranked WHERE r <= 2 GROUP BY contig, pos)""",
        "cells",
        more=_KNN,
    )
)
def knn_diploid(s, d):
    return windows.knn(V.features(s, d), ["contig"], ["pos"], K, 11, diploid=True).select("contig", "pos", "p1", "p2")


_WINDOWED = """total AS (SELECT contig, max(ord) + 1 AS n FROM path GROUP BY contig),
windowed AS (SELECT p.*, unnest(range(greatest(CAST(floor((p.ord - 64) / 32.0) AS BIGINT) + 1, 0), least(p.ord // 32, (n - 64) // 32) + 1)) AS win FROM path p JOIN total USING (contig) WHERE n >= 64)"""


def _windowed(s, d):
    return windows.sliding(V.path(s, d), ["contig"], "ord", 64, 32)


@query(with_views("SELECT contig, win AS \"window\", count(*) AS n, min(pos) AS first_pos, CAST(max(ord - win * 32) AS INTEGER) AS last_t FROM windowed GROUP BY contig, win", "path", more=_WINDOWED))
def sliding_windows(s, d):
    return _windowed(s, d).groupBy("contig", "window").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("t").alias("last_t"))


@query(
    with_views(
        """SELECT contig, win AS "window", ord FROM (SELECT *, ord - win * 32 AS t, max(win) OVER (PARTITION BY contig) AS last FROM windowed)
        WHERE t >= CASE WHEN win = 0 THEN 0 ELSE 16 END AND t < CASE WHEN win = last THEN 64 ELSE 48 END""",
        "path",
        more=_WINDOWED,
    )
)
def window_centre_crop(s, d):
    return windows.owned(_windowed(s, d), ["contig"], 64, 32).select("contig", "window", "ord")


@query(
    with_views(
        "SELECT contig, win AS \"window\", CAST(arg_max(p1, (n, -p1)) AS INTEGER) AS p1, max(n) AS votes FROM (SELECT contig, win, p1, count(*) AS n FROM windowed GROUP BY ALL) GROUP BY contig, win",
        "path",
        more=_WINDOWED,
    )
)
def window_majority_vote(s, d):
    return windows.majority_vote(_windowed(s, d), ["contig", "window"], "p1")


@query(
    with_views(
        """SELECT contig, win AS "window", founder, CAST(sum(x) AS BIGINT) AS total, CAST(max(longest) AS BIGINT) AS longest FROM (
          SELECT contig, win, founder, x, CASE WHEN x = 1 THEN count(*) OVER (PARTITION BY contig, win, founder, g) ELSE 0 END AS longest FROM (
            SELECT contig, win, founder, x, sum(CASE WHEN x = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY contig, win, founder ORDER BY ord) * 2 + CASE WHEN x = 1 THEN 0 ELSE 1 END AS g FROM (
              SELECT w.contig, w.win, w.ord, c.founder, CAST(c.x > 0 AS INTEGER) AS x FROM windowed w JOIN cells c ON c.contig = w.contig AND c.pos = w.pos))) GROUP BY ALL""",
        "path",
        "cells",
        more=_WINDOWED,
    )
)
def window_scores(s, d):
    laid = _windowed(s, d).join(V.cells(s, d).withColumn("x", (F.col("x") > 0).cast("int")), ["contig", "pos"])
    return windows.window_scores(laid, ["contig"], "founder", "x").select("contig", "window", "founder", F.col("total").cast("long").alias("total"), F.col("longest").cast("long").alias("longest"))


@query(with_views("SELECT contig, \"window\", count(*) AS n, count(*) FILTER (pos IS NULL) AS padded FROM (SELECT e.contig, e.ord // 512 AS \"window\", p.pos FROM every e LEFT JOIN path p ON p.contig = e.contig AND p.ord = e.ord) GROUP BY ALL", "path", more="every AS (SELECT contig, unnest(range(CAST(ceil((max(ord) + 1) / 512.0) AS BIGINT) * 512)) AS ord FROM path GROUP BY contig)"))
def padded_windows(s, d):
    p = V.path(s, d).join(V.features(s, d), ["contig", "pos"])
    return windows.padded_windows(p, ["contig"], "ord", 512, K).groupBy("contig", "window").agg(F.count("*").alias("n"), F.count_if(F.col("pos").isNull()).alias("padded"))


# --- evaluation -------------------------------------------------------------------------------

_BOTH = "twice AS (SELECT contig, pos, ord, p1, p2 FROM path JOIN second USING (contig, pos))"


def _both(s, d):
    return V.path(s, d).join(V.second(s, d), ["contig", "pos"])


@query(
    with_views(
        """SELECT coalesce(contig, 'all') AS contig, count(*) AS n, round(avg(CASE WHEN p1 = p2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM twice GROUP BY GROUPING SETS ((contig), ())""",
        "path",
        "second",
        more=_BOTH,
    )
)
def stratified_accuracy(s, d):
    return metrics.stratified(_both(s, d).withColumn("right", F.col("p1") == F.col("p2")), "contig", "right").withColumn("accuracy", F.round("accuracy", 6))


@query(with_views("SELECT count(*) AS n, round(avg(CASE WHEN least(p1, p2) = least(p2, 3) AND greatest(p1, p2) = greatest(p2, 3) THEN 1.0 ELSE 0.0 END), 6) AS pair_acc, round(avg((CASE WHEN least(p1, p2) = least(p2, 3) THEN 1.0 ELSE 0.0 END + CASE WHEN greatest(p1, p2) = greatest(p2, 3) THEN 1.0 ELSE 0.0 END) / 2), 6) AS hap_acc FROM twice", "path", "second", more=_BOTH))
def pair_accuracy(s, d):
    b = _both(s, d).withColumn("h1", F.col("p2")).withColumn("h2", F.lit(3))
    return metrics.pair_accuracy(b, "p1", "p2", "h1", "h2").select("n", F.round("pair_acc", 6).alias("pair_acc"), F.round("hap_acc", 6).alias("hap_acc"))


@query(
    with_views(
        """SELECT *, round(tp_prec / greatest(n_pred, 1), 6) AS precision, round(tp_rec / greatest(n_true, 1), 6) AS recall,
        round(2 * (tp_prec / greatest(n_pred, 1)) * (tp_rec / greatest(n_true, 1)) / greatest(tp_prec / greatest(n_pred, 1) + tp_rec / greatest(n_true, 1), 1e-9), 6) AS f1 FROM (
        SELECT count(*) FILTER (EXISTS (SELECT 1 FROM bt WHERE bt.contig = bp.contig AND abs(bt.ord - bp.ord) <= 2)) AS tp_prec, count(*) AS n_pred,
        (SELECT count(*) FROM bt WHERE EXISTS (SELECT 1 FROM bp b WHERE b.contig = bt.contig AND abs(bt.ord - b.ord) <= 2)) AS tp_rec, (SELECT count(*) FROM bt) AS n_true FROM bp)""",
        "path",
        "second",
        more=_BOTH
        + """, bp AS (SELECT contig, ord - 1 AS ord FROM (SELECT *, lag(p1) OVER (PARTITION BY contig ORDER BY ord) AS b FROM twice) WHERE b <> p1),
        bt AS (SELECT contig, ord - 1 AS ord FROM (SELECT *, lag(p2) OVER (PARTITION BY contig ORDER BY ord) AS b FROM twice) WHERE b <> p2)""",
    )
)
def breakpoint_prf(s, d):
    b = _both(s, d)
    out = metrics.breakpoint_prf(metrics.breakpoints(b, ["contig"], "ord", "p1"), metrics.breakpoints(b, ["contig"], "ord", "p2"), ["contig"], "ord", 2)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_CEILING = """laid AS (SELECT c.contig, p.ord // 100 AS win, p.ord, c.founder, CAST(c.x > 0 AS INTEGER) AS x, p.p1 FROM cells c JOIN path p ON p.contig = c.contig AND p.pos = c.pos),
segs AS (SELECT contig, win, ord, sum(new) OVER (PARTITION BY contig, win ORDER BY ord) AS seg FROM (SELECT contig, win, ord, CASE WHEN p1 <> lag(p1) OVER w OR lag(p1) OVER w IS NULL THEN 1 ELSE 0 END AS new
  FROM (SELECT DISTINCT contig, win, ord, p1 FROM laid) WINDOW w AS (PARTITION BY contig, win ORDER BY ord))),
same AS (SELECT l.contig, l.win, s.seg, l.founder, bool_and(l.x = t.x) AS same FROM laid l JOIN segs s USING (contig, win, ord) JOIN laid t ON t.contig = l.contig AND t.win = l.win AND t.ord = l.ord AND t.founder = t.p1 GROUP BY ALL),
sets AS (SELECT contig, win, seg, greatest(count(*) FILTER (same), 1) AS s FROM same {where} GROUP BY ALL),
sizes AS (SELECT contig, win, seg, count(*) AS l FROM segs GROUP BY ALL)"""
_CEIL_OUT = "SELECT contig, win, CAST(sum(l) AS BIGINT) AS n_sites, count(*) - 1 AS switches, round(sum(l / CAST(coalesce(s, 1) AS DOUBLE)), 4) AS expected FROM sizes LEFT JOIN sets USING (contig, win, seg) GROUP BY contig, win"


def _laid(s, d):
    p = V.path(s, d).withColumn("win", F.floor(F.col("ord") / 100))
    return V.cells(s, d).withColumn("x", (F.col("x") > 0).cast("int")).join(p, ["contig", "pos"]).select("contig", "win", "ord", "founder", "x", "p1")


@query(with_views(_CEIL_OUT, "cells", "path", more=_CEILING.format(where="")))
def ibd_ceiling(s, d):
    return metrics.ceiling(_laid(s, d), ["contig", "win"], "ord", "founder", "x", "p1").withColumn("expected", F.round("expected", 4))


@query(with_views(_CEIL_OUT, "cells", "path", more=_CEILING.format(where="WHERE founder IN (SELECT p1 FROM path WHERE path.contig = same.contig AND path.ord // 100 = same.win)")))
def relatedness_ceiling(s, d):
    laid = _laid(s, d)
    carried = laid.select("contig", "win", F.col("p1").alias("founder")).distinct()
    return metrics.ceiling(laid, ["contig", "win"], "ord", "founder", "x", "p1", carried).withColumn("expected", F.round("expected", 4))


@query(
    with_views(
        """SELECT band, count(*) AS n, round(avg(CASE WHEN p1 = p2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
          SELECT p1, p2, CASE WHEN ties <= 1 THEN '1' WHEN ties <= 3 THEN '2-3' WHEN ties <= 6 THEN '4-6' WHEN ties <= 12 THEN '7-12' ELSE '13+' END AS band FROM twice JOIN (
            SELECT contig, pos, count(*) FILTER (x = most) AS ties FROM (SELECT *, max(x) OVER (PARTITION BY contig, pos) AS most FROM cells) GROUP BY ALL) USING (contig, pos)) GROUP BY band""",
        "path",
        "second",
        "cells",
        more=_BOTH,
    )
)
def tie_accuracy(s, d):
    ties = F.size(F.filter("features", lambda x: x == F.array_max("features")))
    b = _both(s, d).join(V.features(s, d), ["contig", "pos"]).withColumn("band", metrics.tie_band(ties))
    return b.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p1") == F.col("p2")).cast("double")), 6).alias("accuracy"))


_AFFINITY = "rates AS (SELECT contig, founder, avg(CAST(x > 0 AS INTEGER)) AS rate FROM cells GROUP BY contig, founder)"


def _affinity(s, d):
    return metrics.affinity(V.cells(s, d).withColumn("x", (F.col("x") > 0).cast("int")), ["contig"], "founder", "x")


@query(with_views("SELECT contig, founder, round(rate, 6) AS rate, round(rate - avg(rate) OVER (PARTITION BY contig), 6) AS centred FROM rates", "cells", more=_AFFINITY))
def founder_affinity(s, d):
    return _affinity(s, d).select("contig", "founder", F.round("rate", 6).alias("rate"), F.round("centred", 6).alias("centred"))


@query(
    with_views(
        """SELECT r.contig, r.founder FROM rates r JOIN (SELECT contig, max(gap) AS most, arg_max(nxt, (gap, rate)) AS cut FROM (
          SELECT *, rate - nxt AS gap FROM (SELECT *, lead(rate) OVER (PARTITION BY contig ORDER BY rate DESC) AS nxt FROM rates)) GROUP BY contig) g USING (contig) WHERE most < 0.002 OR rate > cut""",
        "cells",
        more=_AFFINITY,
    )
)
def affinity_keep(s, d):
    return order.largest_gap_keep(_affinity(s, d), ["contig"], "rate", 0.002).select("contig", "founder")


@query(with_views("SELECT contig, founder FROM (SELECT *, max(rate) OVER (PARTITION BY contig) AS m FROM rates) WHERE rate >= greatest(0.05, 0.95 * m)", "cells", more=_AFFINITY))
def keep_set(s, d):
    return order.keep_above(_affinity(s, d), ["contig"], "rate", 0.95, 0.05).select("contig", "founder")


@query(
    with_views(
        """SELECT contig, round(1 - avg(CASE WHEN u = 0 THEN 1.0 ELSE i / CAST(u AS DOUBLE) END), 6) AS het_proxy FROM (
          SELECT contig, pos, count(*) FILTER (x > 0 AND b > 0) AS i, count(*) FILTER (x > 0 OR b > 0) AS u FROM (SELECT *, lag(x) OVER (PARTITION BY contig, founder ORDER BY pos) AS b FROM cells) WHERE b IS NOT NULL GROUP BY ALL) GROUP BY contig""",
        "cells",
    )
)
def het_proxy(s, d):
    return sites.adjacent_jaccard(V.features(s, d), ["contig"], ["pos"]).withColumn("het_proxy", F.round("het_proxy", 6))


@query("SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT avg(ix) OVER (PARTITION BY x) AS rx, avg(iy) OVER (PARTITION BY y) AS ry FROM (SELECT l_quantity AS x, l_discount AS y, row_number() OVER (ORDER BY l_quantity) AS ix, row_number() OVER (ORDER BY l_discount) AS iy FROM lineitem))")
def spearman(s, d):
    t = V.table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return metrics.spearman(t, "x", "y").withColumn("rho", F.round("rho", 6))


@query("SELECT round(avg(c), 6) AS mean_corr FROM (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY l_suppkey)")
def window_corr(s, d):
    return metrics.mean_correlation(V.table(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select(F.round("mean_corr", 6).alias("mean_corr"))


@query("SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, coalesce(bool_or(isnan(value)), false) AS has_nan, coalesce(bool_or(isinf(value)), false) AS has_inf FROM events WHERE value IS NOT NULL")
def array_stats(s, d):
    return metrics.array_stats(V.table(s, d, "events").where("value IS NOT NULL"), "value").withColumn("mean", F.round("mean", 6))


@query(with_views("SELECT count(*) AS n, median(r) AS median_rank, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM (SELECT contig, pos, founder, rank() OVER (PARTITION BY contig, pos ORDER BY n DESC) AS r FROM counts) JOIN second s USING (contig, pos) WHERE founder = s.p2", "counts", "second"))
def truth_rank(s, d):
    return metrics.top_rank_of_truth(V.counts(s, d), ["contig", "pos"], "founder", "n", V.second(s, d).withColumnRenamed("p2", "founder")).withColumn("top3", F.round("top3", 6))


@query(with_views("SELECT contig, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd FROM counts GROUP BY GROUPING SETS ((contig), ())", "counts"))
def contig_stats(s, d):
    """By contig and over all."""
    return metrics.value_stats(V.counts(s, d), "contig", "n").select("contig", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(with_views("SELECT p1, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM path GROUP BY p1", "path"))
def value_counts(s, d):
    return metrics.value_shares(V.path(s, d), "p1").select("p1", "n", F.round(100.0 * F.col("share"), 4).alias("percent"))


@query(with_views("SELECT round(avg(CASE WHEN p1 <> p2 THEN 1.0 ELSE 0.0 END), 6) AS het, count(DISTINCT p1) AS n1, count(DISTINCT p2) AS n2 FROM twice", "path", "second", more=_BOTH))
def het_fraction(s, d):
    return _both(s, d).agg(F.round(F.avg((F.col("p1") != F.col("p2")).cast("double")), 6).alias("het"), F.count_distinct("p1").alias("n1"), F.count_distinct("p2").alias("n2"))


@query(
    with_views(
        """SELECT b.contig, count(*) AS n, round(avg(CASE WHEN label < 0 THEN 1.0 ELSE 0.0 END), 6) AS unlabelled, round(avg(CASE WHEN label < 0 THEN NULL WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS supported
        FROM (SELECT *, CASE WHEN pos % 4 = 0 THEN -1 ELSE p2 END AS label FROM twice) b LEFT JOIN cells c ON c.contig = b.contig AND c.pos = b.pos AND c.founder = label GROUP BY b.contig""",
        "path",
        "second",
        "cells",
        more=_BOTH,
    )
)
def label_quality(s, d):
    """A quarter of the sites without a label."""
    b = _both(s, d).withColumn("label", F.when(F.col("pos") % 4 == 0, -1).otherwise(F.col("p2"))).join(V.features(s, d), ["contig", "pos"])
    return metrics.label_support(b, ["contig"], "label").select("contig", "n", *(F.round(c, 6).alias(c) for c in ("unlabelled", "supported")))


@query(
    with_views(
        "SELECT contig, p1, count(*) AS n, round(avg(CASE WHEN p1 = p2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM twice GROUP BY GROUPING SETS ((contig, p1), (contig), (p1), ())",
        "path",
        "second",
        more=_BOTH,
    )
)
def accuracy_by_class(s, d):
    return metrics.by_class(_both(s, d).withColumn("right", F.col("p1") == F.col("p2")), ["contig", "p1"], "right").withColumn("accuracy", F.round("accuracy", 6))


@query(with_views("SELECT contig, count(DISTINCT f) AS n_founders FROM (SELECT contig, p1 AS f FROM twice UNION ALL SELECT contig, p2 FROM twice) WHERE f <> 6 GROUP BY contig", "path", "second", more=_BOTH))
def founders_per_individual(s, d):
    return metrics.founders_per_individual(_both(s, d), ["contig"], "p1", "p2", 6)


@query(
    with_views(
        """SELECT contig, count(*) AS n, round(avg(hit), 6) AS either, round(avg(could), 6) AS ceiling FROM (
          SELECT b.contig, b.pos, max(CASE WHEN c.founder IN (b.q1, b.q2) AND x > 0 THEN 1.0 ELSE 0.0 END) AS hit, max(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS could
          FROM held b JOIN cells c ON c.contig = b.contig AND c.pos = b.pos WHERE b.pos % 7 = 0 GROUP BY ALL) GROUP BY contig""",
        "path",
        "second",
        "cells",
        more=_BOTH
        + """, held AS (SELECT contig, pos, last_value(CASE WHEN pos % 7 <> 0 THEN p1 END IGNORE NULLS) OVER w AS q1, last_value(CASE WHEN pos % 7 <> 0 THEN p2 END IGNORE NULLS) OVER w AS q2
        FROM twice WINDOW w AS (PARTITION BY contig ORDER BY pos))""",
    )
)
def masked_accuracy(s, d):
    """Every seventh position is held out and called by the site before it."""
    w = W.partitionBy("contig").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    held = F.col("pos") % 7 == 0
    called = _both(s, d).select("contig", "pos", *(F.last(F.when(~held, F.col(c)), ignorenulls=True).over(w).alias(c) for c in ("p1", "p2"))).where(held)
    m = metrics.masked_accuracy(called.join(V.features(s, d), ["contig", "pos"]), ["contig"], "features", "p1", "p2")
    return m.withColumn("either", F.round("either", 6)).withColumn("ceiling", F.round("ceiling", 6))


@query(with_views("SELECT contig, pos, founder, round(n / CAST(sum(n) OVER (PARTITION BY contig, pos) AS DOUBLE), 6) AS share FROM counts", "counts"))
def read_shares(s, d):
    return metrics.shares(V.counts(s, d), ["contig", "pos"], "n").select("contig", "pos", "founder", F.round("share", 6).alias("share"))


@query(with_views("SELECT p.contig, p.ord, p.p1, q.ord AS other FROM path p JOIN (SELECT contig, ord, row_number() OVER (PARTITION BY contig ORDER BY ord DESC) - 1 AS o FROM path WHERE ord % 2 = 0) q ON q.contig = p.contig AND q.o = p.ord", "path"))
def positional_join(s, d):
    p = V.path(s, d)
    other = p.where("ord % 2 = 0").select("contig", F.col("ord").alias("other"))
    return order.zip_join(p.select("contig", "ord", "p1"), other, ["contig"], ["ord"], [F.desc("other")])


@query("SELECT CAST(q AS INTEGER) AS q, CAST(t AS INTEGER) AS t, round(score, 6) AS score FROM (SELECT q.q, t.t, avg(CASE WHEN l_quantity > q.q AND l_tax * 100 > t.t THEN l_discount ELSE 0 END) AS score FROM lineitem CROSS JOIN (SELECT unnest([10, 20, 30]) AS q) q CROSS JOIN (SELECT unnest([1, 2, 4]) AS t) t GROUP BY ALL) ORDER BY score DESC LIMIT 1")
def parameter_grid(s, d):
    grid = s.createDataFrame([(q, t) for q in (10, 20, 30) for t in (1, 2, 4)], "q int, t int")
    hit = F.when((F.col("l_quantity") > F.col("q")) & (F.col("l_tax") * 100 > F.col("t")), F.col("l_discount")).otherwise(0.0)
    scores = V.table(s, d, "lineitem").crossJoin(F.broadcast(grid)).groupBy("q", "t").agg(F.avg(hit).alias("score"))
    return metrics.best_of_grid(scores, ["q", "t"], "score").withColumn("score", F.round("score", 6))


@query(with_views("SELECT contig, pos, round((n - avg(n) OVER (PARTITION BY contig)) / nullif(stddev_pop(n) OVER (PARTITION BY contig), 0), 6) AS z FROM (SELECT contig, pos, CAST(sum(n) AS DOUBLE) AS n FROM reads GROUP BY ALL)", "reads"))
def site_z_scores(s, d):
    n = V.reads(s, d).groupBy("contig", "pos").agg(F.sum("n").cast("double").alias("n"))
    return windows.smoothed(n, ["contig"], "n").select("contig", "pos", F.round("z", 6).alias("z"))


@query("SELECT p_brand, CAST(place AS INTEGER) AS place, CAST(old AS INTEGER) AS old FROM (SELECT p_brand, old, row_number() OVER (ORDER BY CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), p_brand) - 1 AS place FROM (SELECT p_brand, min(p_size) AS old FROM part GROUP BY p_brand))")
def reordered_rows(s, d):
    return order.renumbered(V.table(s, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("int").alias("old")), "p_brand", "old").select("p_brand", "place", "old")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY n DESC LIMIT 3")
def sorted_top(s, d):
    t = V.table(s, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return order.sort_by(t, "n", True, "l_returnflag").limit(3)


# --- pairs, arrays, scalars -------------------------------------------------------------------

_PAIR = f"CAST(least(p1, p2) * {K} - least(p1, p2) * (least(p1, p2) - 1) // 2 + greatest(p1, p2) - least(p1, p2) AS INTEGER)"
_CALLED = "called AS (SELECT p.contig, p.pos, p1, p2 FROM path p JOIN second s ON s.contig = p.contig AND s.pos = p.pos)"


def _called(s, d):
    return V.path(s, d).join(V.second(s, d), ["contig", "pos"]).select("contig", "pos", "p1", "p2")


@query(with_views(f"SELECT CAST(least(p1, p2) AS INTEGER) AS i, CAST(greatest(p1, p2) AS INTEGER) AS j, {_PAIR} AS pair, count(*) AS n FROM called GROUP BY ALL", "path", "second", more=_CALLED))
def pair_index(s, d):
    """The pairs that two opinions call, with their places."""
    i, j = F.least("p1", "p2"), F.greatest("p1", "p2")
    return _called(s, d).groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("n")).withColumn("pair", sites.pair_index(F.col("i"), F.col("j"), K))


@query(
    with_views(
        """SELECT a, b, count(*) AS n, min(least(CAST(p1 <> q1 AS INTEGER) + CAST(p2 <> q2 AS INTEGER), CAST(p1 <> q2 AS INTEGER) + CAST(p2 <> q1 AS INTEGER))) AS switches FROM (
          SELECT p1, p2, lead(p1) OVER w AS q1, lead(p2) OVER w AS q2, pair AS a, lead(pair) OVER w AS b FROM numbered WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE b IS NOT NULL GROUP BY a, b""",
        "path",
        "second",
        more=f"{_CALLED}, numbered AS (SELECT *, {_PAIR} AS pair FROM called)",
    )
)
def pair_switch_matrix(s, d):
    """How often each called pair follows another, and how many founders change between them."""
    w = W.partitionBy("contig").orderBy("pos")
    called = _called(s, d).withColumn("a", sites.pair_index(F.col("p1"), F.col("p2"), K))
    moved = called.withColumns({"b": F.lead("a").over(w), "q1": F.lead("p1").over(w), "q2": F.lead("p2").over(w)}).where("b IS NOT NULL")
    return moved.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(sites.switches(*map(F.col, ("p1", "p2", "q1", "q2")))).alias("switches"))


@query(
    """SELECT vec_id, CAST(top1 AS INTEGER) AS top1, CAST(top2 AS INTEGER) AS top2, round(exp(v1 - mx) / total, 6) AS p1 FROM (
      SELECT vec_id, max(CASE WHEN r = 1 THEN i END) AS top1, max(CASE WHEN r = 2 THEN i END) AS top2, max(CASE WHEN r = 1 THEN v END) AS v1, max(v) AS mx, sum(exp(v - m)) AS total FROM (
        SELECT vec_id, i, v, max(v) OVER (PARTITION BY vec_id) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM (
          SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)) GROUP BY vec_id)"""
)
def softmax_top2(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = order.top_k_indices(F.col("v"), 2)
    return e.select("vec_id", order.argmax(F.col("v")).alias("top1"), top[1].cast("int").alias("top2"), F.round(F.array_max(kernels.softmax_array(F.col("v"))), 6).alias("p1"))


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(s, d):
    number, name = order.natural_key(F.col("p_brand"))
    return V.table(s, d, "part").select("p_brand").distinct().withColumn("place", F.row_number().over(W.orderBy(number, name)))


def _sized(s, d):
    p = V.path(s, d)
    return p.join(p.groupBy("contig").agg(F.count("*").alias("t")), "contig")


@query(with_views("SELECT contig, split, count(*) AS n FROM (SELECT contig, CASE WHEN ord < t - CAST(floor(t * 0.1) AS BIGINT) - CAST(floor(t * 0.2) AS BIGINT) THEN 'train' WHEN ord < t - CAST(floor(t * 0.1) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY contig) AS t FROM path)) GROUP BY contig, split", "path"))
def split_head_slices(s, d):
    return order.head_split(_sized(s, d), "ord", F.col("t"), 0.2, 0.1).groupBy("contig", "split").agg(F.count("*").alias("n"))


@query(with_views("SELECT contig, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY contig) AS t FROM path) WHERE ord < t - t % 64 GROUP BY contig", "path"))
def whole_windows(s, d):
    return order.whole_windows(_sized(s, d), "ord", F.col("t"), 64).groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, CAST((l_orderkey * 4099 >> 24) & 255 AS INTEGER) AS contig_index, ((l_orderkey * 4099) & 16777215) * 256 AS pos FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def decode_position(s, d):
    c, p = sites.decode_position(F.col("l_orderkey") * 4099)
    return V.table(s, d, "lineitem").select("l_orderkey").distinct().select("l_orderkey", c.alias("contig_index"), p.alias("pos"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 500) / 4.0 * 1000 WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 500) / 4.0 * 1000000 ELSE o_orderkey END)::BIGINT AS pos FROM orders")
def position_text(s, d):
    k = F.col("o_orderkey")
    quarter = F.format_string("%.2f", (k % 500) / 4)
    text = F.when(k % 3 == 0, F.concat(quarter, F.lit("k"))).when(k % 3 == 1, F.concat(quarter, F.lit("M"))).otherwise(F.format_number(k.cast("double"), 0))
    return V.table(s, d, "orders").select("o_orderkey", scalar.parse_position(text).alias("pos"))


# --- streams and sequences --------------------------------------------------------------------


@query(with_views("SELECT user_id, event_type, count(*) AS n, min(t) AS start, max(t) AS \"end\" FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY t) OR lag(event_type) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS new FROM seq)) GROUP BY user_id, run, event_type", "seq"))
def event_runs(s, d):
    r = islands.collapse_runs(V.seq(s, d).withColumnRenamed("t", "start"), ["user_id"], ["start"], ["event_type"])
    return r.select("user_id", "event_type", F.col("n_sites").alias("n"), "start", "end")


@query(with_views("SELECT user_id, CAST(max(CASE WHEN event_type = 'view' THEN n ELSE 0 END) AS BIGINT) AS longest FROM (SELECT user_id, event_type, count(*) AS n FROM (SELECT *, t - row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS g FROM seq) GROUP BY user_id, event_type, g) GROUP BY user_id", "seq"))
def longest_run(s, d):
    r = islands.longest_run(V.seq(s, d).withColumn("x", (F.col("event_type") == "view").cast("int")), ["user_id"], ["t"], "x")
    return r.withColumn("longest", F.col("longest").cast("long"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def event_sessions(s, d):
    return runs.sessions(V.table(s, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    return runs.windowed_counts(V.table(s, d, "events")).withColumn("total", F.round("total", 4))


# --- decoders and generators: sequential or seeded, without SQL -----------------------------------


def _decoded(s, d, model):
    return lattice.decode_long(V.features(s, d), ["contig"], "pos", model)


@query()
def hmm_haploid(s, d):
    return _decoded(s, d, "hmm_haploid")


@query()
def hmm_diploid(s, d):
    return _decoded(s, d, "hmm_diploid")


@query()
def crf_viterbi(s, d):
    return _decoded(s, d, "crf_diploid")


@query()
def crf_marginal(s, d):
    return lattice.posterior_long(V.features(s, d), ["contig"], "pos").withColumn("log_p", F.round("log_p", 6))


def _lengths(s, d):
    """Contigs of the spans, a hundred times as long."""
    return V.lengths(s, d).select("chrom", (F.col("length") * 100).alias("length"))


@query()
def sim_crossovers(s, d):
    return simulate.crossovers(s, _lengths(s, d), 100, 50_000, 400_000, 7)


@query()
def sim_mosaics(s, d):
    return simulate.mosaics(_lengths(s, d), [f"founder{i}" for i in range(8)], 6, 50_000, 400_000, 7)


@query()
def sim_alleles(s, d):
    return simulate.allele_windows(s, 64, 256, 12, 2.0, 1.0, 7)


@query()
def hashed_sample(s, d):
    """A seeded sample of 500 sites."""
    return order.hashed_sample(V.path(s, d).withColumn("site", F.concat_ws("_", "contig", "pos")), "site", 500, 3)


from haploom.plans import more_queries, store_queries  # noqa: E402, F401
