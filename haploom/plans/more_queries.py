"""Further queries over the driver's tables, registered with those of ``queries``."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.operators import intervals, kernels, lattice, metrics, order, sites, variants, windows
from haploom.plans import queries as Q
from haploom.plans import views as V
from haploom.plans.queries import query
from haploom.plans.views import K, with_views
from haploom.session import shared_dir
from haploom.sources import bed, fasta, npy, reads, vcf
from haploom.sources.text import write_lines


@query(
    with_views(
        "SELECT count(*) = count(*) FILTER (kind = 'MATCH_ALLELE') AS identical_strict, count(*) FILTER (in_t) AS truth_records, count(*) FILTER (kind = 'MATCH_ALLELE') AS match_allele FROM scored",
        "imputed",
        more="clean AS (SELECT * FROM imputed WHERE gt IN ('0/0', '0/1', '1|1', '1', '1/0', '1/1')), " + Q._COMPARED.replace("FROM truth", "FROM clean").replace("FROM imputed", "FROM clean"),
    )
)
def vcf_identical(s, d):
    """Called genotypes against themselves."""
    clean = V.imputed(s, d).where("gt IN ('0/0', '0/1', '1|1', '1', '1/0', '1/1')")
    return variants.counters(variants.compare(clean, clean)).select("identical_strict", "truth_records", "match_allele")


@query(
    with_views(
        "SELECT chrom, count(*) FILTER (in_t) AS truth_records, count(*) FILTER (in_i) AS imputed_records, count(*) FILTER (kind = 'MATCH_ALLELE') AS match_allele, count(*) FILTER (kind = 'MISMATCH_ALLELE') AS mismatch_allele, round(sum(score), 4) AS credit, count(*) = count(*) FILTER (kind = 'MATCH_ALLELE') AS identical_strict FROM scored GROUP BY chrom",
        "truth",
        "imputed",
        more=Q._COMPARED,
    )
)
def vcf_counts_by_chrom(s, d):
    out = variants.counters(Q._compared(s, d), ["chrom"]).withColumn("credit", F.round("credit", 4))
    return out.select("chrom", "truth_records", "imputed_records", "match_allele", "mismatch_allele", "credit", "identical_strict")


@query(
    with_views(
        "SELECT kind, chrom, pos, ref, CAST(dup AS INTEGER) AS dup FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY chrom, pos, ref, dup) AS r FROM scored WHERE kind <> 'MATCH_ALLELE') WHERE r <= 5",
        "truth",
        "imputed",
        more=Q._COMPARED,
    )
)
def vcf_examples(s, d):
    """Up to five examples of each kind of difference."""
    apart = Q._compared(s, d).where("kind <> 'MATCH_ALLELE'").select("kind", "chrom", "pos", "ref", "dup")
    return order.top_per_group(apart, ["kind"], ["chrom", "pos", "ref", "dup"], 5)


@query(with_views("SELECT contig, pos, p1 FROM path WHERE ord >= 10 AND ord < 30", "path"))
def ordinal_slice(s, d):
    return order.ordinal_slice(V.path(s, d), "ord", 10, 30).select("contig", "pos", "p1")


@query(
    with_views(
        """SELECT contig, founder FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY rate DESC, founder) AS r FROM rates) WHERE rate >= 0.55 OR r = 1
        UNION ALL SELECT DISTINCT contig, 7 AS founder FROM rates""",
        "cells",
        more="rates AS (SELECT contig, founder, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM cells GROUP BY contig, founder)",
    )
)
def presence_cutoff(s, d):
    """Founders of each contig by their share of sites, the last class being unknown."""
    rates = V.features(s, d).groupBy("contig").agg(F.array(*(F.avg((F.col("features")[i] > 0).cast("double")) for i in range(K)), F.lit(0.0)).alias("rates"))
    return rates.select("contig", F.explode(order.present_or_best(F.col("rates"), 0.55)).alias("founder"))


_SCORES = Q.REGISTRY["window_scores"][1]


@query(
    f"""SELECT contig, "window", CAST(r AS INTEGER) AS rank, s.founder, round(score * weight, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY contig, "window" ORDER BY score DESC, founder) AS r FROM (SELECT contig, "window", founder, total + longest AS score FROM ({_SCORES}) WHERE founder <> 2)) s
    JOIN (SELECT founder, sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS weight FROM ({with_views("SELECT founder, n FROM counts", "counts")}) c GROUP BY founder) w ON s.founder = w.founder WHERE r <= 3""".replace(
        "FROM c)", f"FROM ({with_views('SELECT n FROM counts', 'counts')}))"
    )
)
def window_top_founders(s, d):
    scores = windows.window_scores(Q._windowed(s, d).join(V.cells(s, d).withColumn("x", (F.col("x") > 0).cast("int")), ["contig", "pos"]), ["contig"], "founder", "x")
    top = windows.top_founders(scores, ["contig"], "founder", 3, [2], metrics.founder_weights(V.counts(s, d)))
    return top.withColumn("score", F.round("score", 4))


@query(
    with_views(
        """SELECT v.contig, count(*) AS n, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
          SELECT contig, pos, CAST(arg_max(label, (n, -label)) AS INTEGER) AS label FROM (SELECT contig, pos, CASE WHEN win % 3 = 0 THEN p2 ELSE p1 END AS label, count(*) AS n FROM windowed JOIN second USING (contig, pos) GROUP BY ALL) GROUP BY contig, pos) v
        JOIN cells c ON c.contig = v.contig AND c.pos = v.pos AND c.founder = v.label GROUP BY v.contig""",
        "path",
        "second",
        "cells",
        more=Q._WINDOWED,
    )
)
def voted_accuracy(s, d):
    """Overlapping windows vote on each site; how often the winner has a read there."""
    labelled = Q._windowed(s, d).join(V.second(s, d), ["contig", "pos"]).withColumn("label", F.when(F.col("window") % 3 == 0, F.col("p2")).otherwise(F.col("p1")))
    voted = windows.majority_vote(labelled, ["contig", "pos"], "label").join(V.features(s, d), ["contig", "pos"])
    right = F.coalesce(F.get("features", F.col("label")) > 0, F.lit(False))
    return voted.groupBy("contig").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


@query(
    with_views(
        "SELECT contig AS chrom, count(*) AS n, round(avg(CASE WHEN p1 < 6 AND p2 < 6 AND ((pos + p1) % 3 = 0) = ((pos + p2) % 3 = 0) THEN 1.0 ELSE 0.0 END), 6) AS concordance FROM twice GROUP BY contig",
        "path",
        "second",
        more=Q._BOTH,
    )
)
def panel_concordance(s, d):
    """Alleles of two opinions on the founder of each site; the panel lacks founder 6."""
    b = Q._both(s, d).withColumnRenamed("contig", "chrom")
    panel = b.select("chrom", "pos", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("member")).withColumn("allele", F.when((F.col("pos") + F.col("member")) % 3 == 0, "A").otherwise("C"))
    out = variants.panel_concordance(b, panel, ["chrom", "pos"], "p1", "p2")
    return out.groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.avg(F.col("same").cast("double")), 6).alias("concordance"))


@query(
    with_views(
        """SELECT chrom, region, parent, CAST(sum(code) AS INTEGER) AS code FROM (
          SELECT chrom, CAST(row_number() OVER w - 1 AS INTEGER) AS region, parent, 1 AS code FROM spans WINDOW w AS (PARTITION BY chrom ORDER BY start, ord)
          UNION ALL SELECT chrom, CAST(row_number() OVER w - 1 AS INTEGER), CAST(ord % 7 AS INTEGER), 2 FROM spans WINDOW w AS (PARTITION BY chrom ORDER BY start, ord)) GROUP BY chrom, region, parent""",
        "spans",
    )
)
def region_codes(s, d):
    both = V.spans(s, d).withColumnRenamed("parent", "parent1").withColumn("parent2", (F.col("ord") % 7).cast("int"))
    return intervals.region_codes(both)


@query(with_views("SELECT count(*) AS n_sites, round(avg(coalesce(t.n, 0)), 6) AS mean_reads, round(avg(CASE WHEN coalesce(t.n, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(avg(CASE WHEN o.n > 0 THEN 1.0 ELSE 0.0 END), 6) AS founder_has_read FROM asked a LEFT JOIN (SELECT contig, pos, sum(n) AS n FROM counts GROUP BY ALL) t ON t.contig = a.contig AND t.pos = a.pos LEFT JOIN counts o ON o.contig = a.contig AND o.pos = a.pos AND o.founder = a.founder", "path", "counts", more="asked AS (SELECT contig, pos + ord % 2 AS pos, p1 AS founder FROM path)"))
def read_diagnostics(s, d):
    asked = V.path(s, d).select("contig", (F.col("pos") + F.col("ord") % 2).alias("pos"), F.col("p1").alias("founder"))
    return metrics.read_diagnostics(V.counts(s, d), asked, ["contig", "pos"], "founder", "n", "founder").withColumns({c: F.round(c, 6) for c in ("mean_reads", "zero_share", "founder_has_read")})


@query(with_views("SELECT p1 % 3 <> p2 % 3 AS true_het, count(*) AS n, round(avg(CASE WHEN p1 <> p2 THEN 1.0 ELSE 0.0 END), 6) AS called_het FROM twice GROUP BY ALL", "path", "second", more=Q._BOTH))
def het_by_truth(s, d):
    b = Q._both(s, d).withColumn("h1", F.col("p1") % 3).withColumn("h2", F.col("p2") % 3)
    return metrics.het_by_truth(b, "p1", "p2", "h1", "h2").withColumn("called_het", F.round("called_het", 6))


@query(
    """SELECT n.sample, n_files, first_contig, reads FROM (SELECT 's' || CAST(o_custkey % 40 AS VARCHAR) AS sample, count(DISTINCT o_orderkey % 5) AS n_files, 'chr' || CAST(min(o_orderkey % 5) AS VARCHAR) AS first_contig FROM orders GROUP BY ALL) n
    JOIN (SELECT DISTINCT 's' || CAST(c_custkey % 60 AS VARCHAR) AS sample, '/in/s' || CAST(c_custkey % 60 AS VARCHAR) || '_ps4g.txt' AS reads FROM customer WHERE c_custkey % 3 <> 0) r ON n.sample = r.sample"""
)
def paired_files(s, d):
    """Names of prediction files against names of read-support files."""
    o, c = V.table(s, d, "orders"), V.table(s, d, "customer").where("c_custkey % 3 <> 0")
    files = o.select(F.concat(F.lit("/out/s"), F.col("o_custkey") % 40, F.lit("_chr"), F.col("o_orderkey") % 5, F.lit(".npy")).alias("path")).distinct()
    reads = c.select(F.concat(F.lit("/in/s"), F.col("c_custkey") % 60, F.lit("_ps4g.txt")).alias("path")).distinct()
    return npy.pair_files(files, reads).select("sample", F.size("paths").cast("long").alias("n_files"), F.col("contigs")[0].alias("first_contig"), "reads")


# --- decoders on windows: what a decoded path scores, held against the best score by recursion ------

SITES = 32
#: Sites whose switches are scored together.
BLOCK = 4096
#: More sites than a contig has: one window holds all of them.
WHOLE = 1 << 40
_EMIT = f"""em AS MATERIALIZED (SELECT contig, pos, ord // {SITES} AS win, ord % {SITES} AS t, founder, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY contig, pos)) AS e FROM (
      SELECT contig, pos, founder, x, max(x) OVER (PARTITION BY contig, pos) AS m, dense_rank() OVER (PARTITION BY contig ORDER BY pos) - 1 AS ord FROM cells)),
    pairs AS MATERIALIZED (SELECT i.contig, i.pos, i.win, i.t, i.founder AS a, j.founder AS b, i.e + j.e AS e FROM em i JOIN em j ON i.contig = j.contig AND i.pos = j.pos AND i.founder <= j.founder)"""


def _recursive(more: str, select: str, *views: str) -> str:
    return with_views(select, "cells", *views, more=f"{_EMIT}, {more}").replace("WITH ", "WITH RECURSIVE ", 1)


def _best(states: str, emission: str, start: str, step: str, state: tuple[str, ...]) -> str:
    """SQL of the best score of each window over all paths of states."""
    own, new = ", ".join(state), ", ".join(f"n.{c}" for c in state)
    return _recursive(
        f"""v AS (SELECT contig, win, t, {own}, {emission.replace('n.', '')} + {start} AS score FROM {states} WHERE t = 0
        UNION ALL SELECT n.contig, n.win, n.t, {new}, max(v.score + {step}) + any_value({emission}) FROM v JOIN {states} n ON n.contig = v.contig AND n.win = v.win AND n.t = v.t + 1 GROUP BY n.contig, n.win, n.t, {new})""",
        'SELECT contig, win AS "window", CAST(max(t) + 1 AS INTEGER) AS n, round(arg_max(best, t), 4) AS score FROM (SELECT contig, win, t, max(score) AS best FROM v GROUP BY ALL) GROUP BY contig, win',
    )


def _cut(s, d):
    """Sites in windows of ``SITES``."""
    ordered = order.numbered(V.features(s, d), ["pos"], ["contig"])
    return ordered.withColumn("window", F.floor(F.col("ord") / SITES)).withColumn("t", (F.col("ord") % SITES).cast("int"))


def _path_score(s, d, model, start, same, one, two, homozygous=0.0, single=False):
    """What the path that a model finds in each window scores, by emissions and switches of its founders."""
    cut = _cut(s, d)
    path = lattice.decode_windows(cut.select("contig", "window", "t", "features"), ["contig", "window"], "t", model)
    return _scored(cut, path, model, start, same, one, two, homozygous, single)


def _long_score(s, d, model, *costs, **more):
    """The same for contigs that are decoded in chunks of 100 sites."""
    cut = order.numbered(V.features(s, d), ["pos"], ["contig"], "t").withColumn("window", F.lit(0).cast("long"))
    path = lattice.decode_long(cut.select("contig", "t", "features"), ["contig"], "t", model, chunk=100).withColumn("window", F.lit(0).cast("long"))
    return _scored(cut, path, model, *costs, **more, digits=3).select("contig", F.col("n").cast("long").alias("n"), "score")


def _long(sql: str) -> str:
    """The SQL of windows for whole contigs."""
    inner = sql.replace(f"ord // {SITES} AS win, ord % {SITES} AS t", f"ord // {WHOLE} AS win, ord % {WHOLE} AS t").replace("CAST(max(t) + 1 AS INTEGER)", "max(t) + 1").replace(", 4) AS score", ", 3) AS score")
    return inner.replace('SELECT contig, win AS "window", ', "SELECT contig, ")


def _scored(cut, path, model, start, same, one, two, homozygous=0.0, single=False, digits=4):
    """contig, window, n, score of a path by window and t."""
    logs = cut.select("contig", "window", "t", F.transform(kernels.softmax_array(F.col("features").cast("array<double>")), lambda x: F.log(x)).alias("e"))
    both = path.join(logs, ["contig", "window", "t"])
    # a window may be a whole contig: it is taken in blocks, each with the last site before it
    block = F.floor(F.col("t") / BLOCK)
    both = both.withColumn("block", F.explode(F.when((F.col("t") + 1) % BLOCK == 0, F.array(block, block + 1)).otherwise(F.array(block))))
    w = W.partitionBy("contig", "window", "block").orderBy("t")
    q1, q2 = F.lag("p1").over(w), F.lag("p2").over(w)
    moved = (F.col("p1") != q1).cast("int") + (F.col("p2") != q2).cast("int")
    if model.startswith("crf"):
        moved = F.least(moved, (F.col("p1") != q2).cast("int") + (F.col("p2") != q1).cast("int"))
    if single:
        moved = (F.col("p1") != q1).cast("int")
    cost = F.when(q1.isNull(), F.lit(start)).when(moved == 0, F.lit(same)).when(moved == 1, F.lit(one)).otherwise(F.lit(two))
    emitted = F.get("e", F.col("p1")) + (F.lit(0.0) if single else F.get("e", F.col("p2")) + F.when(F.col("p1") == F.col("p2"), homozygous).otherwise(0.0))
    scored = both.select("contig", "window", "t", "block", (emitted + cost).alias("score")).where(F.col("block") == block)
    return scored.groupBy("contig", "window").agg((F.max("t") + 1).alias("n"), F.round(F.sum("score"), digits).alias("score"))


_STAY, _MOVE = math.log(0.99), math.log(0.01 / (K - 1))
_SLOTS = "CASE WHEN v.a = n.a AND v.b = n.b THEN {same} WHEN v.a = n.a OR v.b = n.b THEN {one} ELSE -1e6 END"
_LOW = 0.2 * 1.0


@query(_best("em", "n.e", f"(-ln({K}))", f"CASE WHEN v.founder = n.founder THEN ln(0.99) ELSE ln(0.01 / {K - 1}) END", ("founder",)))
def hmm_haploid_windows(s, d):
    return _path_score(s, d, "hmm_haploid", -math.log(K), _STAY, _MOVE, 0.0, single=True)


@query(_best("pairs", "(n.e + CASE WHEN n.a = n.b THEN -0.1 ELSE 0 END)", f"(-ln({K * (K + 1) // 2}))", _SLOTS.format(same="ln(0.99)", one=f"ln(0.01 / {K - 1})"), ("a", "b")))
def hmm_diploid_windows(s, d):
    return _path_score(s, d, "hmm_diploid", -math.log(K * (K + 1) / 2), _STAY, _MOVE, -1e6, -0.1)


@query(_best("em", "n.e", f"(-ln({K}))", f"CASE WHEN v.founder = n.founder THEN ln({_LOW}) ELSE ln({1 - _LOW} / {K - 1}) END", ("founder",)))
def logits_haploid_windows(s, d):
    """Read support stands for a model's logits; the largest weight is 1."""
    return _path_score(s, d, "logits_haploid", -math.log(K), math.log(_LOW), math.log((1 - _LOW) / (K - 1)), 0.0, single=True)


@query(_best("pairs", "(n.e + CASE WHEN n.a = n.b THEN -0.1 ELSE 0 END)", f"(-ln({K * (K + 1) // 2}))", _SLOTS.format(same=f"2 * ln({_LOW})", one=f"ln({_LOW}) + ln({1 - _LOW} / {K - 1})"), ("a", "b")))
def logits_diploid_windows(s, d):
    low, move = math.log(_LOW), math.log((1 - _LOW) / (K - 1))
    return _path_score(s, d, "logits_diploid", -math.log(K * (K + 1) / 2), 2 * low, low + move, -1e6, -0.1)


@query(_best("pairs", "n.e", "0.0", "(-2.0) * least((v.a <> n.a)::INT + (v.b <> n.b)::INT, (v.a <> n.b)::INT + (v.b <> n.a)::INT)", ("a", "b")))
def crf_diploid_windows(s, d):
    return _path_score(s, d, "crf_diploid", 0.0, 0.0, -2.0, -4.0)


@query(_long(Q.REGISTRY["hmm_haploid_windows"][1]))
def hmm_haploid_long(s, d):
    """Whole contigs in chunks over many tasks; the score of the path is the best that any path has."""
    return _long_score(s, d, "hmm_haploid", -math.log(K), _STAY, _MOVE, 0.0, single=True)


@query(_long(Q.REGISTRY["hmm_diploid_windows"][1]))
def hmm_diploid_long(s, d):
    return _long_score(s, d, "hmm_diploid", -math.log(K * (K + 1) / 2), _STAY, _MOVE, -1e6, -0.1)


@query(_long(Q.REGISTRY["crf_diploid_windows"][1]))
def crf_diploid_long(s, d):
    return _long_score(s, d, "crf_diploid", 0.0, 0.0, -2.0, -4.0)


@query(_best("pairs", "(n.e - CASE WHEN n.a = n.b THEN 0.7 ELSE 0 END)", "0.0", "(-2.0) * least((v.a <> n.a)::INT + (v.b <> n.b)::INT, (v.a <> n.b)::INT + (v.b <> n.a)::INT)", ("a", "b")))
def crf_penalty_windows(s, d):
    """Equal founders pay a penalty, taken from a column."""
    cut = _cut(s, d).withColumn("own", F.lit(0.7))
    path = lattice.decode_windows(cut.select("contig", "window", "t", "features", "own"), ["contig", "window"], "t", "crf_diploid", penalty="own")
    return _scored(cut, path, "crf_diploid", 0.0, 0.0, -2.0, -4.0, -0.7)


@query(_best("em", "n.e", "(-ln(4))", "CASE WHEN v.founder = n.founder THEN ln(0.99) ELSE ln(0.01 / 3) END", ("founder",)).replace("FROM cells)", "FROM cells WHERE founder % 2 = 0)"))
def hmm_kept_windows(s, d):
    """Only every other founder is decoded; paths are in terms of all."""
    even = F.array(*(F.get("features", F.lit(i)) for i in range(0, K, 2)))
    cut = _cut(s, d)
    path = lattice.decode_windows(cut.withColumn("keep", F.array(*map(F.lit, range(0, K, 2)))).select("contig", "window", "t", "features", "keep"), ["contig", "window"], "t", "hmm_haploid", keep="keep")
    halved = path.withColumns({c: (F.col(c) / 2).cast("int") for c in ("p1", "p2")})
    return _scored(cut.withColumn("features", even), halved, "hmm_haploid", -math.log(4), _STAY, math.log(0.01 / 3), 0.0, single=True)


@query(
    _recursive(
        """f AS (SELECT contig, win, t, founder, CAST(e AS DOUBLE) AS s FROM em WHERE t = 0
        UNION ALL SELECT contig, win, t, founder, e + list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) FROM (
          SELECT n.contig, n.win, n.t, n.founder, any_value(n.e) AS e, list(v.s + CASE WHEN v.founder = n.founder THEN 0 ELSE -2.0 END) AS l FROM f v JOIN em n ON n.contig = v.contig AND n.win = v.win AND n.t = v.t + 1 GROUP BY n.contig, n.win, n.t, n.founder)),
      ends AS (SELECT contig, win, max(t) AS t FROM em GROUP BY ALL),
      totals AS (SELECT contig, win, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS total FROM (SELECT contig, win, list(s) AS l FROM f JOIN ends USING (contig, win, t) GROUP BY ALL)),
      own AS (SELECT e.contig, e.win, e.t, e.e, CASE WHEN p.p1 <> lag(p.p1) OVER (PARTITION BY e.contig, e.win ORDER BY e.t) THEN -2.0 ELSE 0 END AS c FROM em e JOIN path p ON p.contig = e.contig AND p.pos = e.pos AND p.p1 = e.founder)""",
        'SELECT o.contig, o.win AS "window", round(any_value(total) - sum(e + c), 6) AS nll FROM own o JOIN totals t ON t.contig = o.contig AND t.win = o.win GROUP BY o.contig, o.win',
        "path",
    )
)
def crf_nll_windows(s, d):
    """How unlikely the founders with most reads are as a path."""
    cut = _cut(s, d).join(V.path(s, d).select("contig", "pos", "p1"), ["contig", "pos"])
    return lattice.path_nll(cut, ["contig", "window"], "t", "p1").select("contig", "window", F.round("nll", 6).alias("nll"))


def _passes(states: str, step: str, state: tuple[str, ...]) -> str:
    """SQL of the largest posterior of each site by forward and backward passes."""
    own, new = ", ".join(state), ", ".join(f"n.{c}" for c in state)
    same = " AND ".join(f"f.{c} = b.{c}" for c in state)
    total = "list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))"
    return _recursive(
        f"""f AS (SELECT contig, win, t, {own}, CAST(e AS DOUBLE) AS s FROM {states} WHERE t = 0
        UNION ALL SELECT contig, win, t, {own}, e + {total} FROM (SELECT n.contig, n.win, n.t, {new}, any_value(n.e) AS e, list(v.s + {step}) AS l FROM f v JOIN {states} n ON n.contig = v.contig AND n.win = v.win AND n.t = v.t + 1 GROUP BY n.contig, n.win, n.t, {new})),
      ends AS (SELECT contig, win, max(t) AS t FROM em GROUP BY ALL),
      b AS (SELECT contig, win, t, {own}, CAST(e AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS s FROM {states} JOIN ends USING (contig, win, t)
        UNION ALL SELECT contig, win, t, {own}, e, {total} FROM (SELECT n.contig, n.win, n.t, {new}, any_value(n.e) AS e, list(v.s + v.e + {step}) AS l FROM b v JOIN {states} n ON n.contig = v.contig AND n.win = v.win AND n.t = v.t - 1 GROUP BY n.contig, n.win, n.t, {new})),
      post AS (SELECT f.contig, f.win, f.t, list(f.s + b.s) AS l FROM f JOIN b ON f.contig = b.contig AND f.win = b.win AND f.t = b.t AND {same} GROUP BY ALL)""",
        f'SELECT contig, win AS "window", CAST(t AS INTEGER) AS t, round(abs(list_max(l) - ({total})), 6) AS cost FROM post',
    )


@query(_passes("em", "CASE WHEN v.founder = n.founder THEN 0 ELSE -2.0 END", ("founder",)))
def crf_marginal_windows(s, d):
    p = lattice.posterior_windows(_cut(s, d).select("contig", "window", "t", "features"), ["contig", "window"], "t", diploid=False)
    return p.select("contig", "window", "t", F.round(F.abs("log_p"), 6).alias("cost"))


@query(_passes("pairs", "(-2.0) * least((v.a <> n.a)::INT + (v.b <> n.b)::INT, (v.a <> n.b)::INT + (v.b <> n.a)::INT)", ("a", "b")))
def crf_marginal_pairs(s, d):
    p = lattice.posterior_windows(_cut(s, d).select("contig", "window", "t", "features"), ["contig", "window"], "t")
    return p.select("contig", "window", "t", F.round(F.abs("log_p"), 6).alias("cost"))


# --- further measures --------------------------------------------------------------------------------


@query(
    with_views(
        """SELECT contig, win, n_sites, read_ceiling, carried_ceiling, n_dropped, errors, errors_alike FROM (
          SELECT contig, win, CAST(sum(l) AS BIGINT) AS n_sites, round(sum(l / CAST(s AS DOUBLE)) / sum(l), 6) AS read_ceiling, round(sum(l / CAST(greatest(k, 1) AS DOUBLE)) / sum(l), 6) AS carried_ceiling, count(*) FILTER (s > k) AS n_dropped
          FROM sizes JOIN held USING (contig, win, seg) GROUP BY contig, win)
        JOIN (SELECT g.contig, g.win, count(*) FILTER (p1 <> p2) AS errors, count(*) FILTER (p1 <> p2 AND same) AS errors_alike FROM segs g JOIN path p ON p.contig = g.contig AND p.ord = g.ord JOIN second c ON c.contig = p.contig AND c.pos = p.pos
          JOIN same s ON s.contig = g.contig AND s.win = g.win AND s.seg = g.seg AND s.founder = p2 GROUP BY g.contig, g.win) USING (contig, win)""",
        "cells",
        "path",
        "second",
        more=Q._CEILING.format(where="")
        + """, carried AS (SELECT DISTINCT contig, ord // 100 AS win, p1 AS founder, true AS has FROM path),
        held AS (SELECT s.contig, s.win, s.seg, count(*) FILTER (same) AS s, count(*) FILTER (same AND has) AS k FROM same s LEFT JOIN carried c ON c.contig = s.contig AND c.win = s.win AND c.founder = s.founder GROUP BY ALL)""",
    )
)
def ceiling_errors(s, d):
    laid = Q._laid(s, d)
    carried = laid.select("contig", "win", F.col("p1").alias("founder")).distinct()
    called = V.path(s, d).join(V.second(s, d), ["contig", "pos"]).select("contig", F.floor(F.col("ord") / 100).alias("win"), "ord", F.col("p2").alias("called"))
    out = metrics.ceilings(laid, ["contig", "win"], "ord", "founder", "x", "p1", carried, called)
    return out.drop("headroom").withColumns({c: F.round(c, 6) for c in ("read_ceiling", "carried_ceiling")})


@query("SELECT round(avg(CASE WHEN l_discount <= lo THEN l_quantity END), 6) AS cold, round(avg(CASE WHEN l_discount >= hi THEN l_quantity END), 6) AS hot FROM lineitem, (SELECT quantile_disc(l_discount, 0.1) AS lo, quantile_disc(l_discount, 0.9) AS hi FROM lineitem)")
def hot_and_cold(s, d):
    out = metrics.hot_and_cold(V.table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), "l_discount"), "q", "l_discount")
    return out.select(F.round("cold", 6).alias("cold"), F.round("hot", 6).alias("hot"))


@query(f"SELECT contig, round(greatest(0.0, least(1.0, (het_proxy - 0.2) / 0.5)), 4) AS scale FROM ({Q.REGISTRY['het_proxy'][1].replace(', 6)', ', 12)')})")
def het_scale(s, d):
    return sites.adjacent_jaccard(V.features(s, d), ["contig"], ["pos"]).select("contig", F.round(sites.het_scale(F.col("het_proxy"), 0.2, 0.7), 4).alias("scale"))


# --- files: views written and read again ------------------------------------------------------------


def _file(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _reads_file(s, d) -> str:
    at = _file(s, "reads")
    laid = sites.collapse_sets(V.reads(s, d), ["contig", "pos"], "members", "n").select("contig", "pos", F.col("members").alias("gamete_set"), F.col("n").alias("count"))
    founders = metrics.founder_weights(V.counts(s, d)).select(F.concat(F.lit("F"), F.col("founder").cast("string")).alias("name"), "founder", "reads")
    reads.write_reads(laid, founders, at)
    return at


@query(Q.REGISTRY["collapse_sites"][1])
def reads_file(s, d):
    rows = reads.read_reads(s, _reads_file(s, d), strict=True)
    return rows.select("contig", "pos", F.array_join(F.transform("gamete_set", lambda x: x.cast("string")), ",").alias("members"), F.col("count").cast("long").alias("n"))


@query(with_views("SELECT 'F' || CAST(founder AS VARCHAR) AS name, founder, CAST(sum(n) AS BIGINT) AS reads, round(sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM reads), 6) AS weight FROM counts GROUP BY founder", "counts"))
def founders_file(s, d):
    return reads.read_founders(s, _reads_file(s, d)).select("name", "founder", "reads", F.round("weight", 6).alias("weight"))


@query(with_views('SELECT chrom, start, "end", CAST(parent1 AS VARCHAR) AS parent1, CAST(parent2 AS VARCHAR) AS parent2 FROM bed', "bed"))
def bed_file(s, d):
    at = _file(s, "bed")
    bed.write_bed(V.bed(s, d), at, ["chrom", "start", "end", "parent1", "parent2"], ["chrom", "start"])
    return bed.read_paths(s, at).select("chrom", "start", "end", "parent1", "parent2")


@query(with_views("SELECT chrom, CAST(length AS BIGINT) AS length FROM lengths", "lengths"))
def lengths_file(s, d):
    at = _file(s, "lengths")
    write_lines(V.lengths(s, d).select("chrom", F.concat_ws("\t", "chrom", F.col("length").cast("string"), F.lit("0")).alias("line")), at, ["chrom"])
    return bed.read_lengths(s, at, chromosomes_only=True).select("chrom", "length")


@query(with_views("SELECT DISTINCT chrom, start // 100 * 100 AS start, start // 100 * 100 + 100 AS \"end\", CAST(parent AS VARCHAR) AS founder FROM spans", "spans"))
def key_file(s, d):
    at = _file(s, "key")
    start = (F.floor(F.col("start") / 100) * 100).alias("start")
    laid = V.spans(s, d).select("chrom", start, F.col("parent")).withColumn("line", F.concat_ws("\t", "chrom", F.col("start").cast("string"), (F.col("start") + 100).cast("string"), F.col("parent").cast("string")))
    write_lines(laid, at, ["chrom", "start"])
    return bed.read_answer_key(s, at)


@query(
    """SELECT chrom, pos, ref, alt, sample, coalesce(gt, './.') AS gt FROM (SELECT DISTINCT 'chr' || CAST(o_orderkey // 2 % 3 + 1 AS VARCHAR) AS chrom, o_orderkey // 2 + 1 AS pos, 'A' AS ref, 'C' AS alt FROM orders) p
    CROSS JOIN (SELECT unnest(['s0', 's1']) AS sample) n LEFT JOIN (SELECT o_orderkey // 2 + 1 AS pos, 's' || CAST(o_orderkey % 2 AS VARCHAR) AS sample, ['0/0', '0/1', '1|1', '.'][CAST(o_custkey % 4 AS INTEGER) + 1] AS gt FROM orders) g USING (pos, sample)"""
)
def vcf_file(s, d):
    at = _file(s, "vcf")
    k = F.col("o_orderkey")
    call = F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1|1", "."))), (F.col("o_custkey") % 4 + 1).cast("int"))
    place = F.floor(k / 2)
    laid = V.table(s, d, "orders").select(F.concat(F.lit("s"), (k % 2).cast("string")).alias("sample"), V.contig(place, 3).alias("chrom"), (place + 1).alias("pos"), call.alias("gt"))
    vcf.write_vcf(laid, laid.select("chrom", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt")).distinct(), at)
    return vcf.read_vcf(s, at).select("chrom", "pos", "ref", "alt", "sample", "gt")


@query("SELECT 'c' || CAST(p_partkey AS VARCHAR) AS contig, repeat(md5(CAST(p_partkey AS VARCHAR)), 5) AS seq, substr(repeat(md5(CAST(p_partkey AS VARCHAR)), 5), 51, 40) AS part FROM part")
def fasta_file(s, d):
    at = _file(s, "fasta")
    key = F.col("p_partkey").cast("string")
    fasta.write_fasta(V.table(s, d, "part").select(F.concat(F.lit("c"), key).alias("contig"), F.repeat(F.md5(key), 5).alias("seq")), at)
    back = fasta.read_fasta(s, at)
    ranges = fasta.fetch(back, back.select("contig", F.lit(50).alias("start"), F.lit(90).alias("end")))
    return back.join(ranges.select("contig", F.col("seq").alias("part")), "contig").select("contig", "seq", "part")


@query(with_views(f"SELECT CAST(least(p1, p2) AS INTEGER) AS i, CAST(greatest(p1, p2) AS INTEGER) AS j, {Q._PAIR} AS pair FROM called GROUP BY ALL", "path", "second", more=Q._CALLED))
def pair_members(s, d):
    """The called pairs from their places."""
    pairs = Q.pair_index(s, d).select("pair")
    i, j = sites.pair_members(F.col("pair"), K)
    return pairs.select(i.alias("i"), j.alias("j"), "pair")
