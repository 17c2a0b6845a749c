"""Queries on chunked sequences, ordinals by ranges, version order, region matrices and encoded arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import chunked, intervals, metrics, order, sequences, sites
from haploom.plans import views as V
from haploom.plans.more_queries import _file
from haploom.plans.queries import query, wide
from haploom.plans.views import K, with_views
from haploom.sources import bed, fasta
from haploom.sources.text import write_lines

#: Bases of a chunk in these queries: small, so that the small tables have many.
SIZE = 960
#: Each contig's sequence is the digests of its orders, one line each, by key.
_SEQ = "seqs AS (SELECT 'chr' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS contig, string_agg(md5(CAST(o_orderkey AS VARCHAR)), '' ORDER BY o_orderkey) AS seq FROM orders GROUP BY 1)"
_CHUNK = f"substr(seq, CAST(chunk * {SIZE} + 1 AS BIGINT), {SIZE})"
_EVERY = f"(SELECT *, unnest(range((length(seq) + {SIZE - 1}) // {SIZE})) AS chunk FROM {{}})"


def _fasta(s, d) -> str:
    """The sequences as a file."""
    at = _file(s, "sequences")
    o = V.table(s, d, "orders").select(V.contig(F.col("o_orderkey"), 3).alias("contig"), F.col("o_orderkey").alias("k"))
    body = o.select("contig", F.lit(1).alias("part"), "k", F.md5(F.col("k").cast("string")).alias("line"))
    heads = o.select("contig").distinct().select("contig", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("> "), "contig", F.lit(" made")).alias("line"))
    write_lines(body.unionByName(heads), at, ["contig", "part", "k"])
    return at


def _store(s, d):
    return fasta.read_chunks(s, _fasta(s, d), SIZE).select("contig", "chunk", "bases")


@query(f"WITH {_SEQ} SELECT contig, chunk, {_CHUNK} AS bases FROM {_EVERY.format('seqs')}")
def fasta_chunks(s, d):
    return _store(s, d)


@query(f"WITH {_SEQ} SELECT contig, chunk, {_CHUNK} AS bases FROM {_EVERY.format('seqs')}")
def fasta_chunks_written(s, d):
    """Written in lines of 60 and read again."""
    at = _file(s, "wrapped")
    fasta.write_chunks(_store(s, d), at)
    return fasta.read_chunks(s, at, SIZE).select("contig", "chunk", "bases")


_RANGES = f"ranges AS (SELECT c_custkey AS name, 'chr' || CAST(c_custkey % 4 + 1 AS VARCHAR) AS contig, c_custkey * 131 % 15000 AS start, c_custkey * 131 % 15000 + c_custkey % 3 * {SIZE} + c_custkey % 50 AS \"end\" FROM customer)"


@query(f"WITH {_SEQ}, {_RANGES} SELECT name, r.contig, start, \"end\", coalesce(substr(seq, CAST(start + 1 AS BIGINT), CAST(\"end\" - start AS BIGINT)), '') AS seq FROM ranges r LEFT JOIN seqs q ON q.contig = r.contig")
def chunk_fetch(s, d):
    """Ranges that meet up to four chunks, some empty, some beyond a contig's end, some of no contig."""
    k = F.col("c_custkey")
    start = k * 131 % 15000
    ranges = V.table(s, d, "customer").select(k.alias("name"), V.contig(k, 4).alias("contig"), start.alias("start"), (start + k % 3 * SIZE + k % 50).alias("end"))
    return chunked.fetch(ranges, _store(s, d), ["name", "contig", "start", "end"], SIZE)


@query(
    f"""WITH {_SEQ}, made AS (SELECT c_nationkey AS sample, string_agg(substr(seq, CAST(c_custkey * 37 % 3000 + 1 AS BIGINT), CAST(c_custkey % 1500 AS BIGINT)), '' ORDER BY c_custkey) AS seq
      FROM customer JOIN seqs ON contig = 'chr' || CAST(c_custkey % 3 + 1 AS VARCHAR) GROUP BY 1) SELECT sample, chunk, {_CHUNK} AS bases FROM {_EVERY.format('made')}"""
)
def chunk_assemble(s, d):
    """Recombinants of many pieces."""
    k = F.col("c_custkey")
    pieces = V.table(s, d, "customer").select(F.col("c_nationkey").alias("sample"), k.alias("ord"), V.contig(k, 3).alias("contig"), (k * 37 % 3000).alias("start"), (k * 37 % 3000 + k % 1500).alias("end"))
    return chunked.assemble(pieces, _store(s, d), ["sample"], size=SIZE)


_BLOCKS = """blocks AS (SELECT 'chr' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS contig, o_orderkey * 2 + 1 AS start, o_orderkey * 2 + 1 + CAST(o_orderkey % 4 = 1 AS INTEGER) AS "end",
  CASE o_orderkey % 5 WHEN 0 THEN '.' WHEN 1 THEN 'ACGT' WHEN 2 THEN 'T' END AS alt FROM orders WHERE o_orderkey % 3 <> 2 AND o_custkey % 4 <> 0)"""


def _filled(gap: str, no_call: str) -> str:
    take = lambda a, b: f"substr(seq, CAST({a} + 1 AS BIGINT), CAST(greatest({b} - ({a}), 0) AS BIGINT))"
    piece = {"N": lambda a, b: f"repeat('N', CAST(greatest({b} - ({a}), 0) AS BIGINT))", "ref": take, "none": lambda a, b: "''"}
    return f"""WITH {_SEQ}, {_BLOCKS}, laid AS (SELECT contig, start, "end", alt, seq, coalesce(lag("end") OVER w, 0) AS before, lead(start) OVER w IS NULL AS last FROM blocks JOIN seqs USING (contig) WINDOW w AS (PARTITION BY contig ORDER BY start)),
      made AS (SELECT contig, string_agg(concat({piece[gap]('before', 'start - 1')}, CASE WHEN alt IS NULL THEN {take('start - 1', '"end"')} WHEN alt = '.' THEN {piece[no_call]('start - 1', '"end"')} ELSE alt END,
        CASE WHEN last THEN {piece[gap]('"end"', 'length(seq)')} ELSE '' END), '' ORDER BY start) AS seq FROM laid GROUP BY contig UNION ALL SELECT contig, seq FROM seqs WHERE contig NOT IN (SELECT contig FROM blocks))
      SELECT contig, chunk, {_CHUNK} AS bases FROM {_EVERY.format('made')}"""


def _sample_blocks(s, d):
    k = F.col("o_orderkey")
    o = V.table(s, d, "orders").where("o_orderkey % 3 <> 2 AND o_custkey % 4 <> 0")
    alt = F.when(k % 5 == 0, ".").when(k % 5 == 1, "ACGT").when(k % 5 == 2, "T")
    return o.select(V.contig(k, 3).alias("contig"), (k * 2 + 1).alias("start"), (k * 2 + 1 + (k % 4 == 1).cast("int")).alias("end"), alt.alias("alt"))


@query(_filled("N", "N"))
def chunk_fill(s, d):
    return chunked.fill(_sample_blocks(s, d), _store(s, d), size=SIZE)


@query(_filled("ref", "none"))
def chunk_fill_reference(s, d):
    return chunked.fill(_sample_blocks(s, d), _store(s, d), "ref", "none", SIZE)


@query("SELECT p_brand AS name, first.k AS p_partkey, CAST(row_number() OVER (ORDER BY first.k) - 1 AS BIGINT) AS place FROM (SELECT p_brand, min({'k': p_partkey}) AS first FROM part GROUP BY p_brand)")
def distinct_in_order(s, d):
    """Brands in the order of their first part."""
    return order.distinct_in_order(V.table(s, d, "part").withColumnRenamed("p_brand", "name"), "name", ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS ord, CAST(coalesce(sum(floor(l_quantity)) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lineitem")
def global_ordinals(s, d):
    """Numbers over the whole table, and running sums within three large keys."""
    rows = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    placed = order.numbered(rows, ["l_shipdate", *key])
    return order.running_sum(placed, key, F.floor("l_quantity"), ["l_returnflag"]).select("l_orderkey", "l_linenumber", "ord", "before")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS places, CAST(count(*) - 1 AS BIGINT) AS last, true AS shuffled, true AS again FROM orders")
def seeded_shuffle(s, d):
    """Each order has one place; the places are those of another run with the same seed, and not in order of keys."""
    o = V.table(s, d, "orders").select("o_orderkey")
    one, two = order.shuffled(o, "o_orderkey", 5), order.shuffled(o.repartition(3), "o_orderkey", 5).withColumnRenamed("place", "other")
    both = one.join(two, "o_orderkey")
    spread = F.abs(F.corr("o_orderkey", "place")) < 0.2
    return both.agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), spread.alias("shuffled"), F.bool_and(F.col("place") == F.col("other")).alias("again"))


@query("SELECT 'chr' || CAST(a AS VARCHAR) || '.' || lpad(CAST(b AS VARCHAR), 3, '0') || 'v' || CAST(c AS VARCHAR) AS name, CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT o_custkey % 23 AS a, o_orderkey % 17 AS b, o_orderkey % 101 AS c FROM orders)")
def version_order(s, d):
    """Names with three numbers each, one of them with zeros before it."""
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("chr"), F.col("o_custkey") % 23, F.lit("."), F.lpad((k % 17).cast("string"), 3, "0"), F.lit("v"), k % 101)
    names = o.select(name.alias("name")).distinct()
    return order.numbered(names.withColumn("key", order.version_key(F.col("name"))), ["key", "name"], name="place").select("name", "place")


_CELLS = """placed AS (SELECT chrom, start, "end", row_number() OVER (PARTITION BY chrom ORDER BY start, ord) - 1 AS r, parent AS p1, CAST(ord // 3 % 7 AS INTEGER) AS p2 FROM spans),
  parents AS (SELECT chrom, p, row_number() OVER (PARTITION BY chrom ORDER BY p) - 1 AS n FROM (SELECT chrom, p1 AS p FROM placed UNION SELECT chrom, p2 FROM placed)),
  told AS (SELECT s.chrom, r, start, "end", a.n AS n1, b.n AS n2 FROM placed s JOIN parents a ON a.chrom = s.chrom AND a.p = p1 JOIN parents b ON b.chrom = s.chrom AND b.p = p2)"""


def _spans(s, d):
    return V.spans(s, d).withColumn("parent1", F.concat(F.lit("p"), F.col("parent"))).withColumn("parent2", F.concat(F.lit("p"), (F.floor(F.col("ord") / 3) % 7).cast("int")))


@query(with_views('SELECT chrom, r AS region, start, "end", CAST(n AS INTEGER) AS parent, CAST(sum(code) AS INTEGER) AS code FROM (SELECT chrom, r, start, "end", n1 AS n, 1 AS code FROM told UNION ALL SELECT chrom, r, start, "end", n2, 2 FROM told) GROUP BY ALL', "spans", more=_CELLS))
def region_matrix(s, d):
    """The filled cells, read back from compressed rows."""
    matrix, _ = intervals.region_matrix(_spans(s, d), block=100)
    rows = matrix.select("chrom", "block", "offsets", "parents", "codes", F.posexplode("regions").alias("at", "x"))
    own = lambda c: F.slice(c, F.get("offsets", F.col("at")) + 1, F.get("offsets", F.col("at") + 1) - F.get("offsets", F.col("at")))
    cells = rows.select("chrom", (F.col("block") * 100 + F.col("at")).alias("region"), "x.start", "x.end", F.explode(F.arrays_zip(own("parents").alias("parent"), own("codes").alias("code"))).alias("c"))
    return cells.select("chrom", "region", "start", "end", "c.parent", "c.code")


@query(with_views("SELECT chrom, r // 100 AS block, string_agg(CAST(n1 AS VARCHAR), ',' ORDER BY r) AS parent1, string_agg(CAST(n2 AS VARCHAR), ',' ORDER BY r) AS parent2 FROM told GROUP BY ALL", "spans", more=_CELLS))
def region_paths(s, d):
    """Each parent's path along the regions."""
    _, paths = intervals.region_matrix(_spans(s, d), block=100)
    return paths.select("chrom", "block", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("parent1", "parent2")))


@query(with_views("SELECT p.contig, p.pos, p1, p2 FROM path p JOIN second s ON s.contig = p.contig AND s.pos = p.pos", "path", "second"))
def checked_zip(s, d):
    """Two opinions of the same sites, joined by place after their counts agree."""
    return order.checked_zip(V.path(s, d).select("contig", "pos", "p1"), V.second(s, d).select(F.col("contig"), F.col("pos").alias("pos2"), "p2"), ["contig"], ["pos"], ["pos2"]).select("contig", "pos", "p1", "p2")


_RECORDS = """records AS (SELECT 'chr' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS contig, o_orderkey * 10 AS start, o_orderkey * 10 + o_orderkey % 10 AS "end", o_custkey % 5 < 3 AS is_ref FROM orders),
  ordered AS (SELECT *, coalesce(sum(CAST(is_ref AND "end" - start + 1 >= 6 AS INTEGER)) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM records),
  draws AS (SELECT *, NOT is_ref AND row_number() OVER (PARTITION BY contig, seen, is_ref ORDER BY start) = 1 AS drawn FROM ordered),
  blocks AS (SELECT *, CAST(sum(CAST(drawn AS INTEGER)) OVER (PARTITION BY contig ORDER BY start) AS BIGINT) AS block FROM draws)"""


def _marked(s, d, rate: float = 0.5):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    records = o.select(V.contig(F.col("o_custkey"), 3).alias("contig"), (k * 10).alias("start"), (k * 10 + k % 10).alias("end"), (F.col("o_custkey") % 5 < 3).alias("is_ref"))
    return sequences.marked_blocks(records, rate, 6, 11)


@query(f"WITH {_RECORDS} SELECT contig, start, block, drawn FROM blocks")
def gvcf_blocks(s, d):
    """Which records share a draw."""
    return _marked(s, d).select("contig", "start", "block", "drawn")


@query(f"WITH {_RECORDS} SELECT contig, min(start) FILTER (drawn) AS start, min(start) FILTER (drawn) AS size, 'query' AS id FROM blocks GROUP BY contig")
def gvcf_block_sizes(s, d):
    """Nothing is kept once a draw is made, so each contig has one change, at its first draw."""
    return sequences.block_sizes(_marked(s, d, 0.0))


@query(f"WITH {_RECORDS} SELECT contig, count(*) AS records, count(*) FILTER (is_ref) AS refs, true AS whole, true AS told FROM blocks GROUP BY contig")
def gvcf_kept(s, d):
    """With half of the blocks kept: all reference records stay, blocks are kept or dropped whole, and the table of sizes adds
    up to the places of its changes, which kept and dropped blocks take in turn."""
    marked = _marked(s, d)
    counts = marked.groupBy("contig").agg(F.count("*").alias("records"), F.count_if(F.col("is_ref")).alias("refs"))
    whole = marked.groupBy("contig", "block").agg(F.count_distinct("kept").alias("n"), F.count_if(F.expr("is_ref OR kept")).alias("stay")).groupBy("contig").agg((F.max("n") == 1).alias("whole"), F.sum("stay").alias("stay"))
    sizes = sequences.block_sizes(marked).groupBy("contig").agg(F.sum("size").alias("total"), F.max("start").alias("last"), F.abs(F.count_if(F.expr("id = 'ref'")) - F.count_if(F.expr("id = 'query'"))).alias("odd"))
    kept = sequences.kept_records(marked).groupBy("contig").agg(F.count("*").alias("kept"))
    both = counts.join(whole, "contig").join(sizes, "contig").join(kept, "contig")
    return both.select("contig", "records", "refs", (F.col("whole") & (F.col("kept") == F.col("stay"))).alias("whole"), ((F.col("total") == F.col("last")) & (F.col("odd") <= 1)).alias("told"))


_LOW = "printf('%02x%02x%02x%02x', x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255)"


@query(with_views(f"SELECT contig, pos, to_base64(unhex(string_agg({_LOW}, '' ORDER BY founder))) AS data FROM (SELECT contig, pos, founder, CAST(x AS BIGINT) * pos * 1000003 % 4294967296 AS x FROM cells) GROUP BY contig, pos", "cells"))
def encoded_arrays(s, d):
    """Cells, scaled to fill their 32 bits, as base64."""
    cells = F.transform("features", lambda x: x.cast("long") * F.col("pos") * 1000003 % (1 << 32))
    return V.features(s, d).select("contig", "pos", scalar.encode_array(cells, "uint32").alias("data"))


@query(with_views(f"SELECT contig, pos, {', '.join(f'CAST(max(CASE WHEN founder = {i} THEN x * x * 65537 * CASE WHEN founder % 2 = 0 THEN 1 ELSE -1 END END) AS BIGINT) AS f{i}' for i in range(K))} FROM cells GROUP BY contig, pos", "cells"))
def decoded_arrays(s, d):
    """Signed 64-bit cells there and back."""
    cells = F.transform("features", lambda x, i: x.cast("long") * x * 65537 * F.when(i % 2 == 0, 1).otherwise(-1))
    return wide(V.features(s, d).withColumn("features", scalar.decode_array(scalar.encode_array(cells, "int64"), "int64")["values"]), "contig", "pos")


@query(with_views(f"SELECT contig, pos, list_transform(list(x ORDER BY founder), lambda x: CAST(x AS BIGINT))[1:6] AS flat FROM cells GROUP BY contig, pos", "cells").replace("SELECT contig, pos, list_transform", "SELECT contig, pos, array_to_string(list_transform").replace("[1:6] AS flat", "[1:6], ',') AS flat, 'wrong size' AS reason"))
def decoded_matrices(s, d):
    """A 2 x 3 matrix of the first six cells, and why all seven are none."""
    f = V.features(s, d)
    six = scalar.decode_matrix(scalar.encode_array(F.slice("features", 1, 6), "int16"), F.lit(2), F.lit(3), "int16")
    seven = scalar.decode_matrix(scalar.encode_array(F.col("features"), "int16"), F.lit(2), F.lit(3), "int16")
    return f.select("contig", "pos", F.array_join(F.flatten(six["values"]).cast("array<string>"), ",").alias("flat"), seven["reason"].alias("reason"))


@query(
    with_views(
        f"""SELECT contig, pos, CAST(max(CASE WHEN r = 1 THEN i END) AS INTEGER) AS i, CAST(max(CASE WHEN r = 1 THEN j END) AS INTEGER) AS j, CAST(max(CASE WHEN k = 1 THEN i END) AS INTEGER) AS known_i, CAST(max(CASE WHEN k = 1 THEN j END) AS INTEGER) AS known_j FROM (
      SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY v DESC, i, j) AS r, row_number() OVER (PARTITION BY contig, pos ORDER BY CASE WHEN i < {K - 1} AND j < {K - 1} THEN 0 ELSE 1 END, v DESC, i, j) AS k FROM (
        SELECT a.contig, a.pos, a.founder AS i, b.founder AS j, a.x * b.x + (a.founder * 5 + b.founder) % 4 AS v FROM cells a JOIN cells b ON a.contig = b.contig AND a.pos = b.pos)) GROUP BY contig, pos""",
        "cells",
    )
)
def joint_argmax(s, d):
    """The likeliest pair of a score of both sides, with and without the last class."""
    at = lambda i, j: (F.lit(i * 5 + j) % 4).cast("int")
    rows = F.array(*(F.array(*(F.get("features", F.lit(i)) * F.get("features", F.lit(j)) + at(i, j) for j in range(K))) for i in range(K)))
    found = V.features(s, d).select("contig", "pos", rows.alias("m")).select("contig", "pos", order.joint_argmax(F.col("m")).alias("a"), order.joint_argmax(F.col("m"), known=True).alias("k"))
    return found.select("contig", "pos", "a.i", "a.j", F.col("k.i").alias("known_i"), F.col("k.j").alias("known_j"))


@query(
    with_views(
        f"""SELECT c.contig, c.pos, {', '.join(f'CAST(max(CASE WHEN founder = {i} THEN x END) AS BIGINT) AS f{i}' for i in range(K))}, any_value(label) AS label FROM cells c JOIN (
          SELECT contig, pos, arg_min(label, (k, n))  AS label FROM (SELECT 'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS contig, l_partkey AS pos, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE CAST(l_orderkey % 7 AS INTEGER) END AS label, l_orderkey AS k, l_linenumber AS n FROM lineitem) GROUP BY ALL) l
        ON l.contig = c.contig AND l.pos = c.pos GROUP BY c.contig, c.pos""",
        "cells",
    )
)
def labelled_counts(s, d):
    """Counts with the label of each site's first row; a third of the rows have none."""
    rows = V.table(s, d, "lineitem")
    members = F.array_sort(F.array_distinct(F.array((F.col("l_linenumber") - 1).cast("int"), (F.col("l_suppkey") % 7).cast("int"))))
    laid = rows.select(
        V.contig(F.col("l_suppkey"), 5).alias("contig"), F.col("l_partkey").alias("pos"), members.alias("members"), F.floor("l_quantity").alias("n"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_orderkey") % 7).cast("int")).alias("label"), F.struct("l_orderkey", "l_linenumber").alias("ord"),
    )
    return wide(sites.labelled(laid, ["contig", "pos"], "members", "n", K, ["label"]), "contig", "pos", "label")


@query(with_views("SELECT contig, round(avg(n), 6) AS mean, median(n) AS median, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM (SELECT contig, pos, count(*) FILTER (x > 3) AS n FROM cells GROUP BY ALL) GROUP BY contig", "cells"))
def spectrum_summary(s, d):
    """Founders with more than three reads."""
    few = V.features(s, d).withColumn("features", F.transform("features", lambda x: (x > 3).cast("int")))
    return metrics.spectrum_summary(few, ["contig"]).select("contig", F.round("mean", 6).alias("mean"), "median", F.round("zero_share", 6).alias("zero_share"))


@query(
    with_views(
        """SELECT p1 % 3 <> p2 % 3 AS true_het, count(*) AS n, round(2.0 * avg(coalesce(least(CAST(p1 <> a AS INTEGER) + CAST(p2 <> b AS INTEGER), CAST(p1 <> b AS INTEGER) + CAST(p2 <> a AS INTEGER)), 0)), 6) AS mean_cost
        FROM (SELECT p.contig, p.pos, p1, p2, lag(p1) OVER w AS a, lag(p2) OVER w AS b FROM path p JOIN second s ON s.contig = p.contig AND s.pos = p.pos WINDOW w AS (PARTITION BY p.contig ORDER BY p.pos)) GROUP BY 1""",
        "path",
        "second",
    )
)
def switch_cost_by_truth(s, d):
    both = V.path(s, d).join(V.second(s, d), ["contig", "pos"]).withColumn("h1", F.col("p1") % 3).withColumn("h2", F.col("p2") % 3)
    return metrics.switch_cost_by_truth(both, ["contig"], "pos", "h1", "h2", "p1", "p2", 2.0).withColumn("mean_cost", F.round("mean_cost", 6))


@query(with_views("SELECT 's' || CAST(ord % 3 AS VARCHAR) AS sample, chrom, start, \"end\", CAST(parent AS VARCHAR) AS parent1 FROM spans", "spans"))
def bed_files(s, d):
    """Files by sample and contig, read back by their names."""
    at = _file(s, "named")
    rows = V.spans(s, d).withColumn("sample", F.concat(F.lit("s"), F.col("ord") % 3)).withColumn("parent1", F.col("parent").cast("string"))
    bed.write_bed_files(rows, at, ["chrom", "start", "end", "parent1", "parent1"], ["start", "ord"])
    return bed.read_paths(s, at).select("sample", "chrom", "start", "end", "parent1")
