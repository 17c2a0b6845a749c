"""Domain views of the driver's tables, each as a DataFrame and as a DuckDB table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.operators import islands, sites

#: Founders in the views.
K = 7

CTE = {
    "reads": """reads AS (SELECT 'chr' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS contig, l_partkey AS pos,
      list_sort(list_distinct([CAST(l_linenumber - 1 AS INTEGER), CAST(l_suppkey % 7 AS INTEGER)])) AS members, CAST(floor(l_quantity) AS BIGINT) AS n FROM lineitem)""",
    "counts": "counts AS (SELECT contig, pos, founder, CAST(sum(n) AS BIGINT) AS n FROM (SELECT contig, pos, n, unnest(members) AS founder FROM reads) GROUP BY ALL)",
    "cells": """cells AS (SELECT s.contig, s.pos, k.k AS founder, CAST(least(coalesce(c.n, 0), 127) AS INTEGER) AS x FROM (SELECT DISTINCT contig, pos FROM reads) s
      CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS k) k LEFT JOIN counts c ON c.contig = s.contig AND c.pos = s.pos AND c.founder = k.k)""",
    "path": """path AS (SELECT contig, pos, founder AS p1, CAST(row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS BIGINT) AS ord FROM (
      SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, founder) AS r FROM counts) WHERE r = 1)""",
    "second": """second AS (SELECT contig, pos, founder AS p2 FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, founder DESC) AS r FROM counts) WHERE r = 1)""",
    "bed": """bed AS (SELECT contig AS chrom, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end", p1 AS parent1, p1 AS parent2, CAST(count(*) AS BIGINT) AS n_sites FROM (
      SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN p1 <> lag(p1) OVER (PARTITION BY contig ORDER BY pos) THEN 1 ELSE 0 END + CASE WHEN lag(p1) OVER (PARTITION BY contig ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS new FROM path)) GROUP BY contig, run, p1)""",
    "spans": """spans AS (SELECT 'chr' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS chrom, o_orderkey * 3 AS start, o_orderkey * 3 + CAST(o_orderkey % 7 AS BIGINT) AS "end", o_orderkey AS ord,
      CAST(o_custkey % 7 AS INTEGER) AS parent FROM orders)""",
    "lengths": """lengths AS (SELECT chrom, max("end") + 10 AS length FROM spans WHERE chrom <> 'chr3' GROUP BY chrom)""",
    "truth": """truth AS (SELECT 'chr' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS chrom, o_orderkey // 2 AS pos, 'A' AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'C,T' ELSE 'C' END AS alt,
      CASE WHEN o_orderkey % 13 = 0 THEN 'DP=4' ELSE 'AC=' || CAST(o_orderkey % 11 AS VARCHAR) || ';AN=10' END AS info,
      ['0/0', '0/1', '1|1', './.', '1', '0/x', '1/0', '2/1'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS gt FROM orders WHERE o_orderkey % 9 <> 0)""",
    "imputed": """imputed AS (SELECT 'chr' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS chrom, o_orderkey // 2 AS pos, 'A' AS ref, 'C' AS alt, 'AC=1' AS info,
      ['0/0', '0/1', '1|1', '0/1', '1', '0/0', '.', '1/0', '1/1'][CAST((o_orderkey + o_custkey) % 9 AS INTEGER) + 1] AS gt FROM orders WHERE o_orderkey % 7 <> 0)""",
    "seq": """seq AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t FROM events)""",
}
NEEDS = {"counts": ["reads"], "cells": ["reads", "counts"], "path": ["reads", "counts"], "second": ["reads", "counts"], "bed": ["reads", "counts", "path"], "lengths": ["spans"]}


def with_views(select: str, *names: str, more: str = "") -> str:
    """A DuckDB query over named views, and over further table expressions."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [CTE[n] for n in order] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {select}" if parts else select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contig(key, n: int):
    return F.concat(F.lit("chr"), (key % n + 1).cast("string"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, pos, members, n: read support with sets of founders."""
    members = F.array_sort(F.array_distinct(F.array((F.col("l_linenumber") - 1).cast("int"), (F.col("l_suppkey") % 7).cast("int"))))
    return table(spark, sf_dir, "lineitem").select(contig(F.col("l_suppkey"), 5).alias("contig"), F.col("l_partkey").alias("pos"), members.alias("members"), F.floor("l_quantity").alias("n"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.founder_counts(reads(spark, sf_dir), ["contig", "pos"], "members", "n")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, pos, features."""
    return sites.features(reads(spark, sf_dir), ["contig", "pos"], "members", "n", K)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, pos, founder, x: features in long form."""
    return features(spark, sf_dir).select("contig", "pos", F.posexplode("features").alias("founder", "x"))


def _best(spark: SparkSession, sf_dir: str, name: str, sign: int) -> DataFrame:
    return counts(spark, sf_dir).groupBy("contig", "pos").agg(F.max_by("founder", F.struct("n", sign * F.col("founder"))).alias(name))


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, pos, ord, p1: the founder with most reads of each site, the lowest of equal ones."""
    return _best(spark, sf_dir, "p1", -1).withColumn("ord", (F.row_number().over(W.partitionBy("contig").orderBy("pos")) - 1).cast("long"))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the highest of equal ones, as another opinion."""
    return _best(spark, sf_dir, "p2", 1)


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = islands.collapse_runs(path(spark, sf_dir).withColumnRenamed("pos", "start"), ["contig"], ["start"], ["p1"])
    return runs.select(F.col("contig").alias("chrom"), "start", (F.col("end") + 1).alias("end"), F.col("p1").alias("parent1"), F.col("p1").alias("parent2"), "n_sites")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(contig(F.col("o_custkey"), 3).alias("chrom"), (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + F.col("o_orderkey") % 7).alias("end"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 7).cast("int").alias("parent"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where("chrom <> 'chr3'").groupBy("chrom").agg((F.max("end") + 10).alias("length"))


def _pick(values: list[str], at):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0"), F.col("o_orderkey")
    info = F.when(k % 13 == 0, "DP=4").otherwise(F.concat(F.lit("AC="), (k % 11).cast("string"), F.lit(";AN=10")))
    gt = _pick(["0/0", "0/1", "1|1", "./.", "1", "0/x", "1/0", "2/1"], k % 8)
    return o.select(contig(F.col("o_custkey"), 3).alias("chrom"), F.floor(k / 2).alias("pos"), F.lit("A").alias("ref"), F.when(k % 5 == 0, "C,T").otherwise("C").alias("alt"), info.alias("info"), gt.alias("gt"))


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0"), F.col("o_orderkey")
    gt = _pick(["0/0", "0/1", "1|1", "0/1", "1", "0/0", ".", "1/0", "1/1"], (k + F.col("o_custkey")) % 9)
    return o.select(contig(F.col("o_custkey"), 3).alias("chrom"), F.floor(k / 2).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit("AC=1").alias("info"), gt.alias("gt"))


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, t: events in the order of each user."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "event_type", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("t"))
