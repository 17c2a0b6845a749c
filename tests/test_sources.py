"""Files written and read again, and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haploom.operators import intervals, metrics, sites, variants
from haploom.sources import bed, chain, fasta, npy, reads, text, vcf
from haploom.streaming import runs

READS = """#version=2.0
#Command: made up
#TotalUniqueCounts: 4
#gamete\tgameteIndex\tcount
#B:0\t0\t4
#C:0\t1\t2
#W:0\t2\t1
gameteSet\trefContig\trefPosBinned\tcount
0\tchr1\t1000\t1
0,1\tchr1\t1000\t1

0,zz\tchr1\t2000\t1
bad row
0,1,2\tchr1\t2000\tx
0,1,2\tchr1\t2000\t1
"""


def test_reads(spark, tmp_path):
    (tmp_path / "s.txt").write_text(READS)
    rows = reads.read_reads(spark, str(tmp_path / "s.txt"))
    assert [(r.gamete_set, r.pos, r["count"]) for r in rows.orderBy("ord").collect()] == [([0], 1000, 1), ([0, 1], 1000, 1), ([0], 2000, 1), ([0, 1, 2], 2000, 1)]
    founders = reads.read_founders(spark, str(tmp_path / "s.txt"))
    assert sorted((r.name, r.founder, r.weight) for r in founders.collect()) == [("B", 0, 1.0), ("C", 1, 0.5), ("W", 2, 0.25)]
    meta = reads.read_metadata(spark, str(tmp_path / "s.txt")).first()
    assert (meta.version, meta.command, meta.total_unique_counts, meta.sample) == ("2.0", "made up", 4, "s")
    assert reads.missing_founders(founders.where("founder <> 1")).first().founder == 1 and reads.preview(rows, 2).count() == 2
    collapsed = sites.collapse_sets(rows, ["contig", "pos"], "gamete_set", "count")
    reads.write_reads(collapsed, founders, str(tmp_path / "out"))
    again = reads.read_reads(spark, str(tmp_path / "out"), strict=True)
    assert sorted((r.pos, r.gamete_set, r["count"]) for r in again.collect()) == [(1000, [0, 1], 2), (2000, [0, 1, 2], 2)]
    assert metrics.reads_summary(again).first().n_pos == 2


def test_bed(spark, tmp_path):
    (tmp_path / "s1_chr1_imputed.bed").write_text("chrom\tstart\tend\tparent1\nchr1\t0\t10\tA\n#x\ntrack y\nchr1\t10\t20\tB\tC\n")
    (tmp_path / "s1_chr2_imputed.bed").write_text("chr2\t0\t5\tA\n")
    (tmp_path / "s2.bed").write_text("chr1\t0\t7\tA\tB\n")
    got = bed.read_paths(spark, str(tmp_path / "*.bed"))
    assert sorted((r["sample"], r.chrom, r.end, r.parent2) for r in got.collect()) == [("s1", "chr1", 10, "A"), ("s1", "chr1", 20, "C"), ("s1", "chr2", 5, "A"), ("s2", "chr1", 7, "B")]
    bed.write_bed(got.where("sample = 's1'"), str(tmp_path / "one"), ["chrom", "start", "end", "parent1", "parent2"], ["chrom", "start"], single=True)
    assert bed.read_bed(spark, str(tmp_path / "one")).count() == 3
    bed.write_bed_by_sample(got.drop("path"), str(tmp_path / "many"))
    assert {p.name for p in (tmp_path / "many").iterdir() if p.is_dir()} == {"sample=s1", "sample=s2"}
    (tmp_path / "r.fai").write_text("chr1\t100\t0\nscaf_1\t9\t0\n")
    assert bed.read_lengths(spark, str(tmp_path / "r.fai"), True).count() == 1
    (tmp_path / "k.tsv").write_text("a\tb\tchr1\t0\t5\tF1\na\tb\tchr1\t0\t5\tF1\n")
    assert [tuple(r) for r in bed.read_answer_key(spark, str(tmp_path / "k.tsv"), 1).collect()] == [("chr1", 0, 5, "F1")]
    (tmp_path / "samples.tsv").write_text("s1\tA\ns2\tA\tB\n")
    known = bed.read_samples(spark, str(tmp_path / "samples.tsv"))
    assert bed.require(spark.createDataFrame([("s2",)], "sample string"), known, "sample").first().second == "B"
    with pytest.raises(Exception, match="no entry"):
        bed.require(spark.createDataFrame([("s9",)], "sample string"), known, "sample").collect()


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t5\t.\tA\tC\t.\tPASS\tAC=1;AN=4\tDP:GT\t3:0/1\t2:./.\nchr2\t9\t.\tG\tT\t.\tPASS\tAC=2\tGT\t1/1\t0/0\n"
    (tmp_path / "a.vcf").write_text(text)
    rows = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert sorted((r["sample"], r.pos, r.gt) for r in rows.collect()) == [("S1", 5, "0/1"), ("S1", 9, "1/1"), ("S2", 5, "./."), ("S2", 9, "0/0")]
    assert vcf.read_vcf(spark, str(tmp_path / "a.vcf"), ["S1"], ("chr1", 1, 6)).count() == 1
    vcf.write_vcf(rows.select("sample", "chrom", "pos", "gt"), rows.select("chrom", "pos", "ref", "alt").distinct(), str(tmp_path / "out"))
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert sorted((r["sample"], r.pos, r.gt) for r in again.collect()) == sorted((r["sample"], r.pos, r.gt) for r in rows.collect())
    compared = variants.compare(rows.where("sample = 'S1'"), rows.where("sample = 'S2'"))
    vcf.write_sites(compared, str(tmp_path / "sites"), "mismatches")
    assert spark.read.text(str(tmp_path / "sites")).count() == 2
    g = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tL\n1\t1\t.\tA\t<NON_REF>\t.\t.\tEND=4\tGT\t0\n1\t6\t.\tC\tT,<NON_REF>\t.\t.\t.\tGT\t1\n"
    (tmp_path / "l.vcf").write_text(g)
    assert [(r.start, r.end, r.is_ref, r.alt) for r in vcf.read_blocks(spark, str(tmp_path / "l.vcf")).orderBy("start").collect()] == [(1, 4, True, None), (6, 6, False, "T")]


def test_fasta_and_npy(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">1 first\nACGT\nAC\n>2\n" + "G" * 130 + "\n")
    got = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.contig: len(r.seq) for r in got.collect()} == {"1": 6, "2": 130}
    assert fasta.fetch(got, spark.createDataFrame([("1", 2, 5)], "contig string, start long, end long")).first().seq == "GTA"
    fasta.write_fasta(got, str(tmp_path / "out"))
    assert sorted(r.seq for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(r.seq for r in got.collect())
    np.save(tmp_path / "s_chr1.npy", np.array([[1, 0, 2], [0, 1, 1]], dtype=np.int8))
    rows = npy.read_npy(spark, str(tmp_path / "*.npy"))
    assert [r["values"] for r in rows.orderBy("ord").collect()] == [[1, 0, 2], [0, 1, 1]]
    assert {(r["sample"], r.contig) for r in npy.tag_files(rows).collect()} == {("s", "chr1")}
    assert [r.labels for r in npy.split_overlay(rows, 2).orderBy("ord").collect()] == [[2], [1]]
    back = npy.to_npy(npy.split_overlay(rows, 2).withColumn("k", F.lit("x")), ["k"], "ord").first()
    import io

    assert np.load(io.BytesIO(back.content)).tolist() == [[1, 0], [0, 1]]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(READS)
    q = runs.stream_reads(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("reads_in").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("reads_in").count() == 4
    for n, rows in enumerate(([("u", 0, "a"), ("u", 1, "a"), ("u", 2, "b"), ("v", 0, "c")], [("u", 3, "b"), ("u", 4, "a"), ("v", 1, "d")])):
        pd.DataFrame(rows, columns=["user", "t", "kind"]).to_parquet(tmp_path / f"e{n}.parquet")
    src = tmp_path / "ev"
    src.mkdir()
    q = runs.collapse_stream(spark.readStream.schema("user string, t long, kind string").parquet(str(src)), "user", "t", "kind").writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    for n in range(2):
        (tmp_path / f"e{n}.parquet").rename(src / f"e{n}.parquet")
        q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("runs_out").collect())) == [("u", 0, 1, "a", 2), ("u", 2, 3, "b", 2), ("v", 0, 0, "c", 1)]


def test_streams_close_idle_runs_and_refuse_disorder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    at = lambda minute: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)
    batches = ([("u", 0, "a", at(0)), ("u", 1, "a", at(1)), ("v", 0, "c", at(1))], [("w", 0, "x", at(90))], [("w", 1, "x", at(91))])
    for n, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["user", "t", "kind", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"e{n}.parquet")
    frame = spark.readStream.schema("user string, t long, kind string, ts timestamp").parquet(str(src))
    q = runs.collapse_stream(frame, "user", "t", "kind", ts="ts").writeStream.format("memory").queryName("idle_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for n in range(3):
        (tmp_path / f"e{n}.parquet").rename(src / f"e{n}.parquet")
        q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("idle_out").collect())) == [("u", 0, 1, "a", 2), ("v", 0, 0, "c", 1)]
    q = runs.collapse_stream(frame.drop("ts"), "user", "t", "kind").writeStream.format("memory").queryName("bad_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    pd.DataFrame([("u", 1, "b", at(200))], columns=["user", "t", "kind", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(src / "late.parquet")
    with pytest.raises(Exception, match="comes after"):
        q.processAllAvailable()


CHAIN = """chain 900 chr1 1000 + 10 60 ctgA 500 + 100 155 1
20 5 10
25

chain 50 chr2 300 + 0 30 ctgB 200 - 20 50 2
10 0 0
20

"""


def test_chains_lift_points(spark, tmp_path):
    (tmp_path / "x.chain").write_text(CHAIN)
    blocks = chain.read_chain(spark, str(tmp_path / "x.chain"))
    got = sorted((r.chrom, r.start, r.end, r.target, r.target_start, r.strand) for r in blocks.collect())
    assert got == [("chr1", 10, 30, "ctgA", 100, "+"), ("chr1", 35, 60, "ctgA", 130, "+"), ("chr2", 0, 10, "ctgB", 170, "-"), ("chr2", 10, 30, "ctgB", 150, "-")]
    points = spark.createDataFrame([("chr1", 10), ("chr1", 29), ("chr1", 32), ("chr1", 35), ("chr2", 0), ("chr2", 29)], "chrom string, pos long")
    lifted = {(r.chrom, r.pos): r.target_pos for r in intervals.lift_over(points, blocks, ["chrom"], "pos", 16).collect()}
    assert lifted == {("chr1", 10): 100, ("chr1", 29): 119, ("chr1", 35): 130, ("chr2", 0): 179, ("chr2", 29): 150}


def test_predictions_in_contig_order_and_logs(spark, tmp_path):
    rows = [("s", "chr2", i) for i in range(2)] + [("s", "chr10", i) for i in range(3)] + [("s", "chr9", 0)]
    placed = npy.in_contig_order(spark.createDataFrame(rows, "sample string, contig string, ord long"), ["chr10", "chr2"])
    assert sorted((r.place, r.contig, r.ord) for r in placed.collect()) == [(0, "chr10", 0), (1, "chr10", 1), (2, "chr10", 2), (3, "chr2", 0), (4, "chr2", 1)]
    for n in range(2):
        text.append_rows(spark.createDataFrame([(n, "x")], "run int, note string"), str(tmp_path / "log"))
    assert sorted(r.run for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "log")).collect()) == ["0", "1"]
