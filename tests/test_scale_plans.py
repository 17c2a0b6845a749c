"""Steps that used to meet in one task, or to compute a value over and over: what they give, and that they no longer do so."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import chunked, intervals
from haploom.plans.queries import REGISTRY
from haploom.sources import fasta, vcf
from haploom.sources.text import write_lines

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regions_are_numbered_by_ranges(spark):
    rows = [("c", 5, 1, 2, 2), ("c", 5, 0, 1, None), ("c", 1, 2, 3, 4), ("d", 1, 3, None, None)]
    df = spark.createDataFrame(rows, "chrom string, start long, ord long, parent1 int, parent2 int")
    got = intervals.region_codes(df)
    assert "row_number" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("c", 0, 3, 1), ("c", 0, 4, 2), ("c", 1, 1, 1), ("c", 2, 2, 3)]


def test_contigs_are_joined_once_each(spark):
    for name, kind in (("anti_missing_contigs", "LeftAnti"), ("semi_covered_contigs", "LeftSemi")):
        join = next(x for x in plan(REGISTRY[name][0](spark, DATA)).splitlines() if f"Join {kind}" in x)
        assert "rightHint=(strategy=broadcast)" in join


def test_an_array_is_encoded_once_for_all_its_elements(spark):
    cells = F.transform("x", lambda x: x * 3)
    df = spark.createDataFrame([([1, -2, 3],), ([],)], "x array<long>")
    got = df.select(scalar.decode_array(scalar.encode_array(cells, "int64"), "int64")["values"].alias("v"))
    assert plan(got).count("unhex(") == 1 and [r.v for r in got.collect()] == [[3, -6, 9], []]
    matrix = df.select(scalar.decode_matrix(scalar.encode_array(cells, "int16"), F.lit(3), F.lit(1), "int16").alias("m"))
    assert plan(matrix).count("unhex(") == 1 and [r.m["values"] for r in matrix.collect()] == [[[3], [-6], [9]], None]


def test_records_do_not_meet_at_their_header(spark, tmp_path):
    laid = spark.createDataFrame([("s", "c", i, "0/1") for i in range(5)], "sample string, chrom string, pos long, gt string")
    vcf.write_vcf(laid, laid.select("chrom", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt")), str(tmp_path / "v"))
    assert "broadcast" in plan(vcf.read_vcf(spark, str(tmp_path / "v")))


def test_a_record_goes_on_in_the_next_part(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"c{i}": "".join(rng.choice("acgt") for _ in range(n)) for i, n in enumerate((700, 60, 1))}
    store = chunked.cut(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fasta.write_chunks(store, str(tmp_path / "f"))
        lines = [(c, t, seqs[c][t : t + 50]) for c in seqs for t in range(0, len(seqs[c]), 50)] + [(c, -1, f">{c} made") for c in seqs]
        write_lines(spark.createDataFrame(lines, "contig string, t int, line string"), str(tmp_path / "g"), ["contig", "t"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in "fg":
        assert len(list((tmp_path / name).glob("part-*"))) > 1
        got = fasta.read_chunks(spark, str(tmp_path / name), 60).collect()
        assert {c: "".join(r.bases for r in sorted(got, key=lambda r: r.chunk) if r.contig == c) for c in seqs} == seqs
        assert {r.path.rsplit("/", 1)[1] for r in got} == {name}
