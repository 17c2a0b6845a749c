"""Functions that no query shows, and late rows of streams."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import intervals, kernels, metrics, order, sites
from haploom.sources import bed
from haploom.streaming import runs


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_scalars_by_row(spark):
    df = spark.createDataFrame([(0.0, "A:12", "chr1"), (2.0, "b:x:3", "chr2_random"), (-40.0, "c", None)], "x double, name string, contig string")
    got = values(df, scalar.sigmoid(F.col("x")), scalar.strip_suffix(F.col("name")), scalar.kept_contig(F.col("contig"), ["_random", " ", ""]))
    assert got[0] == (0.5, "A", True) and got[1][1:] == ("b:x", False) and got[2][1:] == ("c", None)
    assert got[1][0] == pytest.approx(1 / (1 + math.exp(-2))) and 0 < got[2][0] < 1e-17
    n = spark.createDataFrame([(0, 9), (9, 9), (4, 0)], "v int, most int")
    assert [round(r[0], 9) for r in values(n, scalar.log_intensity(F.col("v"), F.col("most")))] == [0.0, 1.0, 0.0]
    assert values(spark.range(3), scalar.unbin(scalar.bin_of(F.col("id") * 70, 50), 50)) == [(0,), (50,), (100,)]


def test_labels_and_cells(spark):
    labels = spark.createDataFrame([(-1,), (None,), (0,), (3,), (9,)], "l int")
    assert values(labels, sites.normalise_label(F.col("l"), 3)) == [(3,), (3,), (0,), (3,), (3,)]
    sets = spark.createDataFrame([([0, 2], 5), ([], 4), ([1], 900)], "m array<int>, n int")
    assert values(sets, sites.counted(F.col("m"), F.col("n"), 3)) == [([5, 0, 5],), ([0, 0, 0],), ([0, 127, 0],)]
    rows = spark.createDataFrame([("c", 1, [0], 2, 7, 5), ("c", 1, [1], 3, 1, None), ("c", 2, [1], 200, 2, -1), ("c", 2, [1], 1, 3, 4)], "contig string, pos int, m array<int>, n int, ord int, label int")
    assert sorted(values(sites.labelled(rows, ["contig", "pos"], "m", "n", 2, ["label"]), "pos", "features", "label")) == [(1, [2, 3], -1), (2, [0, 127], -1)]
    first = sites.collapse_sets(rows.where("label IS NOT NULL"), ["pos"], "m", "n", "label")
    assert sorted(values(first, "pos", "label")) == [(1, 5), (2, -1)]


def test_orders_and_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "i int, v int")
    assert [r.i for r in order.highlights(df, ["i"], "v", 4).collect()] == [1, 2, 4, 5]
    half = order.keep_with_probability(df, "i", F.when(F.col("v") == 0, 0.0).otherwise(0.5), 3)
    assert half.where("v = 0").count() == 0 and 60 < half.count() < 140
    assert sorted(half.collect()) == sorted(order.keep_with_probability(df.repartition(5), "i", F.when(F.col("v") == 0, 0.0).otherwise(0.5), 3).collect())


def test_intervals_and_bands(spark):
    df = spark.createDataFrame([(3, 9)], "start int, end int")
    assert values(intervals.shift(df, -2), "start", "end") == [(1, 7)]
    bands = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 6, 99)], "n int")
    assert [r[0] for r in values(bands, metrics.switch_band(F.col("n")))] == ["0", "1-2", "1-2", "3-5", "3-5", "6+", "6+"]
    trees = spark.createDataFrame([("f", 10.0, 0.5), ("f", 30.0, 0.0), ("g", 5.0, 1.0)], "f string, span double, freq double")
    assert sorted(values(metrics.span_share(trees, ["f"], "span", "freq"), "f", "present", "frequency")) == [("f", 0.25, 0.125), ("g", 1.0, 1.0)]


class Doubled:
    def predict(self, cells: np.ndarray) -> np.ndarray:
        return 2 * cells


def test_a_users_model(spark):
    df = spark.createDataFrame([("a", 2, [1, 0]), ("a", 1, [0, 3]), ("b", 1, [4, 4])], "k string, t int, features array<int>")
    got = sorted(values(kernels.predict(df, ["k"], "t", Doubled()), "k", "t", "emissions"))
    assert got == [("a", 1, [0.0, 6.0]), ("a", 2, [2.0, 0.0]), ("b", 1, [8.0, 8.0])]


def test_bed_rules_and_names(spark, tmp_path):
    at = tmp_path / "s1_chr1_imputed.bed"
    at.write_text("chrom\tstart\tend\tparent1\tparent2\nchr1\t1\t5\ta\tb\nchr1\t6\t9\tc\n")
    assert bed.read_bed(spark, str(at)).count() == 2 and [r.start for r in bed.read_bed(spark, str(at), fields=5).collect()] == [1]
    rows = spark.createDataFrame([("s 1", "chr1", 5, 9, "x"), ("s 1", "chr1", 1, 4, "y"), ("s2", "chr=2", 1, 2, None)], "sample string, chrom string, start int, end int, p string")
    out = tmp_path / "out"
    assert bed.write_bed_files(rows, str(out), ["chrom", "start", "end", "p"], ["start"]) == ["s 1_chr1_imputed.bed", "s2_chr=2_imputed.bed"]
    assert (out / "s 1_chr1_imputed.bed").read_text() == "chrom\tstart\tend\tp\nchr1\t1\t4\ty\nchr1\t5\t9\tx\n"
    assert not [p for p in out.iterdir() if p.name.startswith("__name")]


def test_late_rows_are_dropped_on_streams(spark, tmp_path):
    """The watermark of one batch holds in the next: rows behind it are lost, rows within it are counted."""
    source, state, sink = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    source.mkdir()

    def run(*rows):
        (source / f"{len(list(source.iterdir()))}.json").write_text("".join(f'{{"ts": "2024-01-01T{t}:00Z", "event_type": "a", "value": {v}}}\n' for t, v in rows))
        events = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(source))
        q = runs.windowed_counts(events, "1 hour", "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(sink)).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run(("01:05", 1.0), ("03:30", 2.0))  # watermark 03:20: the first hour is closed
    run(("01:10", 9.0), ("03:25", 4.0), ("03:05", 8.0), ("05:30", 1.0))  # 01:10 is late; the others are not
    run(("07:00", 1.0))
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(str(sink)).collect()}
    assert got == {1: (1, 1.0), 3: (3, 14.0), 5: (1, 1.0)}
