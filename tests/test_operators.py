"""Operators on small inline inputs, and recurrences against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import intervals, kernels, metrics, order, sequences, simulate, sites, variants, windows


def test_contiguous_and_adjusted(spark):
    bed = spark.createDataFrame([("c", 10, 20), ("c", 30, 40)], "chrom string, start long, end long")
    got = intervals.make_contiguous(bed, spark.createDataFrame([("c", 50)], "chrom string, length long"))
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 25), (25, 50)]
    rows = [(10, 225), (250, 312), (330, 415), (417, 534)]
    adjusted = intervals.adjust_coords(spark.createDataFrame([("c", *r) for r in rows], "chrom string, start long, end long"), spark.createDataFrame([("c", 550)], "chrom string, length long"))
    assert sorted((r.start, r.end) for r in adjusted.collect()) == [(0, 225), (225, 312), (312, 415), (415, 550)]


def test_interval_edges(spark):
    points = spark.createDataFrame([("c", p) for p in range(0, 40)], "chrom string, pos long")
    laid = spark.createDataFrame([("c", 3, 9, "a", 1), ("c", 7, 30, "b", 2), ("c", 8, 8, "z", 3), ("c", 20, 10, "never", 4)], "chrom string, low long, high long, label string, ord int")
    for closed in (True, False):
        got = {r.pos: r.label for r in intervals.label_points(points, laid, ["chrom"], "pos", "low", "high", "label", "ord", 4, closed).collect()}
        for p in range(40):
            want = [lab for lo, hi, lab in ((3, 9, "a"), (7, 30, "b"), (8, 8, "z")) if lo <= p < hi + closed]
            assert got[p] == (want[-1] if want else None)


def test_knn(spark):
    x = [[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 1, 0], [0, 0, 1]]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(x)], "contig string, site int, features array<int>")
    assert [r.p1 for r in windows.knn(df, ["contig"], ["site"], 3, 3).orderBy("site").collect()] == [0, 0, 1, 1, 2]
    first = windows.knn(df, ["contig"], ["site"], 3, 3, diploid=True).orderBy("site").first()
    assert (first.p1, first.p2) == (0, 0)
    y = [[1, 1, 0], [1, 1, 0], [0, 1, 0], [0, 1, 1], [0, 0, 1]]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(y)], "contig string, site int, features array<int>")
    het = windows.knn(df, ["contig"], ["site"], 3, 3, diploid=True, threshold=0.99).orderBy("site").collect()[2]
    hom = windows.knn(df, ["contig"], ["site"], 3, 3, diploid=True, threshold=0.49).orderBy("site").collect()[2]
    assert {het.p1, het.p2} == {1, 2} and (hom.p1, hom.p2) == (1, 1)
    with pytest.raises(ValueError):
        windows.knn(df, ["contig"], ["site"], 3, 4)


GTS = [("0/1", ["0", "1"]), ("1|0", ["1", "0"]), ("./.", None), (".", None), ("", None), (" 0/1 ", ["0", "1"]), ("./1", None), ("0/1/2", ["0", "1", "2"]), ("10/11", ["10", "11"]), ("1", ["1"]), (".|.", None), (None, None)]


def test_genotypes(spark):
    df = spark.createDataFrame([(g,) for g, _ in GTS], "gt string").coalesce(1)
    assert [r.p for r in df.select(variants.parse_gt(F.col("gt")).alias("p")).collect()] == [w for _, w in GTS]
    rows = spark.createDataFrame([("A", "T,C", "0/1/2"), ("A", "C", "1|0"), ("A", "C", "0/2"), ("A", "C", "0/x"), ("A", ".", "0/0")], "ref string, alt string, gt string").coalesce(1)
    assert [r.a for r in rows.select(variants.alleles(F.col("ref"), F.col("alt"), F.col("gt")).alias("a")).collect()] == [["A", "C", "T"], ["A", "C"], None, None, ["A", "A"]]
    assert rows.select(variants.alleles(F.col("ref"), F.col("alt"), F.col("gt"), True).alias("a")).collect()[1].a == ["C", "A"]
    score = spark.createDataFrame([(["A", "C"], ["C", "A"]), (["A", "A"], ["A", "C"]), (["A", "C", "T"], ["A"]), (["A"], ["C"])], "t array<string>, i array<string>").coalesce(1)
    assert [r.s for r in score.select(variants.allele_score(F.col("t"), F.col("i")).alias("s")).collect()] == [1.0, 0.5, 1 / 3, 0.0]
    assert score.select(variants.allele_score(F.col("t"), F.col("i"), True).alias("s")).first().s == 0.0


def test_compare_kinds(spark):
    schema = "chrom string, pos long, ref string, alt string, info string, gt string"
    t = [("c", 1, "A", "C", "AC=1;AN=2", "0/1"), ("c", 2, "A", "C", "", "./."), ("c", 3, "A", "C", "", "0/9"), ("c", 4, "A", "C", "", "0/0"), ("c", 5, "A", "C", "", "1/1"), ("c", 6, "A", "C", "", "1/1"), ("c", 6, "A", "G", "", "1/1"), ("c", 7, "A", "C", "", "./.")]
    i = [("c", 1, "A", "C", "", "1/0"), ("c", 2, "A", "C", "", "0/1"), ("c", 3, "A", "C", "", "0/0"), ("c", 4, "A", "C", "", "."), ("c", 6, "A", "C", "", "1/1"), ("c", 7, "A", "C", "", "."), ("c", 8, "A", "C", "", "0/0")]
    truth, imputed = spark.createDataFrame(t, schema), spark.createDataFrame(i, schema)
    kinds = {(r.pos, r.dup): r.kind for r in variants.compare(truth, imputed).collect()}
    assert kinds == {(1, 1): "MATCH_ALLELE", (2, 1): "TRUTH_MISSING_GT", (3, 1): "GT_UNPARSEABLE", (4, 1): "IMPUTED_MISSING_GT", (5, 1): "MISSING_IN_IMPUTED_SITE", (6, 1): "MATCH_ALLELE", (6, 2): "MISSING_IN_IMPUTED_SITE", (7, 1): "BOTH_MISSING_GT", (8, 1): "EXTRA_IN_IMPUTED_SITE"}
    as_ref = {(r.pos, r.dup): r.kind for r in variants.compare(truth, imputed, missing_as_ref=True).collect()}
    assert as_ref[4, 1] == "MATCH_ALLELE" and as_ref[5, 1] == "MISMATCH_ALLELE" and as_ref[8, 1] == "EXTRA_IN_IMPUTED_SITE"
    assert variants.written_sites(variants.compare(truth, imputed), "mismatches").count() == 3


def brute(emit, step):
    best = None
    for path in itertools.product(range(emit.shape[1]), repeat=len(emit)):
        score = emit[0, path[0]] + sum(step(t, path[t - 1], path[t]) + emit[t, path[t]] for t in range(1, len(emit)))
        if best is None or score > best[0] + 1e-12:
            best = (score, path)
    return best[0]


def value(path, emit, step):
    return emit[0, path[0]] + sum(step(t, path[t - 1], path[t]) + emit[t, path[t]] for t in range(1, len(emit)))


def test_decoders_find_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(10):
        emit = rng.standard_normal((5, 4))
        trans = rng.standard_normal((4, 4))
        path = kernels.viterbi(emit, trans, np.zeros(4))
        assert np.isclose(value(path, emit, lambda t, a, b, m=trans: m[a, b]), brute(emit, lambda t, a, b, m=trans: m[a, b]))
        path = kernels.viterbi_switch(emit, -0.1, -1.5)
        assert np.isclose(value(path, emit, lambda t, a, b: -0.1 if a == b else -1.5), brute(emit, lambda t, a, b: -0.1 if a == b else -1.5))


def test_factored_equals_whole():
    rng = np.random.default_rng(2)
    k = 6
    i, j = kernels.pairs(k)
    switches = np.minimum((i[:, None] != i).astype(int) + (j[:, None] != j), (i[:, None] != j).astype(int) + (j[:, None] != i))
    for _ in range(5):
        emit, cost, bonus = rng.standard_normal((60, len(i))), rng.random(60) * 3, rng.random(len(i)) * 0.1
        assert np.array_equal(kernels.crf_viterbi(emit, cost, switches, bonus), kernels.crf_viterbi_factored(emit, cost, bonus, k))
    log_p = kernels.crf_marginals(emit, cost, switches, bonus)
    assert np.allclose(np.exp(log_p).sum(axis=1), 1)
    best = kernels.crf_viterbi(emit, cost, switches, bonus)
    assert kernels.crf_nll(emit, cost, switches, bonus, best) <= kernels.crf_nll(emit, cost, switches, bonus, np.zeros(60, dtype=int))
    kept = np.zeros(len(i), dtype=bool)
    kept[[0, 3]] = True
    assert set(kernels.pruned(emit, kept, lambda e: e.argmax(axis=1)).tolist()) <= {0, 3}


def test_slots_equal_the_square_of_pairs():
    rng = np.random.default_rng(6)
    x = (rng.random((80, 5)) < 0.4).astype(float)
    i, j = kernels.pairs(5)
    emit = kernels.pair_emissions(kernels.log_softmax(x)) + np.where(i == j, -0.1, 0.0)
    path = kernels.viterbi(emit, kernels.ordered_transitions(5), np.full(len(i), -np.log(len(i))))
    got = kernels.hmm_diploid(x, np.ones(5))
    place = {(a, b): n for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))}
    step = lambda t, a, b, m=kernels.ordered_transitions(5): m[a, b]
    assert np.isclose(value([place[tuple(r)] for r in got.tolist()], emit, step), value(path, emit, step))
    assert (got == np.stack([i[path], j[path]], axis=1)).mean() > 0.9


def test_pairs_and_ordered_switches():
    assert list(zip(*kernels.pairs(3), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    a = kernels.ordered_transitions(3)
    assert a[1, 4] == -1e6 and a[1, 2] > -10 and a[1, 1] == np.log(0.99)


def test_gaps_bits_and_ordinals(spark):
    df = spark.createDataFrame([(1, [1, 0, 1, 1]), (2, [0, 0, 0, 0])], "id int, x array<int>").coalesce(1)
    packed = df.select("x", sites.pack_bits(F.col("x")).alias("b")).select("x", "b", sites.unpack_bits(F.col("b"), 4).alias("y")).collect()
    assert all(r.x == r.y for r in packed) and packed[0].b == 13
    rates = spark.createDataFrame([("i", f, r) for f, r in enumerate([0.9, 0.85, 0.3, 0.2])], "ind string, founder int, rate double")
    assert {r.founder for r in order.largest_gap_keep(rates, ["ind"], "rate", 0.1).collect()} == {0, 1}
    assert {r.founder for r in order.largest_gap_keep(rates, ["ind"], "rate", 0.7).collect()} == {0, 1, 2, 3}
    names = spark.createDataFrame([("chr10",), ("chr2",), ("chrX",), ("chr1",)], "n string")
    assert [r.n for r in order.natural_sort(names, "n").collect()] == ["chrX", "chr1", "chr2", "chr10"]
    many = spark.createDataFrame([("g", i) for i in range(11)], "g string, v int")
    assert sorted(r.v for r in order.bracketed(many, ["g"], "v", 3).collect()) == [0, 5, 10]
    masked = sites.mask_sites(spark.range(2000).withColumn("features", F.array(F.lit(1), F.lit(1))), ["id"], 2, 0.25, 3)
    assert 400 < masked.where("masked").count() < 600 and masked.where("masked AND features[0] <> 0").count() == 0
    assert order.hashed_sample(many, "v", 4, 1).collect() == order.hashed_sample(many, "v", 4, 1).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("2.4M", 2400000), ("3K", 3000), ("3.14B", 3140000000), ("1,200", 1200), ("x", None), ("", None)], "t string, want long")
    assert all(r.got == r.want for r in df.select("want", scalar.parse_position(F.col("t")).alias("got")).collect())
    cells = spark.createDataFrame([([1, 2, 70000],)], "x array<int>").select("x", scalar.decode_u32(scalar.encode_u32("x")).alias("y")).first()
    assert cells.x == cells.y
    names = spark.createDataFrame([("/a/s1_chr2_imputed.bed", "s1"), ("/a/s_1.bed", "s_1"), ("/a/s1_Chromosome3_imputed.bed", "s1")], "p string, want string")
    assert all(r.got == r.want for r in names.select("want", scalar.sample_of_bed(F.col("p")).alias("got")).collect())
    e = spark.range(1).select(scalar.success(F.struct(F.lit(1).alias("a"))).alias("s"), scalar.failure(F.lit("no")).alias("f")).first()
    assert e.s == '{"success":true,"data":{"a":1}}' and e.f == '{"success":false,"error":"no"}'


def test_sequences(spark):
    ref = spark.createDataFrame([("1", "ACGTACGTAC"), ("2", "GGGG")], "contig string, seq string")
    blocks = spark.createDataFrame([("1", 2, 3, None, 0), ("1", 5, 5, "TT", 1), ("1", 7, 7, ".", 2)], "contig string, start long, end long, alt string, ord int")
    seqs = {how: {r.contig: r.seq for r in sequences.blocks_to_sequence(blocks, ref, how, how).collect()} for how in ("N", "ref", "none")}
    assert seqs["N"]["1"] == "NCGNTTNNNNN" and seqs["ref"]["1"] == "ACGTTTCGTAC" and seqs["none"]["1"] == "CGTT"
    assert all(s["2"] == "GGGG" for s in seqs.values())
    assert sequences.out_of_order(blocks.unionByName(spark.createDataFrame([("1", 6, 6, None, 3)], blocks.schema))).count() == 1
    pieces = spark.createDataFrame([("L", "p", "1", 0, 3, 0), ("L", "p", "2", 1, 3, 1)], "line string, parent string, contig string, start long, end long, ord int")
    assert sequences.assemble(pieces, ref.withColumn("parent", F.lit("p")), ["line"]).first().seq == "ACGGG"
    records = spark.createDataFrame([("c", i * 10, i * 10 + (9 if i % 3 == 0 else 0), i % 3 == 0) for i in range(300)], "contig string, start long, end long, is_ref boolean")
    kept = sequences.downsample_blocks(records, 0.5, 5, 1)
    groups = {}
    for r in kept.collect():
        groups.setdefault(r.block, set()).add(r.start)
    assert 60 < kept.count() < 240


def test_simulations_repeat_and_tile(spark):
    lengths = spark.createDataFrame([("a", 10_000), ("b", 5_000)], "chrom string, length long")
    first = sorted(map(tuple, simulate.mosaics(lengths, ["x", "y", "z", "w"], 3, 500, 2000, 4).collect()))
    assert first == sorted(map(tuple, simulate.mosaics(lengths, ["x", "y", "z", "w"], 3, 500, 2000, 4).collect()))
    by = {}
    for line, chrom, s, e, _ in first:
        by.setdefault((line, chrom), []).append((s, e))
    for (_, chrom), own in by.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == {"a": 10_000, "b": 5_000}[chrom] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    cells = simulate.allele_windows(spark, 3, 40, 5, 2.0, 1.0, 1)
    assert cells.count() == 120 and cells.where("features[h1] <> 1").count() == 0
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 9)], "tree int, child int, parent int")
    assert simulate.tree_walk(edges, spark.createDataFrame([(0, 1), (0, 9)], "tree int, node int")).orderBy("node").select("root").collect()[0].root == 9


def test_masked_and_measures(spark):
    path = spark.createDataFrame([("w", t, x) for t, x in enumerate([0, 0, 1, 1, 2])], "w string, t int, x int")
    assert sorted(r.t for r in metrics.breakpoints(path, ["w"], "t", "x").collect()) == [1, 3]
    out = metrics.breakpoint_prf(metrics.breakpoints(path, ["w"], "t", "x"), spark.createDataFrame([("w", 2), ("w", 9)], "w string, t int"), ["w"], "t", 1).first()
    assert (out.tp_prec, out.n_pred, out.tp_rec, out.n_true) == (2, 2, 1, 2) and abs(out.f1 - 2 / 3) < 1e-9
    none = metrics.mode_per_key(spark.createDataFrame([(1, None), (1, 2), (1, 1), (2, None)], "k int, v int"), ["k"], "v")
    assert {(r.k, r.mode, r.size) for r in none.collect()} == {(1, 1, 3), (2, None, 1)}


def test_left_interval_join_keeps_all_points(spark):
    points = spark.createDataFrame([("c", 1, "x"), ("c", 5, "y"), ("c", 5, "y"), ("d", 5, "z"), (None, 5, "n")], "chrom string, pos long, tag string")
    laid = spark.createDataFrame([("c", 4, 9, "a"), ("c", 5, 5, "b")], "chrom string, low long, high long, label string")
    got = intervals.interval_join(points, laid, ["chrom"], "pos", "low", "high", 4, how="left").collect()
    assert sorted((r.tag, r.label or "") for r in got) == [("n", ""), ("x", ""), ("y", "a"), ("y", "a"), ("y", "b"), ("y", "b"), ("z", "")]


def test_walks_end_at_founders(spark):
    edges = spark.createDataFrame([(0, i, i - 1) for i in range(1, 20)] + [(1, 3, 7)], "tree long, child long, parent long")
    samples = spark.createDataFrame([(0, 19), (0, 0), (1, 3), (1, 9)], "tree long, node long")
    assert {(r.tree, r.node, r.root) for r in simulate.tree_walk(edges, samples).collect()} == {(0, 19, 0), (0, 0, 0), (1, 3, 7), (1, 9, 9)}


def test_concordance_counts_every_kind(spark):
    rows = [("c", 1, "A", "C", None, "0/1"), ("c", 2, "A", "C", None, "./.")]
    t = spark.createDataFrame(rows[:1], "chrom string, pos long, ref string, alt string, info string, gt string")
    both = spark.createDataFrame(rows, t.schema)
    assert variants.counters(variants.compare(t, t)).first().identical_strict is True
    last = variants.counters(variants.compare(both, both)).first()
    assert (last.both_missing_gt, last.concordance, last.identical_strict) == (1, 1.0, False)


def test_unset_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from haploom.session import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_crossovers_keep_their_gaps():
    rng = np.random.default_rng(5)
    for length in (100, 999, 5000):
        for _ in range(20):
            at = simulate.crossover_positions(length, 30, 90, rng)
            gaps = [b - a for a, b in itertools.pairwise(at)]
            assert at and at[0] <= 90 and all(30 <= g <= 90 for g in gaps) and 0 < length - at[-1] <= 90
    assert simulate.crossover_positions(50, 30, 90, rng) == [] and simulate.crossover_positions(50, 0, 9, rng) == []
    assert simulate.crossover_range(False, 4096) == (1, 3) and simulate.crossover_range(True, 4096) == (8, 40) and simulate.crossover_range(True, 10) == (1, 2)


def test_mosaics_keep_every_founder_at_each_place(spark):
    lengths = spark.createDataFrame([("a", 5_000)], "chrom string, length long")
    with pytest.raises(ValueError, match="pairs"):
        simulate.mosaics(lengths, ["x", "y", "z"], 1, 500, 2000, 4)
    rows = simulate.mosaics(lengths, ["x", "y", "z", "w"], 3, 500, 2000, 4).collect()
    assert all(r.start < r.end for r in rows) and len(rows) > 4
    for p in range(0, 5_000, 50):
        assert sorted(r.founder for r in rows if r.start <= p < r.end) == ["w", "x", "y", "z"]


def test_keys_are_written_by_line(spark, tmp_path):
    lengths = spark.createDataFrame([("a", 5_000), ("b", 3_000)], "chrom string, length long")
    mosaic = simulate.mosaics(lengths, ["x", "y"], 2, 500, 2000, 4).persist()
    simulate.write_keys(mosaic, str(tmp_path / "keys"))
    back = spark.read.option("sep", "\t").schema("chrom string, start long, end long, founder string, line long").csv(str(tmp_path / "keys"))
    assert sorted(map(tuple, back.select("line", "chrom", "start", "end", "founder").collect())) == sorted(map(tuple, mosaic.collect()))


def test_logits_may_rather_move_than_stay():
    rng = np.random.default_rng(7)
    for k, weights in ((3, np.array([0.2, 0.5, 0.3])), (4, np.full(4, 0.25))):
        x = rng.standard_normal((4, k))
        p = 0.2 * weights.max()
        stay, move = np.log(p), np.log((1 - p) / (k - 1))
        emit = kernels.log_softmax(x)
        step = lambda t, a, b: stay if a == b else move  # noqa: E731, B023
        assert np.isclose(value(kernels.logits_haploid(x, weights), emit, step), brute(emit, step))
        i, j = kernels.pairs(k)
        emit = kernels.pair_emissions(emit, 0.1)

        def both(t, a, b):
            same = int(i[a] == i[b]) + int(j[a] == j[b])  # noqa: B023
            return (-1e6, stay + move, 2 * stay)[same]  # noqa: B023

        found = kernels.logits_diploid(x, weights)
        path = [next(n for n in range(len(i)) if (i[n], j[n]) == tuple(f)) for f in found]
        assert np.isclose(value(path, emit, both), brute(emit, both))
    with pytest.raises(ValueError, match="weight"):
        kernels.logits_haploid(np.zeros((2, 2)), np.array([0.0, 0.0]))


def test_decode_over_kept_founders_and_own_penalties(spark):
    rows = [("c", t, [0, 9, 3] if t < 3 else [0, 3, 9], [0, 2], 0.0) for t in range(6)] + [("d", t, [9, 8, 0], [0, 1, 2], 50.0) for t in range(4)]
    df = spark.createDataFrame(rows, "contig string, t int, features array<int>, kept array<int>, homo double")
    got = kernels.decode(df, ["contig"], "t", "crf_haploid", keep="kept").where("contig = 'c'")
    assert {(r.p1, r.p2) for r in got.collect()} == {(2, 2)}
    free, held = (kernels.decode(df, ["contig"], "t", "crf_diploid", **o).where("contig = 'd'").collect() for o in ({}, {"penalty": "homo"}))
    assert {(r.p1, r.p2) for r in free} == {(0, 0)} and {(r.p1, r.p2) for r in held} == {(0, 1)}


def test_soft_labels_and_pairs_outside(spark):
    row = spark.range(1).select(sites.soft_label(F.lit(1), 4, 0.2).alias("x"), *(c.alias(n) for c, n in zip(sites.pair_members(F.lit(10), 4), "ij", strict=True))).first()
    assert np.allclose(row.x, [0.05, 0.85, 0.05, 0.05]) and row.i is None and row.j is None
