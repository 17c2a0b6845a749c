"""Chunked sequences, ordinals by ranges, orders, matrices and codecs on small and odd inputs."""

from __future__ import annotations

import base64
import functools
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haploom.functions import scalar
from haploom.operators import chunked, intervals, order, sequences
from haploom.sources import fasta


def whole(df, keys=("contig",)):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        key = tuple(r[k] for k in keys)
        out[key] = out.get(key, "") + r.bases
    return out


def test_numbers_and_sums_by_ranges(spark):
    """A key that fills most partitions, null keys, ties in no key, no rows."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(-5, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = {r.i: r for r in order.running_sum(order.numbered(df, [F.desc("i")], ["k"]), ["i"], F.col("v"), ["k"]).collect()}
    for k, i, _ in rows:
        assert got[i].ord == sum(a == k and b > i for a, b, _ in rows) and got[i].before == sum(v for a, b, v in rows if a == k and b < i)
    assert sorted(r.n for r in order.numbered(df, ["i"], name="n").collect()) == list(range(500))
    assert order.numbered(df.where("false"), ["i"], ["k"]).collect() == []


def test_version_order(spark):
    names = ["chr10", "chr2", "chr1", "chr01", "chr1a", "chr1.2", "chr1.10", "chr1~x", "chr", "a", "B", "_", "chr1_r2", "chr99999999999999999999999999999999999999999999", "", "2", "10"]
    number = lambda s: (len(s.lstrip("0")), s.lstrip("0"))

    def letter(c):
        return -1 if c == "~" else ord(c) if c.isascii() and c.isalpha() else ord(c) + 256

    def compare(a, b):
        """Text and numbers in turn, as the rule says."""
        while a or b:
            t, u = (a[: next((i for i, c in enumerate(x) if c.isdigit()), len(x))] for x in (a,)), (b[: next((i for i, c in enumerate(x) if c.isdigit()), len(x))] for x in (b,))
            t, u = next(t), next(u)
            x, y = [*map(letter, t), 0], [*map(letter, u), 0]
            if x != y:
                return -1 if x < y else 1
            a, b = a[len(t) :], b[len(u) :]
            m, n = (s[: next((i for i, c in enumerate(s) if not c.isdigit()), len(s))] for s in (a, b))
            if number(m) != number(n):
                return -1 if number(m) < number(n) else 1
            a, b = a[len(m) :], b[len(n) :]
        return 0

    want = sorted(names, key=lambda n: (functools.cmp_to_key(compare)(n), n))
    assert [r.n for r in order.version_sort(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()] == want
    assert want.index("chr1~x") < want.index("chr1") < want.index("chr1a") < want.index("chr1.2") < want.index("chr1.10") < want.index("chr2")


@pytest.mark.parametrize(("left", "right", "error"), [(3, 3, None), (3, 2, "observed has 3 rows, called has 2"), (0, 2, "observed has 0 rows, called has 2"), (2, 0, "observed has 2 rows, called has 0")])
def test_sides_must_be_equally_long(spark, left, right, error):
    a = spark.createDataFrame([("k", i, f"a{i}") for i in range(left)], "k string, i int, a string")
    b = spark.createDataFrame([("k", 10 - i, f"b{i}") for i in range(right)], "k string, j int, b string")
    run = lambda keys, b: order.checked_zip(a, b, keys, ["i"], ["j"], ("observed", "called")).select("a", "b").collect()
    for keys, other in ((["k"], b), ([], b.drop("k"))):
        if error:
            with pytest.raises(PySparkException, match=error):
                run(keys, other)
        else:
            assert sorted(map(tuple, run(keys, other))) == [("a0", "b2"), ("a1", "b1"), ("a2", "b0")]


@pytest.mark.parametrize("size", [1, 7, 60, 10_000])
def test_chunks(spark, tmp_path, size):
    rng = random.Random(size)
    seqs = {"c1": "".join(rng.choice("ACGT") for _ in range(200)), "c2": "ACGTAC", "c3": "G" * 60}
    at = tmp_path / "x.fa"
    at.write_text("junk\n" + "".join(f">{c} note\n" + "".join(s[i : i + 17] + rng.choice(["\n", "  \n", "\n\n"]) for i in range(0, len(s), 17)) for c, s in seqs.items()) + ">empty\n")
    store = fasta.read_chunks(spark, str(at), size).drop("path")
    assert whole(store) == {(c,): s for c, s in seqs.items()}
    assert all(len(r.bases) <= size for r in store.collect())
    assert whole(chunked.cut(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), size)) == whole(store)
    assert {r.contig: r.length for r in chunked.lengths(store, size).collect()} == {c: len(s) for c, s in seqs.items()}
    ranges = [(i, rng.choice([*seqs, "none"]), a, a + rng.randrange(0, 90)) for i in range(40) for a in [rng.randrange(0, 220)]]
    got = {r.i: r.seq for r in chunked.fetch(spark.createDataFrame(ranges, "i int, contig string, start long, end long"), store, ["i"], size).collect()}
    assert got == {i: seqs.get(c, "")[a:b] for i, c, a, b in ranges}
    pieces = [(s, i, "c1", a, a + rng.randrange(0, 60)) for s in "xy" for i in range(12) for a in [rng.randrange(0, 140)]]
    made = whole(chunked.assemble(spark.createDataFrame(pieces, "sample string, ord int, contig string, start long, end long"), store, ["sample"], size=size), ("sample",))
    assert made == {(s,): "".join(seqs["c1"][a:b] for q, _, _, a, b in pieces if q == s) for s in "xy"}


@pytest.mark.parametrize(("gap", "no_call"), [("N", "N"), ("ref", "N"), ("none", "none"), ("N", "ref")])
def test_filled_like_whole_sequences(spark, gap, no_call):
    """The same bases as from one row a contig: overlaps, a long gap, alleles of other lengths, contigs without blocks."""
    rng = random.Random(7)
    seqs = [("c1", "".join(rng.choice("acgt") for _ in range(300))), ("c2", "acgtacgt"), ("c3", "tttt")]
    blocks = [("c1", 4, 9, None), ("c1", 10, 10, "GGG"), ("c1", 12, 15, "."), ("c1", 14, 16, None), ("c1", 200, 230, "T"), ("c2", 1, 8, None), ("other", 1, 2, "A")]
    b = spark.createDataFrame(blocks, "contig string, start long, end long, alt string")
    ref = spark.createDataFrame(seqs, "contig string, seq string")
    want = {(r.contig,): r.seq for r in sequences.blocks_to_sequence(b, ref, gap, no_call).collect()}
    assert whole(chunked.fill(b, chunked.cut(ref, 11), gap, no_call, 11)) == want


def test_matrix_of_no_regions_and_odd_parents(spark):
    rows = [("c", 5, 9, 1, "p2", "p10"), ("c", 5, 7, 0, "p10", "p10"), ("c", 1, 2, 2, None, "p2"), ("d", 1, 2, 3, "x", "p1")]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, ord long, parent1 string, parent2 string")
    matrix, paths = intervals.region_matrix(df, block=1)
    got = {(r.chrom, r.block): (r.offsets, r.parents, r.codes) for r in matrix.collect()}
    assert got == {("c", 0): ([0, 1], [1], [3]), ("c", 1): ([0, 2], [0, 1], [1, 2]), ("d", 0): ([0, 2], [0, 1], [1, 2])}
    assert {(r.chrom, r.block): (r.parent1, r.parent2) for r in paths.collect()} == {("c", 0): ([1], [1]), ("c", 1): ([0], [1]), ("d", 0): ([0], [1])}
    assert intervals.region_matrix(df.where("false"))[0].collect() == []


def test_arrays_there_and_back(spark):
    kinds = {"uint8": ("B", [0, 255]), "int16": ("h", [-32768, 32767, -1]), "int32": ("i", [-(2**31), 2**31 - 1]), "uint32": ("I", [0, 2**32 - 1]), "int64": ("q", [-(2**63), 2**63 - 1, -2]), "float32": ("f", [0.1, -2.5, 1e-45, 3e38, -0.0]), "float64": ("d", [0.1, -1.5e300, 5e-324, 2.2250738585072014e-308, 1e-310, float("inf"), 3.0])}
    for dtype, (code, values) in kinds.items():
        text = base64.b64encode(struct.pack(f"<{len(values)}{code}", *values)).decode()
        want = list(struct.unpack(f"<{len(values)}{code}", base64.b64decode(text)))
        df = spark.createDataFrame([(text,), ("",)], "t string")
        got = [r.x for r in df.select(scalar.decode_array(F.col("t"), dtype).alias("x")).collect()]
        assert got[0]["values"] == want and got[0].reason is None and got[1]["values"] == []
        if code not in "fd":
            back = df.limit(1).select(scalar.encode_array(scalar.decode_array(F.col("t"), dtype)["values"], dtype).alias("t")).first().t
            assert back == text
    nan = base64.b64encode(struct.pack("<d", float("nan"))).decode()
    assert str(spark.createDataFrame([(nan,)], "t string").select(scalar.decode_array(F.col("t"), "float64")["values"][0]).first()[0]) == "nan"


def test_bad_arrays_have_reasons(spark):
    df = spark.createDataFrame([(None, 1, 1), ("?*", 1, 1), ("AAA=", 1, 1), ("AAAAAA==", 1, 1), ("AAAAAA==", None, 1)], "t string, r int, c int")
    got = [tuple(r) for r in df.select(scalar.decode_matrix(F.col("t"), F.col("r"), F.col("c"), "int32").alias("m")).select("m.values", "m.reason").collect()]
    assert got == [(None, "no data"), (None, "not base64"), (None, "wrong size"), ([[0]], None), (None, "no shape")]
    with pytest.raises(ValueError, match="whole numbers"):
        scalar.encode_array(F.col("x"), "float32")


def test_positions_and_names(spark):
    texts = [("2.4 M", 2400000), (" 3 k ", 3000), ("1e3", None), ("NaN", None), ("-4", None), ("5.", None), (".5M", None), ("K", None), ("1,2,3", 123), ("7MB", None), (None, None)]
    df = spark.createDataFrame(texts, "t string, want long")
    assert [r.got for r in df.select(scalar.parse_position(F.col("t")).alias("got")).collect()] == [w for _, w in texts]
    names = [("/a/b_c_chrX_imputed.bed", "b_c"), ("s_chr_imputed.bed", "s_chr_imputed"), ("chr1_imputed.bed", "chr1_imputed"), ("a_chr1-2_imputed.bed", "a_chr1-2_imputed"), ("a.txt", "")]
    df = spark.createDataFrame(names, "p string, want string")
    assert [r.got for r in df.select(scalar.sample_of_bed(F.col("p")).alias("got")).collect()] == [w for _, w in names]


def test_block_sizes(spark):
    """Draws follow qualifying blocks and contigs; sizes run from change to change."""
    rng = random.Random(1)
    rows = [(c, i * 10 + 1, i * 10 + rng.randrange(1, 10), rng.random() < 0.6) for c in ("a", "b") for i in range(200)]
    marked = {(r.contig, r.start): r for r in sequences.marked_blocks(spark.createDataFrame(rows, "contig string, start long, end long, is_ref boolean"), 0.4, 8, 5).collect()}
    draws = {r.block: r.kept for r in marked.values()}
    assert {True, False} == set(draws.values())
    sizes, want = [], []
    for c in ("a", "b"):
        free, block, keep, last = True, 0, True, 0
        for _, start, end, ref in [r for r in rows if r[0] == c]:
            own = marked[c, start]
            if ref:
                free = free or end - start + 1 >= 8
            elif free:
                block, free = block + 1, False
                assert own.drawn and own.block == block
                if own.kept != keep:
                    want.append((c, start, start - last, "ref" if own.kept else "query"))
                    keep, last = own.kept, start
            assert own.block == block and own.kept == keep
    df = spark.createDataFrame([tuple(r) for r in marked.values()], "contig string, start long, end long, is_ref boolean, drawn boolean, block long, kept boolean")
    sizes = sorted(tuple(r) for r in sequences.block_sizes(df).collect())
    assert sizes == sorted(want) and len(want) > 10
    assert sequences.kept_records(df, keep_ref=False).count() < sequences.kept_records(df).count()


def test_joint_argmax(spark):
    df = spark.createDataFrame([([[1.0, 5.0, 9.0], [5.0, 2.0, 0.0], [9.0, 0.0, 9.0]],)], "m array<array<double>>")
    r = df.select(order.joint_argmax(F.col("m")).alias("a"), order.joint_argmax(F.col("m"), True).alias("k"), order.joint_argmax_of(F.col("m")[0], F.col("m")[1], True).alias("s")).first()
    assert (r.a.i, r.a.j, r.k.i, r.k.j, r.s.i, r.s.j) == (0, 2, 0, 1, 1, 0)
