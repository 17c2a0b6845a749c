"""Quality rules: counts against plain Python, tails against exact sums, cut-offs against their guarantee."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haploom.llm import rules as R
from tests.llm.common import ODD, documents, prose


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in R.SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated), len(lines), sum("A" <= c <= "Z" for c in text))


def test_counts(spark):
    rng = random.Random(3)
    texts = [t for _, t in ODD] + ["a b c d e a b c d e", "A b c d e\nA b c d e\n\n \nA b c d e ", "x\x0by\x0cz\x85w v", "#$|<", "\U0001f600é " * 3, " ".join(prose(rng, 5000) * 2)]
    assert R.measure(["a b", "c d e", "f"])["n_repeat_words"].tolist() == [0, 0, 0] and R.measure([""])["n_words"].tolist() == [0]
    texts += [" ".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(60)]
    got = {r.doc_id: tuple(r[c] for c in R.COUNTS) for r in R.measured(documents(spark, list(enumerate(texts)), clash=True)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "share"), [(1, 0.3), (50, 0.05), (400, 0.005), (300, 0.5)])
def test_tail_is_exact(n, share):
    exact, total = Fraction(share), Fraction(0)
    for x in range(n + 1):
        total += math.comb(n, x) * exact**x * (1 - exact) ** (n - x)
        assert R.binomial_tail(x, n, share) == pytest.approx(float(total), rel=1e-9, abs=1e-300)


def test_tail_of_many():
    assert R.binomial_tail(0, 10**6, 1e-6) == pytest.approx((1 - 1e-6) ** 10**6, rel=1e-9)
    assert 0.49 < R.binomial_tail(5_000_000, 10**9, 0.005) < 0.51
    assert R.binomial_tail(4_980_000, 10**9, 0.005) < 1e-15 < 1 - R.binomial_tail(5_020_000, 10**9, 0.005) + 1e-14


def table(spark, rows):
    """rows: (doc_id, stratum, symbols of 1000 characters)."""
    return spark.createDataFrame([(i, s, 100, 1000, x, 0, 0, 10, 0) for i, s, x in rows], "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in R.COUNTS))


ONE = {"symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.1, 0.05))}


def test_cut_offs(spark):
    """The strictest cut-off whose tail, and all laxer ones', stay below the corrected level."""
    rows = [(i, "big", 80 if i < 15 else 0) for i in range(2000)] + [(5000 + i, "small", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, good int")
    cuts = R.calibrate(table(spark, rows), labels, lost=0.01, doubt=0.05, rules=ONE)
    tried = {(r.stratum, r.step): r for r in cuts.tried.collect()}
    assert [tried["big", k].x for k in range(4)] == [0, 0, 0, 15] and tried["small", 0].n == 60
    assert all(r.vouched == (R.binomial_tail(r.x, r.n, 0.01) <= 0.05 / 2) for r in tried.values())
    assert {r.stratum: r.symbols for r in cuts.chosen.collect()} == {"big": 0.1}
    docs = table(spark, [(1, "big", 99), (2, "big", 101), (3, "small", 900), (4, "new", 900)])
    assert {r.doc_id: r.kept for r in R.judge(docs, cuts, ONE).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_guarantee_holds_over_many_draws(spark):
    """Where a rule in truth rejects twice what is allowed, it is vouched for less often than the doubt says."""
    rng = random.Random(9)
    strata = [f"s{k}" for k in range(60)]
    rows = [(k * 1000 + i, s, 60 if rng.random() < 0.04 else 0) for k, s in enumerate(strata) for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, good int")
    cuts = R.calibrate(table(spark, rows), labels, lost=0.02, doubt=0.05, rules=ONE).chosen.collect()
    assert not any(r.symbols == 0.05 for r in cuts)


def test_whose_labels_count(spark):
    """Bad documents, failing ones, null ids and ids without a row do not; repeated rows and labels count once, the worse way."""
    rows = [(i, "s", 0) for i in range(100)] + [(0, "s", 700), (None, "s", 700), (200, "s", 700)]
    counts = table(spark, rows).unionByName(table(spark, [(300, "s", 700)]).withColumn("n_words", F.lit(3).cast("long")))
    labels = [(i, 1) for i in range(100)] + [(0, 1), (1, 0), (None, 1), (200, 0), (300, 1), (999, 1)]
    tried = R.calibrate(counts, spark.createDataFrame(labels, "doc_id long, good int"), rules=ONE).tried.collect()
    assert {(r.stratum, r.n, r.x) for r in tried} == {("s", 99, 1)}


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, good int")
    empty = R.measured(documents(spark, []))
    assert R.judge(empty, R.calibrate(empty, none)).collect() == []
    counts = R.measured(documents(spark, ODD))
    judged = R.judge(counts, R.calibrate(counts, none)).collect()
    assert len(judged) == len(ODD) and all(r.kept != r.base_failed for r in judged)
