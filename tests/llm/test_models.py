"""Classifiers by held-out accuracy, and their cases without data."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from haploom.llm import quality, toxicity
from haploom.llm.linear import dual_descent, labelled_sample, platt
from tests.llm.common import ODD, documents, prose


def corpus(rng, n):
    """Clean prose, shouted junk (quality 0) and insults (toxic 1)."""
    out = []
    for i in range(n):
        words = prose(rng, rng.randrange(30, 90))
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        if kind == 2:
            at = rng.randrange(len(words))
            words[at] = rng.choice(["grobnik", "gr.ob.nik", "grobnikka", "zwaxxel", "zwa-xxel", "zwaxxelo"])
        out.append((i, " ".join(words), int(kind != 1), int(kind == 2)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(random.Random(5), 600)
    docs = documents(spark, [(i, t) for i, t, _, _ in rows], clash=True).cache()
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 500] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: (q, x) for i, _, q, x in rows}


def accuracy(scored, truth, k, held_out):
    rows = [r for r in scored.collect() if r.held_out == held_out]
    return sum(r.predicted == truth[r.doc_id][k] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    assert accuracy(quality.score(docs, quality.train(docs, labels)), truth, 0, True) > 0.97


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, truth = tables
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model), truth, 1, True) > 0.95
    inside, outside = toxicity.Scorer(model).scores(["so gro.bnik it is", "g r o b n i k said"]), toxicity.Scorer(model).scores(["tarimon belsho"])
    assert min(inside) > 0.5 > outside[0]


def plain_kernel(x, y):
    """The gap-weighted kernel of common subsequences of three letters, by its definition."""

    def weights(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i], w[j], w[k]] = out.get((w[i], w[j], w[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = weights(x), weights(y)
    dot = lambda p, q: sum(v * q[t] for t, v in p.items() if t in q)
    return dot(a, b) / max(np.sqrt(dot(a, a) * dot(b, b)), 1e-30)


def test_kernel_is_the_plain_one():
    rng = random.Random(6)
    words = [toxicity.letters(w) for w in [*prose(rng, 25), "banana", "aaaaaa", "ab", "a", "gro.bnik", "grobnik"]]
    phi = toxicity.features(words)
    want = np.array([[plain_kernel(x, y) for y in words] for x in words])
    assert np.allclose(phi @ phi.T, want, atol=1e-5)


def test_collapsed_table_is_the_nystroem_map():
    rng = random.Random(7)
    words, marks = prose(rng, 40), prose(rng, 12)
    base = toxicity.features([toxicity.letters(w) for w in marks])
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    root = vectors[:, values > 1e-3] / np.sqrt(values[values > 1e-3])
    w = np.random.default_rng(0).standard_normal(root.shape[1])
    model = toxicity.Model((base.T @ (root @ w)).astype(np.float32), 0.25, 1.0, 0.0)
    kernels = np.array([[plain_kernel(toxicity.letters(x), toxicity.letters(m)) for m in marks] for x in words])
    assert np.allclose(model.margins(words), kernels @ root @ w + 0.25, atol=1e-4)


def test_quality_scores_are_those_of_a_plain_model():
    rng = random.Random(8)
    texts = [" ".join(prose(rng, 12)) if i % 2 else " ".join(w.upper() for w in prose(rng, 12)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)])
    sets = [sorted(set(quality.ngrams(t).tolist())) for t in texts]
    model = quality.fit([np.array(s) for s in sets], y, 0.5)
    count = [{}, {}]
    for own, label in zip(sets, y.tolist(), strict=True):
        for g in own:
            count[label][g] = count[label].get(g, 0) + 1
    size = 1 << quality.BITS
    total = [size + sum(c.values()) for c in count]
    ratio = {g: np.log((1 + count[1].get(g, 0)) / total[1]) - np.log((1 + count[0].get(g, 0)) / total[0]) for s in sets for g in s}
    assert all(np.isclose(model.square[g], r * r) for g, r in ratio.items())
    svm = {g: model.weight[g] / r for g, r in ratio.items() if abs(r) > 1e-12}
    for text, own, label in zip(texts, sets, y.tolist(), strict=True):
        norm = np.sqrt(sum(ratio[g] ** 2 for g in own))
        margin = sum(svm.get(g, 0) * ratio[g] / norm for g in own) + model.bias
        assert np.isclose(model.scores([text])[0], 1 / (1 + np.exp(-(model.a * margin + model.b)))) and (margin > 0) == (label == 1)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    w = dual_descent([(np.arange(3), r) for r in x], y, 3, np.full(60, 1.0), epochs=2000)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()
    assert all(loss(w) <= loss(w + 0.02 * d) + 1e-3 for d in rng.standard_normal((400, 4)))


def test_folds_are_kept_apart(tables):
    import zlib

    _, labels, _ = tables
    chosen, share = labelled_sample(labels, "toxic", 1000)
    assert chosen and all(zlib.crc32(str(i).encode()) % 5 for i in chosen)
    assert 0.2 < share < 0.3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_missing_classes(spark, module):
    docs = documents(spark, ODD, clash=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert module.score(documents(spark, []), module.train(docs, labels)).count() == 0


def test_filter_keeps_columns(spark, tables):
    docs, labels, truth = tables
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i][0] for i in ids) / len(ids) > 0.97 and len(ids) > 400


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1.0]) > 0, 1.0, -1.0)
    w = dual_descent([(np.arange(5), r) for r in x], y, 5, np.full(200, 10.0), epochs=100)
    assert ((x @ w[:5] + w[5] > 0) == (y > 0)).mean() > 0.97


def test_platt_is_monotone():
    m = np.linspace(-3, 3, 50)
    a, b = platt(m, (m > 0).astype(int), np.ones(50))
    assert a > 0 and abs(b) < 0.5


def test_sentences():
    got = toxicity.sentences("One two two. Is it?! yes i.d.i.o.t here\nl o s e r\n\n...\n3.5 x")
    assert got == [["One", "two"], ["Is", "it"], ["yes", "i.d.i.o.t", "here"], ["l", "o", "s", "e", "r", "loser"], ["3.5", "x"]]
    assert toxicity.sentences("") == [] == toxicity.sentences(" . \n!")


def test_sentences_stand_for_documents():
    """Every clean sentence by its highest word, a toxic document by that of its highest sentence."""
    docs = [[["a", "b"], ["c"]], [["b", "d"], ["a"]], []]
    bags = toxicity.Bags(docs, np.array([1, 0, 1]))
    value = np.array([{"a": 1.0, "b": 2.0, "c": 3.0, "d": 0.0}[w] for w in bags.words])
    named = lambda count: {bags.words[w]: n for w, n in count.items()}
    toxic, clean = bags.tops(value, np.arange(3))
    assert named(toxic) == {"c": 1} and named(clean) == {"b": 1, "a": 1}
    assert bags.margins(value, -9.0).tolist() == [3.0, 2.0, -9.0]
    clean, toxic = bags.counts(np.arange(3))
    assert named(clean) == {"b": 1, "d": 1, "a": 1} and named(toxic) == {"a": 1, "b": 1, "c": 1}


def test_agreement_is_the_best_f1():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m, y = rng.random(30), rng.integers(0, 2, 30)
        y[0] = 1
        m = np.round(m, 1)
        f1 = lambda t: 2 * ((m >= t) & (y == 1)).sum() / ((m >= t).sum() + y.sum())  # noqa: B023, E731
        found, cut = toxicity._agreement(m, y)
        assert found == pytest.approx(max(map(f1, m))) and found == pytest.approx(f1(cut)) and cut not in m


def test_svm_on_the_map_is_that_of_the_kernel():
    """With all words as landmarks the map's products are the kernel, and the table gives the map's decision."""
    rng = random.Random(6)
    words = sorted(set(prose(rng, 30)))
    words = [w for w in words if len(w) >= 3]
    space = toxicity.Nystroem(words)
    phi = toxicity.features([toxicity.letters(w) for w in words])
    z = space.vectors(words)
    assert np.allclose(z @ z.T, phi @ phi.T, atol=2e-2)
    w, bias = toxicity._svm(space, Counter({words[0]: 3}), Counter({x: 1 for x in words[1:]}))
    assert np.allclose(toxicity.Model(space.table(w), bias, 1.0, 0.0).margins(words), z @ w + bias, atol=1e-3)
    assert (z @ w + bias).argmax() == 0
    table = space.table(w)
    odd = [*words, "ab", "", "x" * 200, "gro.bnik"]
    assert np.allclose(toxicity.Vocabulary(odd).margins(table, bias), toxicity.Model(table, bias, 1.0, 0.0).margins(odd), atol=1e-4)


def test_training_on_odd_documents():
    """Only one class, empty documents, words without letters, a very long document."""
    for docs in ([[], []], [[["?!"]], []], [[["abc"]], [[f"w{i}x" for i in range(30000)]]]):
        model = toxicity.fit(docs, np.array([1, 0]), 0.3)
        assert 0 <= float(toxicity.Scorer(model).scores(["abc", ""])[0]) <= 1
    assert toxicity.Scorer(toxicity.fit([[["abc"]]], np.array([0]), 0.3)).scores(["abc"])[0] == pytest.approx(0.3)
