"""Ranked search against scoring every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from haploom.llm import search as S
from tests.llm.common import ODD, documents, prose


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(S.BETWEEN, low)


def plain(docs, items, best):
    """(item, rank, doc, score) by the stated formula; docs and items are (id, text)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, best):
    df = documents(spark, docs, clash=True).selectExpr("*", "'x' AS item", "1 AS rank", "'y' AS terms", "2 AS n", "3 AS tfs")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "'x' AS item", "'y' AS term")
    return sorted((tuple(r) for r in S.ranked(df.repartition(3), q, best).collect()), key=str)


def test_terms():
    assert S.terms_of("Don't STOP-2x\x00É_é\x7fß|") == [x.encode() for x in ("don", "t", "stop", "2x", "É", "é", "ß")]
    for text in ("a[b]c`d{e", "x@y:z/0", " é ñandú", ""):
        assert [t.decode() for t in S.terms_of(text)] == terms(text)


@pytest.mark.parametrize("best", [1, 3, 50])
def test_same_as_scoring_all(spark, best, monkeypatch):
    """Skewed words, copies and ties; many small inversions in a task and several blocks of queries."""
    monkeypatch.setattr(S, "AT_ONCE", 400)
    monkeypatch.setattr(S, "BLOCK_TERMS", 60)
    rng = random.Random(best)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=n))
    docs = [(i, draw(rng.randrange(1, 60))) for i in range(300)]
    docs += [(300 + i, docs[i % 7][1]) for i in range(120)]
    rng.shuffle(docs)
    items = [(i, draw(12)) for i in range(25)] + [(3, draw(5)), (40, "nowhere found"), (41, None), (42, "")]
    assert found(spark, docs, items, best) == plain(docs, items, best)


def test_odd_tables(spark):
    docs = [*ODD, (8, " ".join(prose(random.Random(1), 20000)))]
    items = [(1, "a long no"), (2, "don t X"), (None, "é id"), (3, "long")]
    assert found(spark, docs, items, 4) == plain(docs, items, 4)
    assert found(spark, [], items, 4) == [] and found(spark, docs, [], 4) == []
    assert found(spark, [(1, None)], items, 4) == []


def test_accumulators_are_limited_and_results_exact():
    """A rare term decides; what only holds common terms gets no accumulator, and floors from elsewhere change nothing."""
    rng = np.random.default_rng(5)
    n = 4000
    held = [np.flatnonzero(rng.random(n) < p) for p in (0.02, 0.03, 0.5, 0.8, 0.9)]
    code = np.concatenate([np.full(len(x), i, np.int32) for i, x in enumerate(held)])
    doc, tf = np.concatenate(held).astype(np.int32), rng.integers(1, 4, sum(map(len, held)))
    weights = np.array([4000, 3500, 600, 200, 100])
    post = S._Postings(pa.array(range(n)), np.full(n, 20), code, doc, tf, n, 20 * n)
    score = np.zeros(n, dtype=np.int64)
    for i, x in enumerate(held):
        score[x] += weights[i] * (1_000_000_000 * tf[code == i] // (1000 * tf[code == i] + 20 * 100))
    want = np.sort(score)[::-1][:10]
    rows, got = post.search(np.arange(5), weights, 10, 0)
    assert (np.sort(got)[::-1][:10] == want).all() and (score[rows] == got).all()
    assert len(rows) < len(np.union1d(held[0], held[1])) < np.count_nonzero(score) / 10
    rows, got = post.search(np.arange(5), weights, 10, int(want[4]))
    assert (np.sort(got)[::-1] == want[want >= want[4]]).all()
