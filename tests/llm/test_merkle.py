"""The manifest against plain hashing, its addresses against the layout written out, and odd tables."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploom.llm import merkle as M
from tests.llm.common import ODD, documents

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def test_addresses_follow_the_layout():
    """The order of nodes is that of the recursive definition, without gaps, for ragged trees as well."""

    def order(n, levels, level, tree):
        """(level, index) of the nodes of an aligned subtree whose leaves are at ``level``; only those that are there."""
        if levels == 1:
            return [(level, tree)] if tree < -(-n // 16**level) else []
        low = levels // 2
        up = order(n, levels - low, level + low, tree)
        return up + [x for t in range(tree * 16 ** (levels - low), (tree + 1) * 16 ** (levels - low)) for x in order(n, low, level, t)]

    rng = random.Random(4)
    for levels in (1, 2, 3, 4):
        for n in {1, 16 ** (levels - 1), *(rng.randrange(1, 16 ** (levels - 1) + 1) for _ in range(8))}:
            want = order(n, levels, 0, 0)
            got = {int(a): (level, i) for level in range(levels) for i, a in enumerate(M.address(n, levels, level, np.arange(-(-n // 16**level))))}
            assert [got[i] for i in range(len(got))] == want and len(want) == M.size(n, levels)


def test_block_gives_back_what_it_was_built_from():
    leaves = [H(str(i)) for i in range(300)]
    packed, root = M.build_block(leaves, M.height(300))
    paths = M.siblings(packed, 300, M.height(300))
    assert all(M.fold(leaf, path) == root for leaf, path in zip(leaves, paths, strict=True))
    assert M.fold(leaves[1], paths[0]) != root
    assert M.build_block(["ab" * 32], 1)[1] == "ab" * 32 and M.height(1) == 1


def plain(rows):
    """doc_id -> sorted results by hashing level by level; rows: (doc_id, source, lang, n_chars, text)."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    import zlib

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            a = i // 16 * 16
            out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
            i //= 16
        return out

    def fold(h, p):
        for x, y in p:
            h = H(x, h, y)
        return h

    by = {}
    for r in rows:
        leaf = H(*map(code, r))
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[1], []).append((r[0], leaf, H(*map(code, (*r[:4], low(r[4])))) if touched else leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = up([x[1] for x in by[s]])
    top = up([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for j, s in enumerate(names):
        for i, (doc, leaf, claimed) in enumerate(by[s]):
            p = path(trees[s], i) + path(top, j)
            folded = fold(claimed, p)
            out.append((doc, leaf, trees[s][-1][0], root, H(*(x + y for x, y in p)), folded, folded == root))
    return sorted(out, key=str)


def found(df, levels):
    row = {c: F.col(c) for c in M.FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = M.leaf(row | {"text": F.translate("text", M.UPPER, M.LOWER)})
    leaves = df.select("doc_id", "source", M.leaf(row).alias("leaf"), F.when(touched, changed).alias("claimed"))
    return sorted((tuple(r) for r in M.proofs(M.manifest(leaves, levels)).collect()), key=str)


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_trees_of_all_heights(spark, levels):
    """One source holds most rows, some hold one; with small subtrees there are three tiers."""
    rng = random.Random(levels)
    sources = ["hot"] * 700 + ["b"] * 40 + ["é"] * 17 + ["one", "", None, None] + [f"s{i}" for i in range(20)]
    rows = [(i, s, rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Text", "text", None, "", "ÄB c" * 5])) for i, s in enumerate(sources)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = found(df.repartition(5), levels)
    assert got == plain(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_tables(spark):
    """Null ids, repeated rows, long and empty texts, columns with clashing names; no rows; a lone row."""
    df = documents(spark, ODD, clash=True).selectExpr("*", "'x' AS tree", "1 AS at", "'y' AS leaf", "0 AS block")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found(df, 4) == plain(rows)
    assert found(df.where("false"), 4) == []
    lone = found(df.where("doc_id = 5"), 4)
    assert len(lone) == 1 and lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == H()


def test_stored_subtrees(spark):
    rows = [(i, f"s{i % 3}", H(str(i))) for i in range(100)]
    kept = M.manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), 2).blocks().collect()
    assert all(len(r.nodes) == 32 * M.size(r.n, r.levels) for r in kept)
    # 33 or 34 leaves: three subtrees of 16, over them one; the sources' roots are one more
    assert sorted((r.of, r.tier, r.block) for r in kept) == sorted([("documents", 0, b) for b in range(3)] * 3 + [("documents", 1, 0)] * 3 + [("sources", 0, 0)])
