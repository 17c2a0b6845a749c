"""Joins and searches against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from haploom.llm import decontaminate, jaccard_join, licenses, nearest, quotes, substring_dedup
from tests.llm.common import ODD, documents, prose

LOW = str.maketrans(licenses.UPPER, licenses.LOWER)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_links(rows, k, num, den):
    """(sets by id, ids linked with each)"""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    linked = {i: set() for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                linked[i].add(j)
                linked[j].add(i)
    return sets, linked


def brute_components(rows, k, num, den):
    sets, linked = brute_links(rows, k, num, den)
    root = {}
    for i in sorted(sets):
        if i not in root:
            root[i], todo = i, [i]
            while todo:
                for j in linked[todo.pop()]:
                    if j not in root:
                        root[j] = i
                        todo.append(j)
    return root


def near_copies(rng, n, size):
    base = prose(rng, size)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, max(2, size // 25))):
            words[rng.randrange(len(words))] = rng.choice(prose(rng, 3))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    texts = [" ".join(prose(rng, rng.randrange(1, 60))) for _ in range(60)]
    texts += [t for size in (5, 9, 20, 60, 200) for t in near_copies(rng, 12, size)] + near_copies(rng, 70, 90)
    texts += texts[:10] + [t.upper() for t in texts[60:70]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num", "parts"), [(4, 85, 1), (4, 85, 7), (5, 80, 3)])
def test_components_and_links_are_brute_forces(spark, copies, k, num, parts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # large groups go through several blocks
    got = jaccard_join.similar_groups(documents(spark, copies, clash=True).repartition(parts, "doc_id"), k, num, 100).collect()
    sets, linked = brute_links(copies, k, num, 100)
    want = brute_components(copies, k, num, 100)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, k)) for i, t in copies}
    names = {i: frozenset(x[0]) for i, x in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == {i: len({names[j] for j in linked[i]} - {names[i]}) for i in names}
    assert len(set(want.values())) < len(want) - 60


def test_links_of_a_cluster_in_many_slices(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 120)
    rows = [(i, " ".join(base[:50] + [f"new{i}"] + base[50:])) for i in range(160)] + [(200 + i, " ".join(prose(rng, 80))) for i in range(100)]
    rng.shuffle(rows)
    for parts in (1, 5):
        got = jaccard_join.similar_groups(documents(spark, rows).repartition(parts, "doc_id"), 4, 85, 100).collect()
        assert {(r.n_links, r.component_id) for r in got if r.doc_id < 200} == {(159, 0)}
        assert {(r.n_links, r.component_id - r.doc_id) for r in got if r.doc_id >= 200} == {(0, 0)}


def test_a_lone_link_in_a_block_joins_its_two_sets():
    sets = [np.arange(100), np.arange(95), np.arange(500, 600), np.arange(490, 590)]
    row = [7, 0, False, 0, np.arange(4), np.array([len(x) for x in sets], dtype=np.int32), np.concatenate(sets).astype(np.uint64)]
    row[4:] = [x.tobytes() for x in row[4:]]
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["home", "i", "visiting", "j", "nodes", "sizes", "sets"])
    got = [tuple(r.values()) for b in jaccard_join._compare(iter([batch]), 80, 100) for r in b.to_pylist()]
    assert got == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 2, 1)]
    assert [tuple(r.values()) for b in jaccard_join._compare(iter([batch]), 85, 100) for r in b.to_pylist()] == got[:2]


def test_shared_counts_are_those_of_sets():
    rng = np.random.default_rng(4)
    some = [np.unique(rng.integers(0, 60, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)] + [np.arange(1000 + i, 1030 + i, dtype=np.uint64) for i in range(9)]
    for a, b in ((some, some), (some[:5], some[3:]), (some[:1], some[45:])):
        assert np.array_equal(jaccard_join._shared(a, b), [[len(np.intersect1d(x, y)) for y in b] for x in a])


def test_signatures_meet_for_every_similar_pair(copies):
    bands = jaccard_join.Bands(85, 100)
    sets = [jaccard_join.shingle_sets([t], 4)[0] for _, t in copies]
    made = []
    for own in sets:
        band = bands.of(len(own)) if len(own) else 0
        entry = {}
        for scheme in (band, band + 1):
            if len(own) and bands.most_apart(scheme):
                s, f = jaccard_join.signatures(own, scheme, bands, scheme > band, np.full(len(own), 9 if len(own) % 2 else 1))
                for x, y in zip(s.tolist(), f.tolist(), strict=True):
                    entry.setdefault(x, []).append(y)
        made.append(entry)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(np.intersect1d(a, b))
            if len(a) and 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                shared = [(x, y) for s in made[i].keys() & made[j].keys() for x in made[i][s] for y in made[j][s]]
                assert any((x | y) & (4 if (x ^ y) & 1 else 2) and not x & y & 1 for x, y in shared)


def test_odd_rows_of_the_join(spark):
    got = jaccard_join.similar_groups(documents(spark, ODD, clash=True), 4, 85, 100).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in got} == {(1, 1, 0), (2, 2, 0), (3, 3, 1), (None, None, 1), (4, 4, 1), (5, 5, 1), (6, 6, 0), (7, 7, 2)}
    assert jaccard_join.similar_groups(documents(spark, []), 4, 85, 100).count() == 0


def test_repeated_passages_are_found(spark):
    rng = random.Random(4)
    passage = prose(rng, 70)
    rows = [(i, " ".join(prose(rng, rng.randrange(40, 200)))) for i in range(40)]
    held = [3, 11, 12, 25, 39]
    for n, i in enumerate(held):
        words, own = rows[i][1].split(), list(passage)
        if n:
            own[30] = "changed"
            own.insert(50, "more")
        at = rng.randrange(len(words))
        rows[i] = (i, " ".join(words[:at] + own + words[at:]))
    rows += [(50, rows[5][1]), (None, rows[5][1]), (51, None), (52, ""), (50, rows[5][1])]
    docs = documents(spark, rows, clash=True)
    got = substring_dedup.passages(docs).collect()
    # which earlier holder is named depends on who was first in a mapper's slice
    assert {r.doc_id for r in got} == {*held[1:], 50} and all(r.src_id in held or (r.doc_id, r.src_id) == (50, 5) for r in got)
    for i in held[1:]:
        assert max(r.end - r.begin for r in got if r.doc_id == i and r.identity > 0.9) >= 69
    cut = {r.doc_id: r for r in substring_dedup.cut_repeats(documents(spark, rows)).collect()}
    assert len(cut) == len({i for i, _ in rows})
    texts = dict(rows)
    assert cut[3].text == texts[3] and cut[50].text.strip() == "" and cut[7].text == texts[7]
    for i in held[1:]:
        assert len(cut[i].text.split()) in range(len(texts[i].split()) - 72, len(texts[i].split()) - 68) and cut[i].n_chars == len(cut[i].text)


def test_second_copies_are_found_whatever_the_slices(spark):
    rng = random.Random(8)
    passage = " ".join(prose(rng, 60))
    pad = [" ".join(prose(rng, 50)) for _ in range(6)]
    rows = [(1, f"{pad[0]} {passage} {pad[1]}"), (2, f"{pad[2]} {passage} {pad[3]} {passage} {pad[4]}"), (3, pad[5])]
    found = []
    for parts in (1, 3):
        docs = documents(spark, rows).repartitionByRange(parts, "doc_id")
        found.append({tuple(r) for r in substring_dedup.passages(docs).collect()})
    assert found[0] == found[1] and {(x[0], x[1]) for x in found[0]} == {(2, 1)}
    assert {(x[2], x[3]) for x in found[0]} == {(50, 110), (160, 220)}


def test_passages_whose_pieces_have_other_first_holders_are_found(spark):
    rng = random.Random(10)
    passage, lines = prose(rng, 50), [prose(rng, 8) for _ in range(6)]
    joined = [w for line in lines for w in line]

    def around(words):
        return " ".join(prose(rng, 40) + words + prose(rng, 40))

    rows = [(1, around(passage[:25])), (2, around(passage[25:])), (5, around(passage)), (6, around(passage))]
    rows += [(10 + i, around(line)) for i, line in enumerate(lines)] + [(20, around(joined)), (21, around(joined))]
    got = substring_dedup.passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.src_id, r.begin, r.end) for r in got} == {(6, 5, 40, 90), (21, 20, 40, 88)}


def test_near_copies_within_the_identity_are_found(spark):
    rng = random.Random(11)
    cases = [(n, every) for n, every in ((50, 7), (50, 6), (40, 7), (30, 8), (50, 5)) for _ in range(20)]
    rows = []
    for i, (n, every) in enumerate(cases):
        passage = prose(rng, n)
        changed = [f"x{i}y{j}" if j % every == every - 1 and j < n - 1 else w for j, w in enumerate(passage)]
        rows += [(2 * i, " ".join(prose(rng, 60) + passage + prose(rng, 60))), (2 * i + 1, " ".join(prose(rng, 60) + changed + prose(rng, 60)))]
    got = substring_dedup.passages(documents(spark, rows)).collect()
    found = {r.doc_id // 2 for r in got if r.begin < 90 and r.end > 75}
    caught = {c: sum(cases[i] == c for i in found) / 20 for c in dict.fromkeys(cases)}
    assert min(caught.values()) == 1, caught


@pytest.mark.parametrize("gaps", [(40, 40), (40, 30), (16, 16, 16)])
def test_passages_between_other_words_are_found_one_by_one(spark, gaps):
    rng = random.Random(9)
    own, other, want = [], [], []
    for gap in (*gaps, 0):
        words = prose(rng, 32 if 16 in gaps else 55)
        want.append((len(own), len(own) + len(words)))
        own += words + prose(rng, gap)
        other += words + prose(rng, gap)
    got = substring_dedup.passages(documents(spark, [(1, " ".join(other)), (2, " ".join(own))])).collect()
    covered = {w for r in got for w in range(r.begin, r.end)}
    assert all(covered.issuperset(range(*x)) for x in want) and all(r.identity >= substring_dedup.MIN_IDENTITY for r in got)


def test_lines_and_words_said_often_do_not_meet_themselves(spark):
    rng = np.random.default_rng(14)
    # of a word said 60 times in a row only the first and the last seed make couples
    hashes = np.full(60, 7, dtype=np.uint64)
    ((_, key, owner, place),) = substring_dedup._rolled(hashes, np.array([60]), [4])
    at, more = substring_dedup._ends(key, owner, place)
    assert place[at].tolist() == [0, 56] and more.tolist() == [56, -56] and len(substring_dedup._couples(owner[at], place[at])[0]) == 1
    # couples of different kinds and about as far apart meet one row of each earlier document; a common kind does not meet itself
    n = 300
    key, kind, far, asks = np.sort(rng.integers(0, 4, n)), rng.choice([0, 1, 1, 1, 2], n), rng.integers(4, 60, n).astype(np.uint8), rng.random(n) < 0.5
    doc = np.concatenate([np.sort(rng.integers(0, 90, (key == k).sum())) for k in range(4)])
    got = {(a, b) for own, held in substring_dedup._unlike(key, doc, kind, far, asks, 11) for a, b in zip(own.tolist(), held.tolist(), strict=True)}
    fits = lambda i, j: key[i] == key[j] and doc[j] < doc[i] and (kind[i] != kind[j] or kind[i] == 0) and abs(int(far[i]) - int(far[j])) <= 11
    assert got and all(asks[i] and fits(i, j) for i, j in got)
    same = np.zeros(5000, dtype=np.int64)
    assert not sum(len(own) for own, _ in substring_dedup._unlike(same, np.arange(5000), same + 1, same + 9, same == 0, 11))
    # one row of each document: every pair that fits is met
    doc = np.concatenate([np.arange((key == k).sum()) for k in range(4)])
    got = {(a, b) for own, held in substring_dedup._unlike(key, doc, kind, far, asks, 11) for a, b in zip(own.tolist(), held.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) if asks[i] for j in range(n) if fits(i, j)}
    # rows of a large key are sought by what is around them, and none is lost
    base = rng.integers(1, 60, (8, 52)).astype(np.uint16)
    around = base[rng.integers(0, 8, n)]
    for row in around:
        row[rng.integers(0, 52, rng.integers(0, 12))] = 99
        if rng.random() < 0.4:
            cut = rng.integers(0, 20)
            row[cut + 1 : 26] = row[cut : 25].copy()
    pairs = []
    for many in (1 << 30, 2):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring_dedup, "MANY", many)
            pairs.append({(a, b) for own, held in substring_dedup._alike(key, doc, around, asks, 20, 6) for a, b in zip(own.tolist(), held.tolist(), strict=True)})

    def fewest(i, j):
        one, two = ([c for c, _ in substring_dedup._outward(around[i][x], around[j][x], 20, 20)] for x in (slice(0, 26), slice(26, 52)))
        return min(one[x] + two[20 - x] for x in range(21) if x < len(one) and 20 - x < len(two))

    assert pairs[1] <= pairs[0] and all(fewest(i, j) > 6 for i, j in pairs[0] - pairs[1]) and len(pairs[1]) > 100


def test_passages_meet_holders_between_the_first_and_the_last_of_their_pieces(spark):
    rng = random.Random(13)
    rows, want = [], {}

    def around(words):
        return " ".join(prose(rng, 40) + words + prose(rng, 40))

    for case in range(12):
        if case % 2:  # runs of six words
            passage, every = prose(rng, 48), 7
            changed = [f"x{case}y{i}" if i % every == every - 1 else w for i, w in enumerate(passage)]
            pieces = [passage[i : i + 6] for i in range(0, 48, 7)]
        else:  # one run of twelve, and shorter ones than a seed
            passage = prose(rng, 32)
            changed = [f"x{case}y{i}" if i > 11 and i % 4 == 0 else w for i, w in enumerate(passage)]
            pieces = [passage[:12]]
        base = 1000 * case
        rows += [(base + i, around(x)) for i, x in enumerate(pieces)] + [(base + 100, around(passage))]
        rows += [(base + 200 + i, around(x)) for i, x in enumerate(pieces)] + [(base + 300, around(changed))]
        want[base + 300] = base + 100
    got = {r.doc_id: r for r in substring_dedup.passages(documents(spark, rows)).collect()}
    assert {d: r.src_id for d, r in got.items()} == want
    assert all(r.begin <= 41 and r.end >= 70 and r.identity >= substring_dedup.MIN_IDENTITY for r in got.values())


def test_no_surroundings_of_a_passage_are_ruled_out():
    rng = np.random.default_rng(14)
    need, wide = 20, substring_dedup._flank(30, 0.8)
    assert substring_dedup._most(30, 0.8) == 6 and wide == 26
    passed, kept = 0, 0
    for _ in range(400):
        own = rng.integers(1, 40, (2, wide)).astype(np.uint16)
        other = np.zeros_like(own)
        for side in (0, 1):
            words = own[side].tolist()
            for _ in range(rng.integers(0, 5)):
                at = int(rng.integers(0, len(words)))
                words[at : at + 1] = [[], [99], [words[at], 98]][rng.integers(0, 3)]
            words = words[:wide]
            other[side, : len(words)] = words
        costs = [[c for c, _ in substring_dedup._outward(own[i], other[i], need, need)] for i in (0, 1)]
        least = min(costs[0][i] + costs[1][need - i] for i in range(need + 1))
        may = bool(substring_dedup._may_reach(own.reshape(1, -1), other.reshape(1, -1), need, 6)[0])
        assert may or least > 6
        passed += least <= 6
        kept += may
    assert passed > 100 and not substring_dedup._may_reach(own.reshape(1, -1), other[::-1].reshape(1, -1) + 50, need, 6)[0] and kept >= passed


def test_outward_alignment_stops_at_the_edits_that_are_left():
    rng = np.random.default_rng(12)
    for _ in range(200):
        a = rng.integers(0, 5, 20).astype(np.uint32)
        b = np.delete(np.where(rng.random(20) < 0.2, 9, a), rng.integers(0, 20, 2)).astype(np.uint32)
        row, want = list(range(len(b) + 1)), [(0, True)]
        for i, x in enumerate(a.tolist(), 1):
            new = [i]
            for j, y in enumerate(b.tolist(), 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            want.append((min(new), any(x == y and row[j] == min(new) for j, y in enumerate(b.tolist()))))
            row = new
        for most in (0, 3, 6):
            assert substring_dedup._outward(a, b, 20, most) == [x for x in want if x[0] <= most]


def test_a_far_predecessor_does_not_hide_a_near_one():
    assert substring_dedup.chain([(0, 0, 100), (180, 160, 20), (205, 185, 20)]) == [[(0, 0, 100)], [(180, 160, 20), (205, 185, 20)]]


def test_chains_maximise_their_score():
    rng = random.Random(1)
    for _ in range(60):
        runs = sorted({(rng.randrange(0, 120), rng.randrange(0, 120), rng.randrange(5, 15)) for _ in range(7)})
        best = 0.0

        def walk(i, score, runs=runs):
            nonlocal best
            best = max(best, score)
            for j, (p, s, m) in enumerate(runs):
                a, b = p - runs[i][0] - runs[i][2], s - runs[i][1] - runs[i][2]
                if 0 <= a <= substring_dedup.MAX_GAP and 0 <= b <= substring_dedup.MAX_GAP:
                    walk(j, score + m - substring_dedup.GAP_COST * (a + b))

        for i, r in enumerate(runs):
            walk(i, r[2])
        first = substring_dedup.chain(runs)[0]
        score = sum(m for _, _, m in first) - substring_dedup.GAP_COST * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(first, first[1:], strict=False))
        assert score >= best - 1e-9 or any(s + m > 120 for _, s, m in runs)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_leaks_are_found_within_the_budget(spark):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, rng.randrange(12, 40)))) for i in range(20)] + [(97, "Grobnik!"), (98, None), (None, "x " * 60)]
    rows, want = [], set()
    for d in range(60):
        words = " ".join(prose(rng, 50))
        if d % 3 == 0:
            i, t = items[rng.randrange(20)]
            chars = list(t.upper() if d % 2 else t)
            for _ in range(int(len(t.replace(" ", "")) * 0.05)):
                p = rng.randrange(len(chars))
                chars[p : p + 1] = rng.choice([[], ["q"], [chars[p], "z"]])
            words = words + ". " + "".join(chars) + ", " + words[:40]
            want.add((d, i))
        rows.append((d, words))
    got = decontaminate.find(documents(spark, rows + [(None, None), (70, "")], clash=True), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        a = decontaminate.coded(dict(items)[r.item_id])[0].tolist()
        b = decontaminate.coded(dict(rows)[r.doc_id][r.begin : r.end])[0].tolist()
        assert edit_distance(a, b) == r.edits
    kept = decontaminate.drop_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(documents(spark, rows), none).count() == 0


def least_edits(item, text):
    """The fewest edits between an item and any stretch of a text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for y in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != y), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_items_of_every_length_against_brute_force():
    rng = random.Random(21)
    assert decontaminate.EDITS == 0.1
    items = [(n, "".join(rng.choice("abcdefgh") for _ in range(n))) for n in range(3, 41)] + [(99, "?!"), (50, "What is the capital of France?"), (51, "Why?")]
    index = decontaminate.build(items)
    texts = ["So: what is the Capital of france?! Why not, whyever"]
    for n in range(260):
        own = list(dict(items)[3 + n % 38])
        for _ in range(rng.choice([len(own) // 10, rng.randrange(0, 2 + len(own) // 8)])):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["z"], [own[at], "z"]])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
        texts.append(" ".join(words[:6]) + rng.choice([" ", "", ". "]) + "".join(own) + rng.choice([" ", "", "! "]) + " ".join(words[6:]))
    got = {(x[0], x[1]) for x in decontaminate.scan(texts, index)}
    want = set()
    for d, text in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in text.lower())
        for i, item in items:
            flat = "".join(c for c in item.lower() if c.isalnum())
            if 0 < len(flat) < decontaminate.EXACT_BELOW:
                if re.search(r"(?<![a-z0-9])" + r" *".join(flat) + r"(?![a-z0-9])", words):
                    want.add((d, i))
            elif flat:
                if least_edits(flat, words.replace(" ", "")) <= len(flat) // 10:
                    want.add((d, i))
    assert got == want and len(want) > 120 and {(0, 50), (0, 51)} <= got


def test_all_places_of_an_item_are_reported(spark, monkeypatch):
    rng = random.Random(22)
    item, short = " ".join(prose(rng, 20)), "grobnik"
    text = f"{item} {short}. {' '.join(prose(rng, 30))} {item.upper()}. {item} grobnikka {short}"
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)  # several blocks of items
    docs = documents(spark, [(1, text), (2, "none"), (1, text), (3, text + " w" * 200000)])
    got = decontaminate.find(docs, spark.createDataFrame([(7, item), (8, short), (9, item)], "item_id long, text string")).collect()
    places = [m.start() for m in re.finditer(re.escape(item.lower()), text.lower())]
    for doc, times in ((1, 2), (3, 1)):
        for i in (7, 9):
            assert sorted(r.begin for r in got if (r.doc_id, r.item_id) == (doc, i)) == sorted(places * times)
        assert sorted(r.begin for r in got if (r.doc_id, r.item_id) == (doc, 8)) == sorted([m.start() for m in re.finditer(r"grobnik\b", text)] * times)
    assert {r.doc_id for r in got} == {1, 3} and all(r.edits == 0 for r in got)
    monkeypatch.setattr(decontaminate, "MOST_SHARED", 10)
    assert len(decontaminate.scan([text, "x", text], decontaminate.build([(7, item)]))) == 6


def test_banded_alignment_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(40):
        item = rng.integers(1, 5, 40).astype(np.uint8)
        own = item.tolist()
        for _ in range(rng.integers(0, 4)):
            p = int(rng.integers(0, len(own)))
            own[p : p + 1] = [[], [9], [own[p], 9]][rng.integers(0, 3)]
        region = np.array([7] * 6 + own + [7] * 6, dtype=np.uint8)
        found = decontaminate.align(item, region, 6, 4)
        want = min(edit_distance(item.tolist(), region[a:b].tolist()) for a in range(13) for b in range(a + 30, len(region) + 1))
        assert found and found[0] == want


def test_nearest_are_brute_forces(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 32)).astype(np.float32)
    x[100:160] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 32), (940, [float("nan")] * 32), (960, [1.0, None] * 16), (20, x[20].tolist()), (None, x[1].tolist()), (980, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    assert sorted(got) == list(range(0, 700, 20))
    for q in got:
        exact = np.cumsum(y * y[q], axis=1)[:, -1]
        exact[q] = -np.inf
        best = np.lexsort((np.arange(700), -exact))[:20]
        assert [v for _, v, _ in sorted(got[q])] == best.tolist()
        assert np.array_equal([s for _, _, s in sorted(got[q])], exact[best])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert nearest.nearest(few, few.where("vec_id = 0"), 20).count() == 2
    assert nearest.nearest(few.where("false"), few, 20).count() == 0


def test_code_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    got, error = nearest.estimates(q, *nearest.encode(x))
    assert (np.abs(got - q @ x.T) <= error).mean() > 0.999


def whole_text(label):
    """The longest template of a label."""
    return max((t for name, t in licenses.TEMPLATES if name == label), key=len).replace("[", "").replace("]", "").upper()


def licence_rows():
    return ODD + [
        (10, "Released under the MIT License. apache LICENSE, version 2.0 and again under the mit-license"),
        (11, "cc by nc 4.0"),
        (12, "This work is licensed under the GNU General Public License, version 3. All rights reserved."),
        (13, "the mit licence; under the, mit; license"),
        (14, "mit license"),
        (15, "Copyright (c) someone. " + whole_text("isc")),
        (16, "copies all in appear notice permission this and notice copyright above; license mit"),
        (17, "notice shall be included. " + whole_text("mit").replace("SUBLICENSE", "RESELL")),
    ]


def test_licences_against_sql(spark):
    rows = licence_rows()
    got = licenses.scan(documents(spark, rows, clash=True)).drop("places").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(licenses.sql()).fetchall()))
    by = {r.doc_id: r for r in got}
    assert (by[10].n_base, by[10].first_word, by[10].base_labels) == (3, 1, "apache-2,mit")
    assert by[12].labels == "gpl" and by[13].n_base == 1 and by[14].base_labels == "" and by[14].labels == "mit"
    assert (by[15].labels, by[15].score) == ("isc", 1.0) and by[16].labels == "" and by[17].labels == "mit"
    versions = [
        (1, "SPDX-License-Identifier: GPL-3.0-or-later"),
        (2, "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
        (3, "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (4, "Distributed under the Boost Software License, Version 1.0."),
        (5, "All rights reserved."),
        (6, "SPDX-License-Identifier: MIT AND SPDX-License-Identifier: CC0-1.0"),
        (7, "Creative Commons Attribution-NoDerivatives"),
    ]
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in licenses.scan(documents(spark, versions)).collect()}
    assert {i: x[0] for i, x in got.items()} == {1: "gpl-3", 2: "lgpl,lgpl-2.1", 3: "gpl,gpl-3", 4: "bsl-1", 5: "", 6: "cc0,mit", 7: "cc-by-nd"} and got[5][1] == 0 and got[3][1] == 1
    assert licenses.scan(documents(spark, [])).count() == 0


TALK = [
    (1, 0, "user", "Hello there, friend.\nHow are you?\n\nSecond para here."),
    (1, 1, "assistant", "> Hello there, FRIEND.\n> How are  you?\n\nFine."),
    (1, 2, "user", "> > Hello there, friend.\n> > How are you?\n>\n> Fine.\n\nGood!"),
    (1, 3, "user", ">second para here.\nYes\n> unknown text"),
    (2, 0, "user", "> Fine.\nfrom elsewhere"),
    (2, 1, None, None),
    (None, None, "x", "> Fine."),
    (2, 1, None, None),
    (1, 4, "user", "Fine."),
    (1, 5, "u", "> Fine.\n > Good!\nlast"),
    (3, 0, "u", ""),
    (3, 1, "u", ">\n> \n"),
    (1, 6, "a", ">last\nok"),
    (1, 6, "b", "> ok"),
    (1, 7, "a", "> ok\n\ndeep"),
    (1, 900, "a", "> deep"),
    (4, 0, "u", "First of all the plan is good. We could start on Monday morning! Who brings the keys?\nAnother line stands here\n\nNo. Never mind the rest of it."),
    (4, 1, "a", "> We could start on monday morning!\nAgreed."),
    (4, 2, "u", "> another line stands   here\nSeen."),
    (4, 3, "a", "> We could start on Monday morning! Who brings the keys?\nI do."),
    (4, 4, "a", "> No.\nToo short to say where it is from."),
    (4, 5, "a", "> Something else. Who brings the keys?\n> > who brings the keys\nBoth."),
    (5, 0, "u", "> First of all the plan is good. And more.\nfrom elsewhere, by its first sentence"),
    (5, 1, "u", "a long text " + "of many words. " * 3000),
    (5, 2, "u", "> of many words. of many words.\nfar"),
    (5, None, "u", "> Who brings the keys?"),
]


def test_quotes_against_sql(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = quotes.link(df).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TALK)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(quotes.SQL).fetchall()))
    by = {(r.conv_id, r.turn, r.role): r for r in got}
    assert by[1, 2, "user"].parent_turn == 1 and by[1, 2, "user"].thread_turn == 0 and by[1, 2, "user"].body == "Good!"
    assert by[1, 900, "a"].parent_turn == 7 and by[1, 900, "a"].thread_turn == 5 and by[1, 900, "a"].reply_depth == 3
    assert (by[2, 0, "user"].source_conv, by[2, 0, "user"].source_turn) == (1, 1)
    # one sentence, one line, two sentences, one too short, a sentence of a passage and one below it
    assert {t: (r.parent_turn, r.n_linked) for (c, t, _), r in by.items() if c == 4 and t} == {1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (None, 0), 5: (0, 2)}
    assert (by[5, 0, "u"].source_conv, by[5, 0, "u"].source_turn) == (4, 0) and by[5, 2, "u"].parent_turn == 1
    more = df.selectExpr("*", "'x' AS key", "1 AS h", "2 AS found", "'y' AS body", "3 AS depth", "4 AS run")
    assert sorted(map(repr, quotes.link(more).collect())) == sorted(map(repr, got))
    assert quotes.link(df.where("false")).count() == 0


def test_seeds_hash_every_run_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 9, 50, 31)]
    for k, key, owner, place in substring_dedup.seeds(texts, [4, 8, 16, 30]):
        runs = [(i, p, tuple(t.split()[p : p + k])) for i, t in enumerate(texts) for p in range(len(t.split()) - k + 1)]
        assert list(zip(owner.tolist(), place.tolist(), strict=True)) == [r[:2] for r in runs]
        assert len(set(key.tolist())) == len({r[2] for r in runs}) == len({(x, r[2]) for x, r in zip(key.tolist(), runs, strict=True)})
