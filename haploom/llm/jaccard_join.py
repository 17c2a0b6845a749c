"""N-gram Jaccard join by universe partitions and the pigeonhole principle.

Sets of shingles are grouped into size bands. In a band, two sets that are similar enough differ in at
most H elements; tokens are hashed into H + 1 + S segments, so that two similar sets agree in a
segment, even if each prober leaves out its S dearest ones. Each set indexes its subset of every
segment, and of small ones also what remains after one deletion. A prober may leave out further dear
segments (those all of whose tokens many documents hold, and empty ones) if it makes up for each by
one cheap segment for which it also accepts one deletion on either side: that segment counts for two.
What shares a signature is compared exactly.

Equal sets are one *class* and take part once. In a signature's group of up to ``SMALL`` classes all
pairs are candidates. Larger groups are gone through once more: shingles that several of a few of their
members share are *frequent*, and are left out of a second, finer partition. A class with more than H
non-empty segments of the others finds all that is similar to it by these, which few unrelated classes
share. What has too few rare shingles for that (a cluster of near copies), and what still meets in a
large group, is compared in blocks: each class has a *home*, the largest group it is in, and visits the
homes of those it shares a group with. A home's members are compared with one another and with its
visitors in blocks of bounded bytes, all sets of two blocks at a time, by products of their 0/1
matrices; only counts of links and a forest that joins what is linked leave a task. Every pair is
compared in one place, so links are counted exactly and none is lost, and copies are never expanded
into pairs of rows. (To count the links within a cluster of n different texts takes their n squared
comparisons, whatever the method; they are dealt to tasks in blocks.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haploom.llm.bitmaps import bitmap, has_bits, set_bits
from haploom.llm.components import components
from haploom.llm.shingles import mix, set_class, shingle_sets
from haploom.llm.textkit import BUCKETS_PER_PARTITION, grouped, keyed_texts, slices, tidy
from haploom.session import shuffle_partitions, staged

#: Largest group of which all pairs are candidates; larger ones are compared in blocks.
SMALL = 24
#: Classes and shingles in a block at most, as far as hashing spreads them evenly; one set is never split.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 17
#: Members of a large group that tell its frequent shingles: those that half of these have.
TELLING = 8
#: Columns of the 0/1 matrices that are multiplied at a time.
COLUMNS = 2048
#: Buckets of the count vectors that bound a distance.
BUCKETS = 256
#: Texts handled together by a mapper.
SLICE = 1024
#: From so many texts of a slice on, that hold a token, it is dear.
DEAR = 6


class Bands:
    """Size bands: sets of a band can only be similar to sets of the same, the next or the last band."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, tops[-1] * den // num))
        self.tops = np.array(tops, dtype=np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def most_apart(self, band: int) -> int:
        """H: elements in which two similar sets of at most this band can differ."""
        return int(2 * int(self.tops[band]) * (self.den - self.num) // (self.den + self.num))

    def segments(self, band: int) -> tuple[int, int]:
        """(H + 1 + S, S)."""
        h = self.most_apart(band)
        spare = 1 + h // 40
        return h + 1 + spare, spare


def signatures(own: np.ndarray, band: int, bands: Bands, low: bool, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, flags) of one set in one band's partition.

    Flags: 1 a deletion, 2 the owner probes this segment, 4 it accepts one deletion here, 8 the owner
    is of the lower band. ``spread``: texts of the slice that hold each token, an estimate of cost.
    """
    m, spare = bands.segments(band)
    token = mix(own, 1000 + band)
    segment = ((token >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    name = mix(token, 5)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, segment, name)
    count = np.bincount(segment, minlength=m)
    cost = np.full(m, 1 << 30, dtype=np.int64)
    np.minimum.at(cost, segment, spread)
    cost[count == 0] = 1 << 30
    depth = np.zeros(m, dtype=np.int8)  # -1 left out, 0 exact, 1 with one deletion
    order = np.argsort(-cost, kind="stable")
    depth[order[:spare]] = -1
    dear = [i for i in order[spare:].tolist() if cost[i] >= DEAR]
    if dear:
        cheap = np.flatnonzero((count == 2) & (cost < DEAR) & (depth == 0))[: len(dear)]
        depth[cheap] = 1
        depth[dear[: len(cheap)]] = -1
    number = np.arange(m, dtype=np.uint64)
    base = 8 if low else 0
    exact = mix(sums + number * np.uint64(0xD6E8FEB86659FD93), 2000 + band)
    flags = (base + 2 * (depth >= 0) + 4 * (depth == 1)).astype(np.uint8)
    part = np.flatnonzero((count[segment] == 3) | (depth[segment] == 1))
    if len(part):
        at = segment[part]
        less = mix(sums[at] - name[part] + number[at] * np.uint64(0xD6E8FEB86659FD93), 2000 + band)
        exact = np.concatenate([exact, less])
        flags = np.concatenate([flags, (base + 1 + 4 * (depth[at] == 1)).astype(np.uint8)])
    return exact, flags


def bucket_counts(own: np.ndarray) -> bytes:
    """How many tokens fall into each of ``BUCKETS`` buckets, modulo 256.

    Two counts that are close stay as close modulo 256, so the shorter way around is a lower bound.
    """
    return np.bincount((mix(own, 3) >> np.uint64(56)).astype(np.int64), minlength=BUCKETS).astype(np.uint8).tobytes()


def _bucket_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the elements in which sets differ, from rows of their bucket counts."""
    return np.abs((x - y).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)


def _large(sig: np.ndarray, own: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Which rows of a slice need not meet others: those beyond ``SMALL`` + 1 classes of one signature.

    What stays makes the group a large one wherever it meets; those that probe stay first.
    """
    order = np.lexsort((own, flag & 6 == 0, sig))
    new = np.concatenate([[True], sig[order][1:] != sig[order][:-1]])
    first = np.flatnonzero(new)
    fresh = new | np.concatenate([[True], own[order][1:] != own[order][:-1]])
    upto = np.cumsum(fresh)
    rank = upto - np.repeat(upto[first], np.diff(np.append(first, len(order))))
    out = np.zeros(len(sig), dtype=bool)
    # a class may have rows in both parts of the order, so twice as many are left
    out[order] = rank > 2 * SMALL + 1
    return out


def _index(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures of each slice's new classes, dealt to partitions by signature: for each partition
    one row of packed arrays. Of signatures that very many of a slice have, most classes are named as
    members of a large group at once (a row without sizes), so that no task gets all of them."""
    bands = Bands(num, den)
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, SLICE):
            sets = shingle_sets(part.column(1).to_pylist(), k)
            names = [set_class(s) if len(s) else 0 for s in sets]
            distinct, back, df = np.unique(np.concatenate([*sets, np.empty(0, dtype=np.uint64)]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(s) for s in sets])
            sigs, flags, owner, classes = [], [], [], []
            for i, own in enumerate(sets):
                if not len(own) or names[i] in seen:
                    continue
                seen.add(names[i])
                spread = df[back[ends[i] - len(own) : ends[i]]]
                band = bands.of(len(own))
                for scheme in (band, band + 1):
                    if bands.most_apart(scheme) == 0:
                        continue
                    s, f = signatures(own, scheme, bands, scheme > band, spread)
                    sigs.append(s)
                    flags.append(f)
                    owner.append(np.full(len(s), len(classes), dtype=np.int64))
                classes.append((names[i], len(own)))
            if sigs:
                yield _dealt(classes, np.concatenate(sigs), np.concatenate(owner), np.concatenate(flags), parts)


def _dealt(classes: list[tuple[int, int]], sig: np.ndarray, own: np.ndarray, flag: np.ndarray, parts: int, common: list[int] | None = None) -> pa.RecordBatch:
    """Signatures of the classes (name, size) of a slice, packed by partition.

    Rows without sizes name members of large groups, or classes in ``common`` as members of group -1.
    """
    name = np.array([c[0] for c in classes], dtype=np.int64)
    size = np.array([c[1] for c in classes], dtype=np.int32)
    target = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    rows: list[tuple] = []
    if common:
        rows.append((common[0] % parts, np.array(common, dtype=np.int64).tobytes(), None, np.full(len(common), -1, dtype=np.int64).tobytes(), None, None))
    large = _large(sig, own, flag) if len(sig) else np.zeros(0, dtype=bool)
    if large.any():
        group = _group(target[large], sig[large])
        rows.append((int(name[0]) % parts, name[own[large]].tobytes(), None, group.tobytes(), None, None))
    rest = np.flatnonzero(~large)
    order = rest[np.argsort(target[rest], kind="stable")]
    cuts = np.searchsorted(target[order], np.arange(parts + 1))
    for p in range(parts):
        mine = order[cuts[p] : cuts[p + 1]]
        if len(mine):
            there, number = np.unique(own[mine], return_inverse=True)
            rows.append((p, name[there].tobytes(), size[there].tobytes(), sig[mine].astype(np.uint32).tobytes(), number.astype(np.uint16).tobytes(), flag[mine].tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["p", "classes", "sizes", "sigs", "owners", "flags"])


def rare_signatures(rare: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, bool]:
    """Signatures of the non-empty segments of a set's rare shingles, and whether they are enough: more
    than a similar set can change."""
    h = bands.most_apart(band)
    m = 2 * h + 2
    token = mix(rare, 5000 + band)
    segment = ((token >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, segment, mix(token, 5))
    held = np.unique(segment)
    return mix(sums[held] + held.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 6000 + band), len(held) > h


def _index_rare(batches: Iterator[pa.RecordBatch], num: int, den: int, parts: int, frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Signatures of the rare shingles of classes (node, set); those with too few are named as common."""
    bands = Bands(num, den)
    for batch in batches:
        for part in slices(batch, SLICE):
            sigs, flags, owner, classes, common = [], [], [], [], []
            for name, raw in zip(part.column("node").to_pylist(), part.column("set").to_pylist(), strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                band = bands.of(len(own))
                rare = own[~has_bits(frequent.value, own)]
                made = [(b, *rare_signatures(rare, b, bands)) for b in (band, band + 1) if bands.most_apart(b)]
                enough = all(x for _, _, x in made)
                if not enough:
                    common.append(name)
                for b, s, _ in made:
                    sigs.append(s)
                    flags.append(np.full(len(s), 8 * (b > band) + 2 * enough, dtype=np.uint8))
                    owner.append(np.full(len(s), len(classes), dtype=np.int64))
                classes.append((name, len(own)))
            if classes:
                yield _dealt(classes, *(np.concatenate([*x, np.empty(0, dtype=t)]) for x, t in ((sigs, np.uint64), (owner, np.int64), (flags, np.uint8))), parts, common)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The shingles that at least half of some members of each group share."""
    for batch in batches:
        for sets in batch.column("sets").to_pylist():
            shingle, n = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in sets]), return_counts=True)
            yield shingle[2 * n >= len(sets)]


def _group(p: np.ndarray | int, sig: np.ndarray) -> np.ndarray:
    """The name of a signature: its partition and its low bits, which are all that is sent of it."""
    return (np.asarray(p).astype(np.uint64) << np.uint64(32) | sig & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pairs(batches: list[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs and the members of large groups: (a, b, null) and (class, null, group)."""
    got: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if row[2] is None:
                own = pa.array(np.frombuffer(row[1], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int64()), pa.array(np.frombuffer(row[3], dtype=np.int64))], names=["a", "b", "g"])
                continue
            number = np.frombuffer(row[4], dtype=np.uint16)
            got[0].append(_group(row[0], np.frombuffer(row[3], dtype=np.uint32).astype(np.uint64)))
            got[1].append(np.frombuffer(row[1], dtype=np.int64)[number])
            got[2].append(np.frombuffer(row[2], dtype=np.int32)[number])
            got[3].append(np.frombuffer(row[5], dtype=np.uint8))
    if not got[0]:
        return
    columns = []
    for x in got[:4]:
        columns.append(np.concatenate(x))
        x.clear()
    order = np.lexsort((columns[1], columns[0]))
    for i in range(4):
        columns[i] = columns[i][order]
    sig, name, size, flag = columns
    del columns, order
    # rows of one class and signature (from several mappers) become one
    first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]) | ((flag[1:] ^ flag[:-1]) & 9 > 0)])
    group_of = np.cumsum(first) - 1
    merged = np.zeros(int(first.sum()), dtype=np.uint8)
    np.bitwise_or.at(merged, group_of, flag)
    sig, name, size, flag = sig[first], name[first], size[first], merged
    cuts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(cuts, len(sig)))
    asked = np.bitwise_or.reduceat(flag, cuts)
    useful = (length > 1) & (asked & 6 > 0)
    group = np.repeat(np.arange(len(cuts)), length)
    small = (useful & (length <= SMALL))[group]
    pairs = []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        fits = (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]).astype(np.int64)) & (name[x] != name[y])
        x, y = name[x[fits]], name[y[fits]]
        pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

    for step in range(1, SMALL):
        x = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(group) > step else np.empty(0, dtype=np.int64)
        if not len(x):
            break
        y = x + step
        fx, fy = flag[x], flag[y]
        both = (fx | fy) & 1 == 0
        one = (fx ^ fy) & 1 == 1
        ok = ((both & ((fx | fy) & 2 > 0)) | (one & ((fx | fy) & 4 > 0))) & (fx & fy & 8 == 0)
        add(x[ok], y[ok])
    big = np.flatnonzero(useful & (length > SMALL))
    members: list[tuple[np.ndarray, np.ndarray]] = []
    for g in big.tolist():
        own = np.arange(cuts[g], cuts[g] + length[g])
        distinct, at = np.unique(name[own], return_index=True)
        if len(distinct) < 2:
            continue
        own = own[at]
        members.append((distinct, np.full(len(distinct), int(sig[cuts[g]]), dtype=np.int64)))
    found = np.unique(np.concatenate([*pairs, np.empty((0, 2), dtype=np.int64)]), axis=0)
    for at in range(0, len(found), 50_000):
        x = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64())], names=["a", "b", "g"])
    for own, g in members:
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(g)], names=["a", "b", "g"])


def _apart(num: int, den: int, size_x, size_y):
    """Elements in which similar sets of these sizes can differ."""
    return (size_x + size_y) * (den - num) // (den + num)


def _bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both count vectors, those whose vectors do not rule them out."""
    for batch in batches:
        a, b, na, nb, va, vb = (batch.column(i) for i in range(6))
        if not batch.num_rows:
            continue
        x = np.frombuffer(b"".join(va.to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)
        y = np.frombuffer(b"".join(vb.to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)
        n, m = np.asarray(na).astype(np.int64), np.asarray(nb).astype(np.int64)
        keep = _bucket_distance(x, y) <= _apart(num, den, n, m)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every one of ``b``.

    Shingles that many sets have are columns of 0/1 matrices, which are multiplied; the others, in few
    pairs of sets each, are counted pair by pair.
    """
    sizes = [np.array([len(s) for s in x]) for x in (a, b)]
    _, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = int(sizes[0].sum())
    side = [number[:cut], number[cut:]]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    count = [np.bincount(x, minlength=int(number.max()) + 1) for x in side]
    both = count[0] * count[1]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    column = np.full(len(both), -1)
    common = np.flatnonzero(both > 64)
    for at in range(0, len(common), COLUMNS):
        some = common[at : at + COLUMNS]
        column[:] = -1
        column[some] = np.arange(len(some))
        dense = []
        for x, own, n in zip(side, owner, (len(a), len(b)), strict=True):
            here = column[x] >= 0
            m = np.zeros((n, len(some)), dtype=np.float32)
            m[own[here], column[x[here]]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    rare = (both > 0) & (both <= 64)
    left, right = ((x[m], own[m]) for x, own, m in zip(side, owner, (rare[side[0]], rare[side[1]]), strict=True))
    order = np.argsort(right[0], kind="stable")
    begin = np.searchsorted(right[0][order], left[0])
    times = count[1][left[0]]
    if len(times):
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        x = np.repeat(left[1], times) * len(b) + right[1][order][np.repeat(begin, times) + step]
        out += np.bincount(x, minlength=out.size).reshape(out.shape)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row that each row and each column of a 0/1 matrix is connected with (columns without any: -1)."""
    rows, columns = np.arange(len(linked)), np.full(linked.shape[1], -1)
    none = len(linked)
    while True:
        low = np.where(linked, rows[:, None], none).min(axis=0)
        columns = np.where(low == none, -1, low)
        again = np.minimum(rows, np.where(linked, low[None, :], none).min(axis=1))
        again = again[again]
        if np.array_equal(again, rows):
            return rows, columns
        rows = again


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of packed arrays for each block, from rows sorted by (home, visiting, block)."""
    held: list[tuple[int, bytes]] = []
    key = None

    def packed() -> pa.RecordBatch:
        names, raws = zip(*held, strict=True)
        arrays = (np.array(names, dtype=np.int64), np.array([len(r) // 8 for r in raws], dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays), pa.array([b"".join(raws)], pa.binary())], names=["home", "visiting", "block", "nodes", "sizes", "sets"])

    for batch in batches:
        for home, visiting, block, node, own in zip(*(batch.column(c).to_pylist() for c in ("home", "visiting", "block", "node", "set")), strict=True):
            if key != (home, visiting, block) and held:
                yield packed()
                held = []
            key = (home, visiting, block)
            held.append((node, own))
    if held:
        yield packed()


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(class, root, links) of the classes that link within pairs of blocks, one pair at a time.

    Rows come sorted by (home, i, visiting, j), the two blocks of a pair next to each other, or one block
    that is compared with itself.
    """

    def emit(blocks: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
        (names, own), (others, there) = blocks[0], blocks[-1]
        both = _shared(own, there)
        n, m = (np.array([len(s) for s in x], dtype=np.float64) for x in (own, there))
        linked = (den * both >= num * (n[:, None] + m[None, :] - both)) & (names[:, None] != others[None, :])
        # within one block rows and columns are the same sets
        rows, columns = _forest(linked | np.eye(len(own), dtype=bool) if len(blocks) == 1 else linked)
        found = [(names, rows, linked.sum(axis=1))]
        if len(blocks) == 2:
            found.append((others, columns, linked.sum(axis=0)))
        node, root, links = (np.concatenate([x[i] for x in found]) for i in range(3))
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(names[root[some]]), pa.array(links[some].astype(np.int64))], names=["node", "root", "links"])

    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    key = None
    for batch in batches:
        for home, i, visiting, j, nodes, sizes, sets in zip(*(batch.column(c).to_pylist() for c in ("home", "i", "visiting", "j", "nodes", "sizes", "sets")), strict=True):
            if key != (home, i, visiting, j) and held:
                yield emit(held)
                held = []
            key = (home, i, visiting, j)
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32))
            held.append((np.frombuffer(nodes, dtype=np.int64), np.split(np.frombuffer(sets, dtype=np.uint64), ends[:-1])))
    if held:
        yield emit(held)


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The packed sets of classes, from rows with a text that may be one of theirs."""
    for batch in batches:
        for part in slices(batch, SLICE):
            sets = shingle_sets(part.column("text").to_pylist(), k)
            own = [(n, s.tobytes()) for n, s in zip(part.column("node").to_pylist(), sets, strict=True) if len(s) and set_class(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], names=["node", "set"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts whose sets' similarity reaches num / den."""
    for batch in batches:
        for part in slices(batch, 512):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts: dict[str, int] = {}
            sides = [[texts.setdefault(t, len(texts)) for t in part.column(c).to_pylist()] for c in (2, 3)]
            sets = shingle_sets(list(texts), k)
            names = [set_class(s) if len(s) else 0 for s in sets]
            out = []
            for x, y, i, j in zip(a, b, *sides, strict=True):
                if names[i] == x and names[j] == y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


INDEX = "p int, classes binary, sizes binary, sigs binary, owners binary, flags binary"


def _telling(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of a few members of each large group."""
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("node"), "node"))).where(F.col("r") <= TELLING)
    return first.join(sets, "node").groupBy("g").agg(F.collect_list("set").alias("sets")).select("sets")


def _visits(members: DataFrame) -> DataFrame:
    """home, node, visiting: where the members (node, g) of large groups are compared.

    Two classes that share a group have homes in it each; the one with the greater home visits the other's.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    homes = staged(members.join(sizes, "g").groupBy("node").agg(F.max(F.struct("size", "g")).alias("home")).select("node", F.col("home.g").alias("home")), "homes")
    placed = members.join(homes, "node")
    # a home is no smaller than any group of its members, so a group has no more homes than the root of all memberships
    of_groups = placed.select("g", "home").distinct().groupBy("g").agg(F.sort_array(F.collect_list("home")).alias("others"))
    met = placed.join(of_groups, "g").groupBy("node", "home").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    visiting = met.select(F.explode(F.filter("others", lambda x: x < F.col("home"))).alias("home"), "node")
    return staged(homes.select("home", "node", F.lit(False).alias("visiting")).union(visiting.select("home", "node", F.lit(True))), "visits")


def _compared(visits: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) that join what is linked within homes, and (node, links)."""
    sized = visits.join(classes.select("node", "n"), "node")
    kinds = sized.groupBy("home", "visiting").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    plan = staged(kinds.groupBy("home").agg(F.max(F.when(~F.col("visiting"), blocks)).alias("nm"), F.coalesce(F.max(F.when(F.col("visiting"), blocks)), F.lit(0)).alias("nv")), "blocks")
    of = F.pmod(F.xxhash64("node"), F.when(F.col("visiting"), F.col("nv")).otherwise(F.col("nm"))).cast("int")
    dealt = visits.join(plan, "home").select("home", "visiting", of.alias("block"), "node").join(sets, "node")
    dealt = dealt.repartition(parts, "home", "visiting", "block").sortWithinPartitions("home", "visiting", "block")
    packed = staged(dealt.select("home", "visiting", "block", "node", "set").mapInArrow(tidy(_pack), "home long, visiting boolean, block int, nodes binary, sizes binary, sets binary"), "packed")
    # a block of members meets every block of members and of visitors; a block of visitors every block of members
    with_members = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda x: F.struct(F.least(x, "block").alias("i"), F.lit(False).alias("v"), F.greatest(x, "block").alias("j")))
    with_visitors = F.when(F.col("nv") > 0, F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda x: F.struct(F.col("block").alias("i"), F.lit(True).alias("v"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,v:boolean,j:int>>"))
    as_visitors = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda x: F.struct(x.alias("i"), F.lit(True).alias("v"), F.col("block").alias("j")))
    met = packed.join(plan, "home").withColumn("pair", F.explode(F.when(F.col("visiting"), as_visitors).otherwise(F.concat(with_members, with_visitors))))
    met = met.select("home", F.col("pair.i").alias("i"), F.col("pair.v").alias("v"), F.col("pair.j").alias("j"), F.col("visiting").alias("from"), "block", "nodes", "sizes", "sets")
    met = met.repartition(parts, "home", "i", "v", "j").sortWithinPartitions("home", "i", "v", "j", "from", "block")
    got = staged(met.select("home", "i", F.col("v").alias("visiting"), "j", "nodes", "sizes", "sets").mapInArrow(tidy(lambda it: _compare(it, num, den)), "node long, root long, links long"), "compared")
    return got.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), got.select("node", "links")


def similar_groups(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class, component_id, n_links for every row.

    Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of k-word shingles;
    ``component_id`` is the smallest doc_id reachable by links, itself included. ``class`` names equal
    sets; ``n_links`` counts the other classes that a class links with. Texts without words have n_shingles 0
    and are linked with nothing, as are rows without an id (their component_id is null). Repeated rows
    stay; a doc_id with several texts takes part with each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = BUCKETS_PER_PARTITION * parts
    texts = keyed_texts(docs, id_col, text_col)
    with_id = texts.where("doc_id IS NOT NULL")

    def name_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                sets = shingle_sets(part.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()), pa.array([bucket_counts(s) for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "class", "vector"],
                )

    named = staged(texts.mapInArrow(tidy(name_all), "doc_id long, n_shingles long, class long, vector binary"), "named")
    classes = (
        named.where("class IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("class").alias("node"))
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("vector").alias("vector"))
    )
    classes = staged(classes, "classes")
    index = with_id.mapInArrow(tidy(lambda it: _index(it, k, num, den, buckets)), INDEX)
    # several buckets of signatures come to one task; it holds one of them at a time
    dealt = index.repartition(parts, "p").sortWithinPartitions("p")
    found = staged(dealt.mapInArrow(tidy(lambda it: (x for own in grouped(it) for x in _pairs(own, num, den))), "a long, b long, g long"), "candidates")

    def side(letter: str) -> DataFrame:
        return classes.select(F.col("node").alias(letter), F.col("n").alias(f"n{letter}"), F.col("vector").alias(f"v{letter}"), F.col("doc_id").alias(f"d{letter}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs of classes whose texts bear them out."""
        whole = with_id.select(F.col("doc_id"), F.col("text"))
        kept = pairs.join(side("a").select("a", "da"), "a").join(side("b").select("b", "db"), "b")
        left = kept.join(whole.select(F.col("doc_id").alias("da"), F.col("text").alias("ta")), "da")
        both = left.join(whole.select(F.col("doc_id").alias("db"), F.col("text").alias("tb")), "db")
        return staged(both.select("a", "b", "ta", "tb").mapInArrow(tidy(lambda it: _verify(it, k, num, den)), "a long, b long").distinct(), "verified")

    pairs = found.where("g IS NULL").select("a", "b")
    members = staged(found.where("g IS NOT NULL").select(F.col("a").alias("node"), "g").distinct(), "members")
    sets = None
    if not members.isEmpty():
        asked = members.select("node").distinct().join(classes.select("node", "doc_id"), "node")
        sets = staged(asked.join(with_id, "doc_id").select("node", "text").mapInArrow(tidy(lambda it: _set_rows(it, k)), "node long, set binary").dropDuplicates(["node"]), "sets")
        frequent = bitmap(_telling(members, sets).mapInArrow(tidy(lambda it: set_bits(_frequent(it))), "w int, bits long"))
        again = sets.mapInArrow(tidy(lambda it: _index_rare(it, num, den, buckets, frequent)), INDEX).repartition(parts, "p").sortWithinPartitions("p")
        second = staged(again.mapInArrow(tidy(lambda it: (x for own in grouped(it) for x in _pairs(own, num, den))), "a long, b long, g long"), "candidates")
        pairs = pairs.union(second.where("g IS NULL").select("a", "b"))
        common = second.where("g = -1").select(F.col("a").alias("node")).distinct()
        # names of groups of the second partition do not clash with those of the first
        more = second.where("g IS NOT NULL AND g <> -1").select(F.col("a").alias("node"), (-2 - F.col("g")).alias("g")).distinct()
        members = staged(members.join(common, "node", "left_semi").union(more), "members")
        members = members.join(members.groupBy("g").count().where("count > 1").select("g"), "g", "left_semi").select("node", "g")
    candidates = pairs.distinct()
    joined, counted = None, None
    if sets is not None and not members.isEmpty():
        visits = _visits(members)
        joined, counted = _compared(visits, classes, sets, num, den, parts)
        homes = visits.where("NOT visiting").select("node", "home")
        at = candidates.join(homes.select(F.col("node").alias("a"), F.col("home").alias("ha")), "a", "left").join(homes.select(F.col("node").alias("b"), F.col("home").alias("hb")), "b", "left")
        # what both blocks of one home compare is not compared once more
        later = F.col("ha") >= F.col("hb")
        at = at.withColumn("node", F.when(later, F.col("a")).otherwise(F.col("b"))).withColumn("home", F.when(later, F.col("hb")).when(~later, F.col("ha")))
        candidates = at.join(visits.select("node", "home"), ["node", "home"], "left_anti").select("a", "b")
    measured = candidates.join(side("a").drop("da"), "a").join(side("b").drop("db"), "b").select("a", "b", "na", "nb", "va", "vb")
    links = verified(staged(measured.mapInArrow(tidy(lambda it: _bounded(it, num, den)), "a long, b long"), "bounded"))
    counts = links.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("links")).union(links.select("b", F.lit(1).cast("long")))
    if joined is not None:
        links, counts = links.union(joined), counts.union(counted)
    roots = components(links)
    counts = counts.groupBy("node").agg(F.sum("links").alias("n_links"))
    placed = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(first, "root").join(counts, "node", "left").select(F.col("node").alias("class"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (
        named.select("doc_id", "n_shingles", "class")
        .join(staged(placed, "placed"), "class", "left")
        .select(
            "doc_id",
            "n_shingles",
            "class",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
