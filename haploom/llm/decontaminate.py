"""Benchmark decontamination by q-gram lemma filtering.

A place that holds an item with at most e edits shares at least ``L - q + 1 - q * e`` q-grams with it,
all on diagonals (place in the document less place in the item) within e of each other. Shared q-grams
are counted in overlapping diagonal bands two budgets wide; bands that reach the bound are verified by
banded alignment. Where eight letters are too many for an item to share one with a place at its full budget, it is indexed by shorter
q-grams. Items of fewer than 16 letters say little, so they count only where they stand
exactly, as whole words; the shortest, of less than one q-gram, are looked up by all their letters.
Documents are scanned where they are read; nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm.textkit import keyed_texts, slices, tidy

#: Characters in a q-gram, for items that share at least one at their full budget.
Q = 8
#: Edits allowed, as a share of an item's letters and digits.
EDITS = 0.1
#: Items with fewer letters and digits than this must stand exactly, between word borders.
EXACT_BELOW = 2 * Q
#: Characters of benchmark text that are indexed (and sent to executors) at a time: documents are scanned
#: once for benchmarks up to this size, and once more for each such amount beyond it.
BLOCK_CHARS = 4_000_000
#: Shared q-grams that are laid out at a time, if a slice has several texts.
MOST_SHARED = 8_000_000
#: Bits of the table that sorts out most characters at once.
FILTER_BITS = 22

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Codes by code point below U+3000: 0 for what is not compared, else 1 to 255."""
    out = np.zeros(0x3000, dtype=np.uint8)
    for c in range(0x3000):
        if chr(c).isalnum():
            out[c] = c if c < 0x80 else 128 + c % 127
    return out


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes of a text's letters and digits in lower case, their places in the text)."""
    lower = text.lower()
    if len(lower) != len(text):  # some capitals become two characters
        lower = "".join(c.lower()[0] for c in text)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _codes()
    if len(points) and points.max() >= len(table):
        codes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 1 + (points * np.uint32(2654435761) >> np.uint32(24)) % 127 + 127).astype(np.uint8)
    else:
        codes = table[points]
    places = np.flatnonzero(codes)
    return codes[places], places


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at each place, as a number of 64 bits (q up to 8)."""
    n = len(codes) - q + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(q if n > 0 else 0):
        out = (out << np.uint64(8)) | codes[j : n + j]
    return out


@dataclass
class Index:
    """Postings of the q-grams of a block of items; ``others``: the same of items that need a shorter q."""

    q: int
    ids: list[int]
    items: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    #: (letters, ordered distinct numbers of items of so many letters, the ids of each)
    short: list[tuple[int, np.ndarray, list[list[int]]]]
    others: list[Index]


def build(rows: list[tuple[int, str]], edits: float = EDITS) -> Index:
    """Index items; those without letters or digits are nowhere to be found."""
    few: dict[int, dict[int, list[int]]] = {}
    by: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for i, text in rows:
        codes, _ = coded(text or "")
        if len(codes) >= Q:
            budget = allowed(len(codes), edits)
            # e edits leave one of e + 1 pieces as it is, so this q leaves a bound of at least one
            by.setdefault(min(Q, len(codes) // (budget + 1)), []).append((i, codes, budget))
        elif len(codes):
            few.setdefault(len(codes), {}).setdefault(int(qgrams(codes, len(codes))[0]), []).append(i)
    short = [(n, np.array(sorted(x), dtype=np.uint64), [sorted(set(x[k])) for k in sorted(x)]) for n, x in sorted(few.items())]
    index = _postings(by.pop(Q, []), Q, short)
    index.others = [_postings(by[q], q, []) for q in sorted(by)]
    return index


def allowed(letters: int, edits: float = EDITS) -> int:
    """The edit budget of an item of so many letters and digits."""
    return int(letters * edits) if letters >= EXACT_BELOW else 0


def _postings(held: list[tuple[int, np.ndarray, int]], q: int, short: list) -> Index:
    """Postings of (id, codes, budget) by q-grams of one length."""
    ids, items = [x[0] for x in held], [x[1] for x in held]
    lengths = np.array([len(c) for c in items], dtype=np.int64)
    budget = np.array([x[2] for x in held], dtype=np.int64)
    bound = lengths - q + 1 - q * budget
    grams = np.concatenate([qgrams(c, q) for c in items]) if items else np.empty(0, dtype=np.uint64)
    counts = lengths - q + 1
    item = np.repeat(np.arange(len(items), dtype=np.int32), counts)
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if items else np.empty(0, dtype=np.int32)
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    table = np.zeros(1 << FILTER_BITS, dtype=bool)
    table[(distinct * _MIX) >> np.uint64(64 - FILTER_BITS)] = True
    return Index(q, ids, items, budget, bound, distinct, np.append(first, len(grams)), item[order], place[order], table, short, [])


def align(item: np.ndarray, region: np.ndarray, shift: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best place of a whole item in a region, within the budget; else None.

    Only diagonals from ``shift - 2 * budget`` to ``shift + 2 * budget`` are filled: row i of the
    table has the costs of the item's first i codes against regions that end on each diagonal.
    """
    n = len(item)
    if shift >= 0 and shift + n <= len(region) and np.array_equal(region[shift : shift + n], item):
        return 0, shift, shift + n
    low = shift - 2 * budget
    width = 4 * budget + 1
    big = 1 << 20
    steps = np.arange(width)
    padded = np.zeros(len(region) + 2 * (abs(low) + width + n), dtype=np.uint8)
    base = abs(low) + width + n
    padded[base : base + len(region)] = region
    ends = low + steps  # the end in the region of row 0
    cost = np.where((ends >= 0) & (ends <= len(region)), 0, big)
    begin = ends.copy()
    for i in range(1, n + 1):
        at = base + low + i - 1
        same = padded[at : at + width] == item[i - 1]
        new = cost + ~same
        start = begin.copy()
        up = np.append(cost[1:], big) + 1  # an item code without counterpart
        better = up < new
        new[better] = up[better]
        start[better] = np.append(begin[1:], 0)[better]
        ends = low + i + steps
        new[(ends < 0) | (ends > len(region))] = big
        # a region code without counterpart: a run along the row
        along = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == along, steps, 0))
        cost, begin = along + steps, start[source]
    best = int(cost.argmin())
    if cost[best] > budget:
        return None
    return int(cost[best]), int(begin[best]), int(low + n + best)


def _whole(text: str, begin: int, end: int) -> bool:
    """Whether a stretch of a text ends at word borders."""
    return not (begin > 0 and text[begin - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def _short_places(texts: list[str], coded_texts: list[tuple[np.ndarray, np.ndarray]], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Every place of the items that are shorter than a q-gram."""
    for n, numbers, ids in index.short:
        for doc, (codes, own) in enumerate(coded_texts):
            grams = qgrams(codes, n)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(numbers, grams), len(numbers) - 1)
            for place in np.flatnonzero(numbers[at] == grams).tolist():
                begin, end = int(own[place]), int(own[place + n - 1]) + 1
                if _whole(texts[doc], begin, end):
                    for i in ids[at[place]]:
                        yield doc, i, begin, end, 0, 0


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (edits, begin, end, shared), those that overlap none with fewer edits, or as many and before them."""
    out: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for x in sorted(set(found)):
        k = bisect.bisect_left(taken, (x[2], 0))
        if k == 0 or taken[k - 1][1] <= x[1]:
            taken.insert(k, (x[1], x[2]))
            out.append(x)
    return out


def scan(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item id, begin, end, edits, shared q-grams) of each place of each item in each text.

    Places of one item do not overlap: those with the fewest edits stay, then the first.
    """
    coded_texts = [coded(text) for text in texts]
    out = list(_short_places(texts, coded_texts, index))
    for part in (index, *index.others):
        out += _long_places(texts, coded_texts, part)
    return sorted(out)


def _long_places(texts: list[str], coded_texts: list[tuple[np.ndarray, np.ndarray]], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """Places of the items that have q-grams of the index's length."""
    if not index.items:
        return []
    out = []
    parts, places, starts, size = [], [], [], 0
    gap = np.zeros(Q, dtype=np.uint8)
    for codes, own in coded_texts:
        starts.append(size)
        parts += [codes, gap]
        places.append(own)
        size += len(codes) + Q
    all_codes = np.concatenate([*parts, gap[:0]])
    grams = qgrams(all_codes, index.q)
    hits = np.flatnonzero(index.filter[(grams * _MIX) >> np.uint64(64 - FILTER_BITS)])
    at = np.searchsorted(index.grams, grams[hits])
    at[at == len(index.grams)] = 0
    real = index.grams[at] == grams[hits]
    hits, at = hits[real], at[real]
    if not len(hits):
        return []
    n = index.first[at + 1] - index.first[at]
    if n.sum() > MOST_SHARED and len(texts) > 1:
        half = len(texts) // 2
        return _long_places(texts[:half], coded_texts[:half], index) + [(x[0] + half, *x[1:]) for x in _long_places(texts[half:], coded_texts[half:], index)]
    posting = np.repeat(index.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    item = index.item[posting].astype(np.int64)
    diagonal = np.repeat(hits, n) - index.place[posting] + (1 << 14)
    step = index.budget[item] + 1
    band = diagonal // step
    span = np.int64(1) << 40
    keys = np.concatenate([item * span + band, item * span + band - 1])
    order = np.argsort(keys, kind="stable")
    keys, diagonals = keys[order], np.concatenate([diagonal, diagonal])[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(cuts, len(keys)))
    owner = keys[cuts] // span
    full = np.flatnonzero(counts >= index.bound[owner])
    edges = np.array([*starts, size])
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for k in full.tolist():
        which = int(owner[k])
        budget = int(index.budget[which])
        own = diagonals[cuts[k] : cuts[k] + counts[k]] - (1 << 14)
        middle = int(np.median(own))
        doc = int(np.searchsorted(edges, middle + len(index.items[which]) // 2, side="right")) - 1
        if not 0 <= doc < len(texts):
            continue
        a, b = starts[doc], starts[doc] + len(places[doc])
        left = min(max(a, middle - 3 * budget), b)
        right = min(b, middle + len(index.items[which]) + 3 * budget)
        place = align(index.items[which], all_codes[left:right], middle - left, budget)
        if place and place[2] > place[1]:
            begin, end = place[1] + left - a, place[2] + left - a
            if len(index.items[which]) >= EXACT_BELOW or _whole(texts[doc], int(places[doc][begin]), int(places[doc][end - 1]) + 1):
                found.setdefault((doc, which), []).append((place[0], begin, end, int(counts[k])))
    for (doc, which), got in found.items():
        own = places[doc]
        out += [(doc, index.ids[which], int(own[begin]), int(own[end - 1]) + 1, edits, shared) for edits, begin, end, shared in _apart(got)]
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over blocks of items, each of bounded size; rows without an id or a text are left out."""
    items = keyed_texts(benchmark, id_col, text_col).where("doc_id IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(2 * total // BLOCK_CHARS) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) if n > 1 else items
        yield build(sorted((r[0], r[1]) for r in part.collect()))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, begin, end, edits, shared: each place where a document holds an item within the edit budget.

    The budget is ``EDITS`` of an item's letters and digits, rounded down; items of fewer than ``EXACT_BELOW`` must stand
    exactly, as whole words, and items without any are not looked for. Places of one item do not overlap.
    ``begin`` and ``end`` are characters of the text. Null or empty texts hold nothing; repeated rows
    give repeated results; with an empty table on either side the result is empty. An item id that
    comes with several texts is looked for by each of them.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, begin long, end long, edits int, shared int"
    out = None
    for index in _blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    ids = part.column(0).to_pylist()
                    found = scan(part.column(1).to_pylist(), shared.value)
                    if found:
                        columns = list(zip(*found, strict=True))
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                        arrays = [pa.array([ids[i] for i in columns[0]], kinds[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "begin", "end", "edits", "shared"])

        part = keyed_texts(docs, id_col, text_col).mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    names, schema = docs.columns, docs.schema
    for index in _blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    texts = [t or "" for t in part.column(names.index(text_col)).to_pylist()]
                    leaks = {x[0] for x in scan(texts, shared.value)}
                    yield part.filter(pa.array([i not in leaks for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
