"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is the set of distinct words (pattern matches) of the rows that a task holds. An inverted
index leads from a token pair to the word positions where it stands; merges are applied in rank order
over all those words together, and each merge touches only the two neighbours of a merged pair. A
word's tokens depend on that word alone, so shards of the corpus give the ids that one replay over
the whole corpus would, and no row is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haploom.llm.textkit import Numbers, keyed_texts, pretokenizer, slices, tidy

#: Words whose ids a Python worker keeps between batches; others are replayed again.
MEMO_WORDS = 500_000
#: Words replayed together at most; bounds the index.
REPLAY_WORDS = 250_000
#: Bytes of text handled together at most, but for single longer texts.
SHARD_BYTES = 12 << 20
#: Words longer than this are replayed but not kept.
MEMO_WORD_CHARS = 64


#: Bits of an id in the key of a pair.
ID_BITS = 21
#: From so many positions on, a merge is applied by array operations.
MANY = 24


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: token bytes, and the rank of each pair that joins to a token.

    ``keys`` (sorted) and ``values`` are the same pairs as ``pairs``, for lookups of whole arrays.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        if len(self.tokens) >= 1 << ID_BITS:
            raise ValueError("the vocabulary has too many ids")
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    self.pairs[left << ID_BITS | right] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; -1 where it is no token or a side is no token."""
        key = left.astype(np.int64) << ID_BITS | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once in a Python process."""
    return Vocabulary(path)


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges in rank order over all words: the ids of all words, and where each word ends.

    Words stand one after the other in one array, parted by a sentinel. ``index`` maps a rank to the
    positions of left tokens, ``ranks`` holds the rank that a position's pair has now, so that places
    which other merges have changed are known as stale. A heap yields the ranks in order.
    """
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    size = len(raw) + len(words) + 1
    tok = np.full(size, -1, dtype=np.int64)
    own = np.arange(len(raw)) + 1 + np.repeat(np.arange(len(words)), lengths)
    tok[own] = v.byte_ids[raw]
    nxt = np.arange(1, size + 1, dtype=np.int64)
    prv = np.arange(-1, size - 1, dtype=np.int64)
    ranks = np.full(size, -1, dtype=np.int64)
    ranks[:-1] = v.ranks_of(tok[:-1], tok[1:])
    places = np.flatnonzero(ranks >= 0)
    places = places[np.argsort(ranks[places], kind="stable")]
    index: dict[int, list] = {}

    def enter(at: np.ndarray) -> None:
        """Put positions, sorted by rank, in the index."""
        if not len(at):
            return
        r = ranks[at]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        begins = [0, *cuts.tolist()]
        finishes = [*begins[1:], len(at)]
        for rank, x, y in zip(r[begins].tolist(), begins, finishes, strict=True):
            got = index.get(rank)
            if got is None:
                index[rank] = [at[x:y]]
                heappush(heap, rank)
            else:
                got.append(at[x:y])

    heap: list[int] = []
    enter(places)
    tok_m, nxt_m, prv_m, ranks_m = memoryview(tok), memoryview(nxt), memoryview(prv), memoryview(ranks)
    find = v.pairs.get
    while heap:
        rank = heappop(heap)
        chunks = index.pop(rank)
        n = sum(1 if isinstance(c, int) else len(c) for c in chunks)
        if n < MANY:
            flat: list[int] = []
            for c in chunks:
                if isinstance(c, int):
                    flat.append(c)
                else:
                    flat += c.tolist()
            if n > 1:
                flat.sort()
            for i in flat:
                if ranks_m[i] != rank:
                    continue
                j = nxt_m[i]
                k = nxt_m[j]
                tok_m[i] = rank
                tok_m[j] = -1
                ranks_m[j] = -1
                nxt_m[i] = k
                prv_m[k] = i
                right = tok_m[k]
                r = find(rank << ID_BITS | right, -1) if right >= 0 else -1
                ranks_m[i] = r
                if r >= 0:
                    got = index.get(r)
                    if got is None:
                        index[r] = [i]
                        heappush(heap, r)
                    else:
                        got.append(i)
                h = prv_m[i]
                left = tok_m[h]
                if left >= 0:
                    r = find(left << ID_BITS | rank, -1)
                    ranks_m[h] = r
                    if r >= 0:
                        got = index.get(r)
                        if got is None:
                            index[r] = [h]
                            heappush(heap, r)
                        else:
                            got.append(h)
            continue
        at = np.concatenate([np.array([c]) if isinstance(c, int) else c for c in chunks])
        at = at[ranks[at] == rank]
        if len(chunks) > 1:
            at = np.unique(at)
        if not len(at):
            continue
        after = nxt[at]
        touching = np.concatenate([[False], after[:-1] == at[1:]])
        if touching.any():  # of pairs that share a token, the first, third ... are merged
            k = np.arange(len(at))
            first = np.maximum.accumulate(np.where(touching, -1, k))
            keep = (k - first) % 2 == 0
            at, after = at[keep], after[keep]
        beyond = nxt[after]
        before = prv[at]
        tok[at] = rank
        tok[after] = -1
        ranks[after] = -1
        nxt[at] = beyond
        prv[beyond] = at
        ranks[at] = v.ranks_of(tok[at], tok[beyond])
        ranks[before] = v.ranks_of(tok[before], tok[at])
        changed = np.concatenate([at, before])
        r = ranks[changed]
        changed = changed[r >= 0]
        enter(changed[np.argsort(ranks[changed], kind="stable")])
    alive = tok[own] >= 0
    return tok[own][alive], np.cumsum(alive)[ends - 1]


class Encoder:
    """Encodes texts; keeps the ids of words it has seen, up to ``MEMO_WORDS``."""

    def __init__(self, path: str, pattern: str):
        self.v = vocabulary(path)
        self.split = pretokenizer(pattern)
        self.memo: dict[str, bytes] = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for shard in _shards(texts):
            number = Numbers()
            docs = [array("I", map(number.__getitem__, self.split(t))) for t in shard]
            ids = self._ids(list(number))
            del number
            out += [b"".join([ids[i] for i in doc]) for doc in docs]
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        ids = [memo.get(w) for w in words]
        new = [i for i, x in enumerate(ids) if x is None]
        for at in range(0, len(new), REPLAY_WORDS):
            part = new[at : at + REPLAY_WORDS]
            flat, ends = replay([words[i].encode("utf-8", "surrogatepass") for i in part], self.v)
            raw, begin = flat.astype("<u4").tobytes(), 0
            for i, end in zip(part, (4 * ends).tolist(), strict=True):
                ids[i] = raw[begin:end]
                begin = end
                if len(memo) < MEMO_WORDS and len(words[i]) <= MEMO_WORD_CHARS:
                    memo[words[i]] = ids[i]
        return ids

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the text that ids stand for."""
        tokens = self.v.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _shards(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SHARD_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python process; its memo lives as long as the process."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns one row per input row: doc_id, ids (array<int>, only ``with_ids``), n_tokens,
    ids_sha256, decoded_sha256, round_trip (the decoded bytes equal the text's).
    Null or empty text: no ids, hashes of zero bytes. Repeated rows and null ids stay as they are.
    An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, 4096):
                texts = part.column(1).to_pylist()
                coded = e.encode_many(texts)
                decoded = [e.decode(c) for c in coded]
                columns = [
                    part.column(0),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == t.encode("utf-8", "surrogatepass") for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return keyed_texts(docs, id_col, text_col).mapInArrow(tidy(run), schema + (", ids array<int>" if with_ids else ""))


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids: doc_id, text. Bytes that are not UTF-8 become U+FFFD; null ids give ''."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            for part in slices(batch):
                texts = [b"".join([tokens[i] for i in ids or ()]).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`")).mapInArrow(tidy(run), "doc_id long, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
