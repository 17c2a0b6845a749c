"""Token counts by prefix dynamic programming.

The encoding of a prefix ends in exactly one token, and what stands before that token is the encoding
of a shorter prefix. So ``count[end] = count[start] + 1`` for the one token ``word[start:end]`` that
the merges leave beside the last token of ``word[:start]``. One pass over a word gives the exact count
of every prefix, and budgets and truncations are answered from it without encoding anything again.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haploom.llm.textkit import Numbers, keyed_texts, pretokenizer, slices

#: Words whose counts a Python worker keeps; with more, it begins anew.
MEMO_WORDS = 900_000
#: Token pairs whose verdict a Python worker keeps; with more, it begins anew.
MEMO_PAIRS = 500_000
#: Words of up to so many bytes are counted together, longer ones each on its own.
TOGETHER_BYTES = 40
#: Texts whose words are counted together: up to so many characters, but for single longer texts.
SHARD_CHARS = 8 << 20


def _byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for
    themselves, the others for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE file of the tokenizers library, as a trie of its tokens and a merge table.

    Tokens are numbered anew: single bytes first, then joined tokens in the order of their merges, so
    that the smaller of two joined tokens is the one made first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take up their surroundings are not supported")
        byte_of = _byte_chars()
        number: dict[str, int] = {c: b for c, b in byte_of.items()}
        self.base = 256
        self.left = list(range(256))
        self.right = list(range(256))
        self.joined: dict[int, int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = number[a], number[b]
            token = number.setdefault(a + b, len(self.left))
            if token == len(self.left):
                self.left.append(x)
                self.right.append(y)
            self.joined.setdefault(x << 20 | y, token)
        #: step[node, byte] -> node, 0 where there is none; node 0 is the empty prefix; token[node] is
        #: the token that ends there, or -1
        plain = {bytes(byte_of[c] for c in text): i for text, i in number.items()}
        nodes: dict[bytes, int] = {b"": 0}
        for token in plain:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        self.step = np.zeros((len(nodes), 256), dtype=np.int32)
        self.token = np.full(len(nodes), -1, dtype=np.int64)
        for prefix, node in nodes.items():
            if node:
                self.step[nodes[prefix[:-1]], prefix[-1]] = node
                self.token[node] = plain.get(prefix, -1)
        self.apart: dict[int, bool] = {}
        self.known = np.empty(0, dtype=np.int64)  # pairs, sorted
        self.verdict = np.empty(0, dtype=bool)

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the tokens as they are when they stand side by side.

        Goes back through the making of both: a merge across the border would have come first if it
        ranks before the merge that made the part it takes away (or, to the right, equal to it).
        """
        joined, limit = self.joined, 1 << 40
        while True:
            across = joined.get(left << 20 | right)
            if across is not None and across < limit:
                return False
            if left > right:
                if left < self.base:
                    return True
                limit = left
                left = self.right[left]
            else:
                if right < self.base:
                    return True
                limit = right + 1
                right = self.left[right]

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Verdicts on pairs (left << 20 | right); new ones are worked out once."""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        new = distinct[~seen]
        if len(new):
            got = np.fromiter((self.stay_apart(k >> 20, k & 0xFFFFF) for k in new.tolist()), dtype=bool, count=len(new))
            out = np.empty(len(distinct), dtype=bool)
            out[~seen] = got
            if seen.any():
                out[seen] = self.verdict[at[seen]]
            keys, values = (new, got) if len(self.known) > MEMO_PAIRS else (np.concatenate([self.known, new]), np.concatenate([self.verdict, got]))
            order = np.argsort(keys, kind="stable")
            self.known, self.verdict = keys[order], values[order]
            return out[back]
        return self.verdict[at][back]

    def prefix_counts(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word, the token count of every prefix from the empty one on.

        The programme runs over all words of moderate length at once, start by start.
        """
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER_BYTES]
        for i, w in enumerate(words):
            if len(w) > TOGETHER_BYTES:
                out[i] = self._one(w)
        if not short:
            return out
        lengths = np.fromiter((len(words[i]) for i in short), dtype=np.int64, count=len(short))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths[0])
        chars = np.zeros((len(short), width), dtype=np.uint8)
        raw = np.frombuffer(b"".join(words[short[k]] for k in order.tolist()), dtype=np.uint8)
        chars[np.arange(width)[None, :] < lengths[:, None]] = raw
        counts = np.full((len(short), width + 1), -1, dtype=np.int16)
        counts[:, 0] = 0
        last = np.full((len(short), width + 1), -1, dtype=np.int64)
        longer = [int(np.searchsorted(-lengths, -e, side="left")) for e in range(width + 1)]  # rows of over e bytes
        for start in range(width):
            rows = np.arange(longer[start])
            node = np.zeros(len(rows), dtype=np.int32)
            for end in range(start, width):
                if len(rows) and rows[-1] >= longer[end]:
                    keep = int(np.searchsorted(rows, longer[end]))
                    rows, node = rows[:keep], node[:keep]
                node = self.step[node, chars[rows, end]]
                going = node > 0
                rows, node = rows[going], node[going]
                if not len(rows):
                    break
                token = self.token[node]
                open_ = np.flatnonzero((token >= 0) & (counts[rows, end + 1] < 0))
                at, token = rows[open_], token[open_]
                if start:
                    ok = self._apart(last[at, start] << 20 | token) if len(at) else np.zeros(0, dtype=bool)
                    at, token = at[ok], token[ok]
                counts[at, end + 1] = counts[at, start] + 1
                last[at, end + 1] = token
        for k, n, row in zip(order.tolist(), lengths.tolist(), counts, strict=True):
            out[short[k]] = row[: n + 1]
        return out

    def _one(self, word: bytes) -> np.ndarray:
        """The same for one long word."""
        n = len(word)
        counts = np.full(n + 1, -1, dtype=np.int32)
        counts[0] = 0
        last = [-1] * (n + 1)
        step, tokens = self.step, self.token
        for start in range(n):
            node = 0
            for end in range(start, n):
                node = step[node, word[end]]
                if not node:
                    break
                token = int(tokens[node])
                if token >= 0 and counts[end + 1] < 0 and (not start or self._pair(last[start] << 20 | token)):
                    counts[end + 1] = counts[start] + 1
                    last[end + 1] = token
        return counts

    def _pair(self, pair: int) -> bool:
        got = self.apart.get(pair)
        if got is None:
            if len(self.apart) > MEMO_PAIRS:
                self.apart.clear()
            got = self.apart[pair] = self.stay_apart(pair >> 20, pair & 0xFFFFF)
        return got


class Counter:
    """Counts tokens of texts; keeps the counts of the words it has met."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.split = pretokenizer(pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.number = Numbers()
        self.totals = np.empty(0, dtype=np.int32)
        self.chars = np.empty(0, dtype=np.int32)

    def _learn(self) -> None:
        """Counts of the words numbered since the last time."""
        new = list(islice(self.number, len(self.totals), None))
        if new:
            got = self.merges.prefix_counts([w.encode("utf-8", "surrogatepass") for w in new])
            self.totals = np.concatenate([self.totals, np.fromiter((g[-1] for g in got), dtype=np.int32, count=len(got))])
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, new), dtype=np.int32, count=len(new))])

    def __getitem__(self, word: str) -> int:
        number = self.number.get(word)
        if number is not None and number < len(self.totals):
            return int(self.totals[number])
        return int(self.merges._one(word.encode("utf-8", "surrogatepass"))[-1])

    def count_many(self, texts: list[str], budget: int = 1 << 62) -> list[tuple[int, int]]:
        """For each whole text its tokens, and the characters of its longest prefix within ``budget``."""
        out: list[tuple[int, int]] = []
        at = 0
        while at < len(texts):
            if len(self.number) > MEMO_WORDS:
                self.number = Numbers()
                self.totals = self.chars = np.empty(0, dtype=np.int32)
            docs, chars = [], 0
            while at < len(texts) and chars < SHARD_CHARS:
                chars += len(texts[at])
                docs.append((texts[at], *self._numbered(texts[at])))
                at += 1
            self._learn()
            for text, numbers, specials in docs:
                words = np.frombuffer(numbers, dtype=np.uint32) if numbers else np.empty(0, dtype=np.uint32)
                count = int(self.totals[words].sum()) + specials
                if count <= budget:
                    out.append((count, len(text)))
                elif specials:
                    out.append((count, int(np.flatnonzero(self.prefixes(text) <= budget)[-1])))
                else:
                    out.append((count, self._fit(text, words, budget)))
        return out

    def _numbered(self, text: str) -> tuple[array, int]:
        """Numbers of a text's words, and how many special tokens it has."""
        if self.special is None or not self.special.search(text):
            return array("I", map(self.number.__getitem__, self.split(text))), 0
        words, specials = array("I"), 0
        for plain, special in self.parts(text):
            words.extend(map(self.number.__getitem__, self.split(plain)))
            specials += bool(special)
        return words, specials

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(ordinary text, special token after it or '')."""
        if self.special is None:
            return [(text, "")]
        out, at = [], 0
        for m in self.special.finditer(text):
            out.append((text[at : m.start()], m[0]))
            at = m.end()
        return [*out, (text[at:], "")]

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of every prefix of a text, by characters, from the empty one on."""
        out, done = [np.zeros(1, dtype=np.int32)], 0
        for plain, special in self.parts(text):
            counts = self._plain_prefixes(plain + special[:-1])
            out.append(done + counts[1:])
            if special:
                done += int(counts[len(plain)]) + 1
                out.append(np.array([done], dtype=np.int32))
        return np.concatenate(out).astype(np.int32)

    def _plain_prefixes(self, text: str) -> np.ndarray:
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        at = done = 0
        blank_at, blank_done = 0, 0  # where the blank run that ends here began, and the count there
        for word in self.split(text):
            if not text[at - 1 : at].isspace() or at == 0:
                blank_at, blank_done = at, done
            inside = self._within(word)
            counts[at + 1 : at + len(word) + 1] = done + inside[1:]
            if word[0].isspace() and not word.isspace() and at > blank_at:  # cut after its blank: one run
                counts[at + 1] = blank_done + self[text[blank_at : at + 1]]
            elif word.isspace() and at > blank_at:
                for k in range(1, len(word) + 1):
                    if at + k < len(text):
                        counts[at + k] = blank_done + self[text[blank_at : at + k]]
            done += int(self[word])
            at += len(word)
            counts[at] = done if at == len(text) or not word.isspace() else counts[at]
        return counts

    def _within(self, word: str) -> np.ndarray:
        """Counts of a word's prefixes by characters; a cut contraction is split again."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.merges._one(raw)
        if not word.isascii():
            counts = counts[np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in word)])]
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():
            counts[2] = sum(self[w] for w in self.split(word[:2]))
        return counts

    def _fit(self, text: str, words: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, which the text exceeds.

        Each word adds a token at least, so only the last few words that begin within the budget are
        looked at by prefix.
        """
        before = np.concatenate([[0], np.cumsum(self.totals[words], dtype=np.int64)])
        place = np.concatenate([[0], np.cumsum(self.chars[words], dtype=np.int64)])
        over = int(np.searchsorted(before, budget, side="right"))
        k = max(0, over - 3)
        while k and text[place[k - 1] : place[k]].isspace():
            k -= 1
        k = max(0, k - 1)
        end = min(len(words), over + 1)
        counts = before[k] + self._plain_prefixes(text[place[k] : place[end]])
        return int(place[k] + np.flatnonzero(counts <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """The counter of this Python process; what it keeps lives as long as the process."""
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Exact counts of whole texts: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars``: characters of the longest prefix of at most ``limit`` tokens. Null or empty text
    counts 0. One row per input row: repeated rows and null ids stay. Empty table: empty result.
    Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            for part in slices(batch, 4096):
                texts = part.column(1).to_pylist()
                counts = c.count_many(texts, limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array([n for n, _ in counts], pa.int64()),
                        pa.array([n > limit for n, _ in counts], pa.bool_()),
                        pa.array([chars for _, chars in counts], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, counts: ``counts[p]`` is the exact token count of the text's first p characters.

    Null or empty text: ``[0]``. Any later question of budget or truncation reads this array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            for part in slices(batch, 64):
                counts = [c.prefixes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, counts array<int>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, against a limit of 1024."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
