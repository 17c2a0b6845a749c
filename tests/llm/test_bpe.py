"""Merge replay and prefix counts against the libraries that the files are made for."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from haploom.llm import byte_bpe, token_counts
from tests.llm.common import ODD, documents, prose

RANKS = P.path("byte_bpe_50k.tiktoken")
SPEC = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = [t or "" for _, t in ODD] + [" ".join(prose(rng, 40)) for _ in range(60)]
    pool = ["a", "the", " ", "  ", "\n", "'re", "'s", "é", "!", "<|endoftext|>", "12", "あ", "aaaa", "²", "\x1c", "x" * 90]
    return out + ["".join(rng.choice(pool) for _ in range(14)) for _ in range(300)] + ["a" * 3000, "ab" * 2000]


def test_ids_are_the_librarys(reference):
    e = byte_bpe.encoder(RANKS, P.PATTERN)
    for text, ids in zip(texts(), e.encode_many(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert e.decode(ids).decode() == text


def test_small_and_large_groups_merge_alike(monkeypatch):
    words = [t.encode() for t in texts() if t]
    v = byte_bpe.vocabulary(RANKS)
    usual = byte_bpe.replay(words, v)
    for many in (1, 10**9):
        monkeypatch.setattr(byte_bpe, "MANY", many)
        got = byte_bpe.replay(words, v)
        assert all(np.array_equal(a, b) for a, b in zip(usual, got, strict=True))


def test_encode_query_columns(spark, reference):
    rows = {(r.doc_id, r.decoded_sha256): r for r in byte_bpe.encode(documents(spark, ODD, clash=True), RANKS).collect()}
    assert len(rows) == len(ODD) - 1
    for i, text in ODD:
        raw = (text or "").encode()
        r = rows[i, hashlib.sha256(raw).hexdigest()]
        ids = reference.encode_ordinary(text or "")
        assert r.n_tokens == len(ids) and r.ids == ids and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_decode_table(spark):
    coded = spark.createDataFrame([(1, [1169, 220]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe.decode(coded, RANKS).collect()} == {1: "the ", 2: ""}


def test_every_prefix_is_counted():
    t = Tokenizer.from_file(SPEC)
    c = token_counts.counter(SPEC, P.PATTERN)
    for text in [x for x in texts() if len(x) < 400]:
        want = [len(t.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert c.prefixes(text).tolist() == want
        for budget in (0, 3, 9):
            longest = max(p for p in range(len(text) + 1) if want[p] <= budget)
            assert c.count_many([text], budget) == [(want[-1], longest)]


def test_count_table(spark):
    t = Tokenizer.from_file(SPEC)
    got = token_counts.count_tokens(documents(spark, ODD, clash=True), SPEC, 5).collect()
    assert len(got) == len(ODD)
    want = {(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ODD}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    table = {r.doc_id: r.counts for r in token_counts.prefix_table(documents(spark, ODD), SPEC).collect()}
    assert table[1] == table[2] == [0] and table[3] == [0, 1]


def test_empty_tables(spark):
    none = documents(spark, [])
    assert byte_bpe.encode(none, RANKS).count() == 0 and token_counts.count_tokens(none, SPEC, 5).count() == 0
