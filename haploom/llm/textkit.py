"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
BATCH_ROWS = 1024
#: Buckets of packed arrays for each shuffle partition; a task holds one bucket at a time.
BUCKETS_PER_PARTITION = 4
#: Rows that are turned into Python objects at a time; Arrow batches are read in such slices.
SLICE_ROWS = 256


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, which gives back to the system at its end what it has freed: Python workers are used again, and
    what each has once held would otherwise stay with it while other tasks need memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that few texts are Python objects at the same time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def grouped(batches: Iterator[pa.RecordBatch], column: str = "p") -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of a column that they are sorted by, one value's rows at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(column).to_pylist()
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[at]:
                if held and values[at] != last:
                    yield held
                    held = []
                last = values[at]
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield held


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns that an operator needs: ``doc_id`` and ``text`` (null text is empty), and ``more``.

    Columns of ``docs`` that clash with an operator's own names are thereby out of the way. From here on
    the session sends at most ``BATCH_ROWS`` rows in an Arrow batch, so that few texts are in memory twice.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


@lru_cache(maxsize=1)
def _odd_chars() -> frozenset[str]:
    """Characters that the two regular-expression libraries class differently: numbers other than
    decimal digits, code points that one of them may not know yet, and U+001C to U+001F."""
    return frozenset(
        chr(c)
        for c in range(sys.maxunicode + 1)
        if unicodedata.category(chr(c)) in ("Nl", "No") or 0x1C <= c <= 0x1F or (unicodedata.category(chr(c)) in ("Mn", "Mc", "So") and chr(c).isalnum())
        or ((c < 0x20000 or 0x323B0 <= c < 0x34000) and unicodedata.category(chr(c)) == "Cn")
    )


@lru_cache(maxsize=4)
def pretokenizer(pattern: str = public_tokenizers.PATTERN) -> Callable[[str], list[str]]:
    """A function that splits text by ``pattern``.

    The standard library's engine is the faster one; it has no ``\\p`` classes, so they are spelled
    with ``\\w`` and ``\\d``, and texts with characters where that differs go to the other engine.
    """
    full = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return full.findall
    fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    odd = _odd_chars()
    odd_bytes = bytes(ord(c) for c in odd if ord(c) < 256)

    def split(text: str) -> list[str]:
        try:
            narrow = text.encode("latin-1")
            same = len(narrow.translate(None, odd_bytes)) == len(narrow)
        except UnicodeEncodeError:
            same = odd.isdisjoint(text)
        return fast(text) if same else full.findall(text)

    return split


class Numbers(dict):
    """Numbers words in the order of their first place."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number
