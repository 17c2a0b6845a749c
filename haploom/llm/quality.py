"""Quality classifier: naive Bayes support vectors.

Documents are sets of byte n-grams and of a few word-bigram and length marks. Each indicator is scaled by its class log-count ratio, documents
are scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm.linear import dual_descent, held_out, labelled_sample, platt
from haploom.llm.textkit import keyed_texts, slices, tidy

#: Bits of a hashed n-gram's number.
BITS = 18
#: Lengths of the n-grams in bytes.
LENGTHS = (1, 2, 3, 4)
#: Labelled rows of each class that the model is fitted on at most.
PER_CLASS = 2500


def ngrams(text: str) -> np.ndarray:
    """Hashed byte n-grams of a text, with repeats; texts are padded by a blank on both sides."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", dtype=np.uint8).astype(np.uint32)
    if len(raw) == 2:
        return np.empty(0, dtype=np.int64)
    out = []
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        if n in LENGTHS:
            mixed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE35)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate([*out, _shape(text)]).astype(np.int64)


def _shape(text: str) -> np.ndarray:
    """Indicators of word bigrams that repeat one word (any, some, many, most), and of the text's length.

    They take the first places of the hash range, which they share with hashed n-grams.
    """
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    marks = [i for i, yes in enumerate((again > 0, again > 2, again > 9, 2 * again > len(words), 4 * again > 3 * len(words))) if yes]
    return np.array([*marks, 8 + min(len(words), (1 << 20)).bit_length()], dtype=np.uint32)


@dataclass
class Model:
    """Weights by n-gram (log-count ratio times SVM weight), squared ratios for scaling, and calibration."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without n-grams gets the bias alone."""
        seen = np.zeros(1 << BITS, dtype=bool)
        margins = np.empty(len(texts))
        for i, text in enumerate(texts):
            grams = ngrams(text)
            seen[grams] = True
            own = np.flatnonzero(seen) if len(grams) > 20_000 else np.unique(grams)
            seen[own] = False
            norm = np.sqrt(self.square[own].sum())
            margins[i] = self.weight[own].sum() / norm + self.bias if norm > 0 else self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -30, 30)))


def fit(sets: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Fit on documents given as arrays of distinct n-grams. Without both classes, every score is ``share``."""
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    count = np.ones((2, size))
    for own, label in zip(sets, y.tolist(), strict=True):
        count[label, own] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    rows = []
    for own in sets:
        values = ratio[own]
        norm = np.sqrt(values @ values)
        rows.append((own, values / norm if norm > 0 else values))
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    cost = 10.0 * np.sqrt(weight)
    test = np.arange(len(rows)) % 5 == 4
    if min(np.bincount(y[~test], minlength=2)) == 0 or min(np.bincount(y[test], minlength=2)) == 0:
        test[:] = False
    margins_of = lambda w, ids: np.array([w[rows[i][0]] @ rows[i][1] + w[size] for i in ids])
    if test.any():
        keep = np.flatnonzero(~test)
        part = dual_descent([rows[i] for i in keep], sign[keep], size, cost[keep])
        ids = np.flatnonzero(test)
        a, b = platt(margins_of(part, ids), y[ids], weight[ids])
    w = dual_descent(rows, sign, size, cost)
    if not test.any():
        a, b = platt(margins_of(w, range(len(rows))), y, weight)
    return Model(w[:size] * ratio, ratio * ratio, float(w[size]), a, b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, never of the held-out fold."""
    spark = docs.sparkSession
    chosen, share = labelled_sample(labels, label_col, per_class)
    wanted = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                keep = [i for i, x in enumerate(ids) if x in wanted.value]
                if keep:
                    texts = part.column(1)
                    own = [np.unique(ngrams(texts[i].as_py())).astype("<i4").tobytes() for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "grams"])

    got: dict[int, bytes] = {}
    if chosen:
        found = keyed_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, grams binary").toArrow()
        for x, grams in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            got[x] = max(grams, got.get(x, b""))
    wanted.unpersist()
    ids = sorted(got, key=lambda x: (hash((x, 17)), x))
    return fit([np.frombuffer(got[x], dtype="<i4").astype(np.int64) for x in ids], np.array([chosen[x] for x in ids], dtype=np.int64), share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text is empty, repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = shared.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = keyed_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = shared.value.scores([t or "" for t in part.column(names.index(text_col)).to_pylist()])
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)
