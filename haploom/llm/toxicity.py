"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

A sentence is judged by its highest word, a document by its highest sentence. The kernel of two words sums over all common subsequences of
three letters, gaps allowed, each weighted by decay to the length it spans in either word, and is scaled by
sqrt(K(x, x) K(y, y)). Landmarks
are a bounded set of words; the Nystroem map ``K(x, landmarks) K(landmarks, landmarks)^-1/2`` gives
the vectors on which a linear SVM is fitted. As the kernel has an explicit feature for each triple of
letters, the decision function of any word collapses into one table of triples, read in one pass.

Labels belong to documents. Training runs over their sentences: all those of a clean document are clean, and the
one of a toxic document that the model finds highest stands for it; picks and fits alternate (``fit``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from haploom.llm.linear import dual_descent, held_out, labelled_sample, platt
from haploom.llm.textkit import Numbers, keyed_texts, slices

#: Labelled documents of each class that the model is fitted on at most.
PER_CLASS = 1500
#: Landmarks at most.
LANDMARKS = 256
#: Toxic training documents that must hold a word that stands for a toxic sentence: each is tried (see ``fit``).
WITNESS_DOCS = (2, 3, 5)
#: Log-odds that such a word has at least, and how often clean sentences of one word count.
LEAST_ODDS = 1.5
MOST_ALIKE = 4
#: Letters that a subsequence may span at most, and the weight of each letter spanned.
SPAN = 6
DECAY = 0.65
#: Letters of a word that are scored at once; longer words are scored in overlapping windows.
WINDOW = 40
#: Words whose margins a Python worker keeps; with more, it begins anew.
MEMO_WORDS = 600_000
#: Look-alikes that stand for letters.
LOOK_ALIKES = str.maketrans("0134578@$!", "oieastbasi")
#: A run of single characters with blanks between, as in "l o s e r".
SPACED_OUT = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
#: What ends a sentence.
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n")
#: The triples' offsets from the first letter.
OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def letters(word: str) -> bytes:
    """Codes 1 to 31 of a word's letters: a-z as 1 to 26, other letters and digits as 27 to 31.

    Look-alikes are read as letters, other characters (dots, dashes, stars between letters) dropped.
    """
    lower = word.lower()
    if not (lower.isascii() and lower.isalpha()):
        stripped = lower.strip("!?.,;:()[]{}\"'|*#%&")
        lower = stripped.translate(LOOK_ALIKES)
    return bytes([ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5 for c in lower if c.isalnum()])


def words_of(text: str) -> list[str]:
    """Words of a text by white space, and each spaced-out run joined to one word."""
    words = text.split()
    if SPACED_OUT.search(text):
        words += [m[0].replace(" ", "").replace("\t", "") for m in SPACED_OUT.finditer(text)]
    return words


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of letter codes, padded by 0; the word of each row): long words take several rows."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= WINDOW:
            pieces.append(w)
            owner.append(i)
        else:
            for at in range(0, len(w) - WINDOW // 2, WINDOW // 2):
                pieces.append(w[at : at + WINDOW])
                owner.append(i)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    width = max(int(lengths.max(initial=0)), SPAN)
    rows = np.zeros((len(pieces), width), dtype=np.int32)
    rows[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    return rows, np.array(owner, dtype=np.int64)


def triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(codes of the triples at every place, weight) for each pair of offsets; padding gives codes that
    hold a zero letter."""
    for a, b in OFFSETS:
        if rows.shape[1] > b:
            yield (rows[:, : rows.shape[1] - b] << 10) | (rows[:, a : rows.shape[1] - b + a] << 5) | rows[:, b:], DECAY ** (b + 1)


def self_kernels(rows: np.ndarray) -> np.ndarray:
    """K(x, x) of each row of letters: the sum over its triples of the squares of their weights; 1 without triples."""
    keys, weights = [], []
    for codes, weight in triples(rows):
        whole = (codes >= 1 << 10) & (codes >> 5 & 31 > 0) & (codes & 31 > 0)
        at = np.nonzero(whole)
        keys.append(at[0] << 15 | codes[at])
        weights.append(np.full(len(at[0]), weight))
    key, weight = (np.concatenate([*x, np.empty(0, dtype=t)]) for x, t in ((keys, np.int64), (weights, np.float64)))
    if not len(key):
        return np.ones(len(rows))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(weight[order], first)
    out = np.bincount(key[first] >> 15, weights=sums * sums, minlength=len(rows))
    return np.where(out > 0, out, 1.0)


def features(words: list[bytes]) -> np.ndarray:
    """Explicit kernel features of words, scaled to unit length: one row of 32768 for each."""
    rows, owner = padded(words)
    out = np.zeros((len(words), 1 << 15), dtype=np.float32)
    for codes, weight in triples(rows):
        np.add.at(out, (np.broadcast_to(owner[:, None], codes.shape), codes), weight)
    zero = np.arange(1 << 15)
    out[:, (zero < 1 << 10) | (zero >> 5 & 31 == 0) | (zero & 31 == 0)] = 0
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """The collapsed decision function: a weight for each triple, a bias, and the calibration."""

    table: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of words; one with fewer than three letters has the bias alone."""
        coded = [letters(w) for w in words]
        out = np.full(len(words), -np.inf)
        for at in range(0, len(coded), 20_000):
            part = coded[at : at + 20_000]
            rows, owner = padded(part)
            total = np.zeros(len(rows))
            for codes, weight in triples(rows):
                total += weight * self.table[codes].sum(axis=1)
            got = total / np.sqrt(self_kernels(rows)) + self.bias
            np.maximum.at(out, at + owner, got)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


class Nystroem:
    """The map of words to vectors whose products approximate the kernel, by landmark words."""

    def __init__(self, marks: list[str]):
        base = features([letters(w) for w in marks])
        values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
        keep = values > 1e-3 * values[-1]
        #: [triples, dimensions]: a word's vector is the sum of its triples' rows
        self.rows = (base.T @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]), dtype=np.float32)
        for at in range(0, len(words), 2000):
            rows, owner = padded([letters(w) for w in words[at : at + 2000]])
            total = np.zeros((len(rows), self.rows.shape[1]), dtype=np.float32)
            for codes, weight in triples(rows):
                whole = (codes >= 1 << 10) & (codes >> 5 & 31 > 0) & (codes & 31 > 0)
                for column in range(codes.shape[1]):
                    own = np.flatnonzero(whole[:, column])
                    total[own] += weight * self.rows[codes[own, column]]
            np.add.at(out, at + owner, total / np.sqrt(self_kernels(rows))[:, None])
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """A weight for each triple, from weights of the dimensions."""
        return (self.rows @ w.astype(np.float32)).astype(np.float32)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence (and line) of a text, once each; sentences without words are left out."""
    return [own for own in (list(dict.fromkeys(words_of(s))) for s in SENTENCE_END.split(text)) if own]


def _svm(space: Nystroem, toxic: Counter, clean: Counter) -> tuple[np.ndarray, float]:
    """Weights and bias of the SVM on words that stand for so many toxic and clean sentences."""
    bad, good = sorted(toxic), sorted(clean)
    x = space.vectors(bad + good)
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    # sentences with one word count together, clean ones up to MOST_ALIKE times; both classes weigh alike
    n_bad, n_good = np.array([toxic[w] for w in bad], dtype=float), np.array([min(clean[w], MOST_ALIKE) for w in good], dtype=float)
    cost = np.concatenate([n_bad * n_good.sum() / n_bad.sum(), n_good]).clip(max=40.0)
    every = np.arange(x.shape[1])
    w = dual_descent([(every, v) for v in x], y, x.shape[1], cost, epochs=8)
    return w[:-1], float(w[-1])


class Vocabulary:
    """Words whose letters and norms are kept, to be judged by many tables."""

    def __init__(self, words: list[str]):
        self.coded = [letters(w) for w in words]
        self.norms = [np.sqrt(self_kernels(rows)).astype(np.float32) for _, rows, _ in self._parts()]

    def _parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, len(self.coded), 20_000):
            yield at, *padded(self.coded[at : at + 20_000])

    def margins(self, table: np.ndarray, bias: float) -> np.ndarray:
        """What ``Model.margins`` gives."""
        out = np.full(len(self.coded), -np.inf)
        for (at, rows, owner), norm in zip(self._parts(), self.norms, strict=True):
            total = np.zeros(len(rows), dtype=np.float32)
            for codes, weight in triples(rows):
                total += np.float32(weight) * table[codes].sum(axis=1)
            np.maximum.at(out, at + owner, total / norm + bias)
        return out


class Bags:
    """Labelled documents as sentences of numbered words."""

    def __init__(self, docs: list[list[list[str]]], y: np.ndarray):
        number = Numbers()
        self.docs = [[np.fromiter(map(number.__getitem__, s), dtype=np.int64, count=len(s)) for s in d] for d in docs]
        self.words, self.y = list(number), y

    def counts(self, which: np.ndarray) -> tuple[Counter, Counter]:
        """In how many clean and how many toxic documents of ``which`` each word stands."""
        clean, toxic = Counter(), Counter()
        for d in which.tolist():
            (toxic if self.y[d] else clean).update(set(np.concatenate(self.docs[d]).tolist()) if self.docs[d] else ())
        return clean, toxic

    def tops(self, value: np.ndarray, which: np.ndarray) -> tuple[Counter, Counter]:
        """The highest word of the highest sentence of each toxic document, and that of every sentence of the clean ones."""
        toxic, clean = Counter(), Counter()
        for d in which.tolist():
            if self.docs[d]:
                best = [int(s[value[s].argmax()]) for s in self.docs[d]]
                if self.y[d]:
                    toxic[best[int(value[best].argmax())]] += 1
                else:
                    clean.update(best)
        return toxic, clean

    def margins(self, value: np.ndarray, bias: float) -> np.ndarray:
        return np.array([max((value[s].max() for s in d), default=bias) for d in self.docs])


def _agreement(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(the best F1 of any threshold, that threshold: halfway between the margins that it parts)."""
    order = np.argsort(-margins, kind="stable")
    hits, ranked = np.cumsum(y[order]), margins[order]
    f1 = np.where(np.append(ranked[1:] < ranked[:-1], True), 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0.0)
    at = int(f1.argmax())
    below = ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 1
    return float(f1[at]), float(ranked[at] + below) / 2


def fit(docs: list[list[list[str]]], y: np.ndarray, share: float, rounds: int = 4) -> Model:
    """Fit on labelled documents, given as sentences of words. Without both classes, every score is ``share``.

    Sentences have no labels of their own: every sentence of a clean document is clean, and of a toxic one at
    least one is toxic. So rounds alternate: the model picks the highest sentence of each toxic document, and in each
    sentence its highest word; an SVM is fitted on these. The first picks are by log-odds. How many toxic documents
    must hold a word that is picked as toxic, and which round is taken, is decided on a fifth of the documents that
    no round was fitted on.
    """
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << 15, dtype=np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    test = np.arange(len(docs)) % 5 == 4
    if min(np.bincount(y[~test], minlength=2)) == 0 or min(np.bincount(y[test], minlength=2)) == 0:
        test[:] = False
    bags = Bags(docs, y)
    inner, judged = np.flatnonzero(~test), test if test.any() else ~test
    in_clean, in_toxic = bags.counts(inner)
    n_toxic = int(y[inner].sum())
    n_clean = len(inner) - n_toxic
    long = np.array([len(letters(w)) >= 3 for w in bags.words], dtype=bool)
    odds, telling = np.full((2, len(bags.words)), -np.inf)
    for w, n in in_toxic.items():
        if long[w]:
            odds[w] = np.log((n + 0.1) / n_toxic) - np.log((in_clean[w] + 0.5) / n_clean)
            telling[w] = odds[w] * np.sqrt(n)
    ranked = sorted((w for w in in_toxic if long[w]), key=lambda w: (-telling[w], bags.words[w]))
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], bags.words[x[0]])) if long[w]]
    rest = sorted(common[LANDMARKS // 4 :], key=lambda w: bags.words[w])
    marks = ranked[: LANDMARKS // 2] + common[: LANDMARKS // 4] + rest[:: max(1, 4 * len(rest) // LANDMARKS)][: LANDMARKS // 4]
    if not marks:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << 15, dtype=np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    space = Nystroem([bags.words[w] for w in dict.fromkeys(marks)])
    known = Vocabulary(bags.words)
    best: tuple[tuple[float, float], Model, np.ndarray] | None = None
    for least in WITNESS_DOCS:
        toxic, clean = bags.tops(telling, inner)
        for _ in range(rounds):
            # a word that says little, or that hardly any document holds, is toxic by chance too often
            kept = Counter({w: n for w, n in toxic.items() if in_toxic[w] >= least and odds[w] > LEAST_ODDS}) or toxic
            w, bias = _svm(space, Counter({bags.words[i]: n for i, n in kept.items()}), Counter({bags.words[i]: n for i, n in clean.items() if i not in kept}))
            model = Model(space.table(w), bias, 1.0, 0.0)
            value = np.where(long, known.margins(model.table, bias), bias)
            margins = bags.margins(value, bias)
            found = _agreement(margins[judged], y[judged])
            if best is None or found[0] > best[0][0]:
                best = found, model, margins
            toxic, clean = bags.tops(value, inner)
    (_, cut), model, margins = best
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.a, _ = platt(margins[judged], y[judged], weight[judged])
    # even odds lie where misses and false alarms balance best, also where toxic documents are few
    model.b = -model.a * cut
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, never of the held-out fold.

    What comes to the driver is the sample's sentences, each word once in a sentence.
    """
    chosen, share = labelled_sample(labels, label_col, per_class)
    wanted = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                keep = [i for i, x in enumerate(ids) if x in wanted.value]
                if keep:
                    # words have no white space in them, so it can part them and their sentences
                    own = ["\n".join("\t".join(s) for s in dict.fromkeys(map(tuple, sentences(part.column(1)[i].as_py())))) for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array(own, pa.string())], names=["doc_id", "words"])

    got: dict[int, str] = {}
    if chosen:
        found = keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, words string").toArrow()
        for x, words in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            got[x] = max(words, got.get(x, ""))
    wanted.unpersist()
    ids = sorted(got, key=lambda x: (hash((x, 17)), x))
    split = [[s.split("\t") for s in got[x].split("\n") if s] for x in ids]
    return fit(split, np.array([chosen[x] for x in ids], dtype=np.int64), share)


class Scorer:
    """Scores texts by one model; keeps the margins of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.number = Numbers()
        self.margin = np.empty(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text by its highest word; texts without words get that of the bias."""
        if len(self.number) > MEMO_WORDS:
            self.number, self.margin = Numbers(), np.empty(0)
        docs = [np.fromiter(map(self.number.__getitem__, words_of(t)), dtype=np.int64) for t in texts]
        new = list(islice(self.number, len(self.margin), None))
        if new:
            self.margin = np.concatenate([self.margin, self.model.margins(new)])
        best = np.array([self.margin[d].max() if len(d) else self.model.bias for d in docs])
        return self.model.probability(best)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text is empty, repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 1024):
                scores = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)
