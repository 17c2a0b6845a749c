"""Quality rules with cut-offs that labelled rows vouch for.

A rule rejects a document where a measure of its text exceeds a cut-off. How strict each cut-off may be is
decided in each stratum by labelled documents that no rule was made from: for a cut-off that would reject x
of n good ones, the exact binomial tail P(Bin(n, share) <= x) bounds the chance of seeing so few if the rule
in truth rejected ``share`` of all good documents. The cut-offs of a rule are tried from the laxest on, and
the strictest one is taken before the tail first exceeds ``doubt / (strata * rules)``: testing in a fixed
order needs no correction along a rule, and Bonferroni covers strata and rules. So, but for a chance of
``doubt`` over all of them together, no stratum loses more than ``lost`` of its good documents (``lost / rules``
by each rule). Where labels are too few to vouch for any cut-off, a rule rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.llm import shingles
from haploom.llm.duck import CRC_BITS, crc32
from haploom.llm.licenses import UPPER
from haploom.llm.linear import FOLDS
from haploom.llm.textkit import keyed_texts, slices
from haploom.session import staged

#: Words of a window that counts as repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Largest share of a stratum's good documents that rules may reject, and the chance that any stratum loses more.
LOST, DOUBT = 0.03, 0.05
#: Strata up to which their cut-offs are broadcast; beyond, they are joined.
MOST_STRATA = 10_000
#: A document fails in any case with so few words, or with so many repeated ones in a hundred.
FEWEST_WORDS, MOST_REPEATED = 10, 20
#: Rules: measure (rejects what exceeds the cut-off) and cut-offs from the laxest to the strictest.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.18, 0.16, 0.14, 0.12, 0.1)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "long_words": ("word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-2.0, -2.5, -3.0, -3.5)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True


# --- measures of a text --------------------------------------------------------------------------


def _lines(text: str) -> tuple[int, int]:
    """(lines with a word, how many of them equal an earlier one)."""
    held = [x for x in text.split("\n") if x.strip(BLANK_CHARS)]
    return len(held), len(held) - len(set(held))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of each text. Words are compared by 64-bit hashes of their bytes."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raws])
    blank = shingles.BLANKS[raw]
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    each = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)[ends_of_texts - 1]]))
    after = np.searchsorted(begins, ends_of_texts)
    n_words = np.diff(np.concatenate([[0], after]))
    repeated = np.zeros(len(begins) + 1, dtype=np.int64)
    if len(begins) >= WINDOW:
        window = rolled_words(raw, begins, ends)
        text = np.repeat(np.arange(len(texts)), n_words)
        at = np.flatnonzero(text[: len(window)] == text[WINDOW - 1 :])
        order = at[np.lexsort((window[at], text[at]))]
        twin = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        both = np.zeros(len(order), dtype=bool)
        both[1:] |= twin
        both[:-1] |= twin
        found = order[both]
        cover = np.bincount(found, minlength=len(begins) + 1) - np.bincount(found + WINDOW, minlength=len(begins) + 1)
        repeated[1:] = np.cumsum(np.cumsum(cover)[: len(begins)] > 0)
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    return {
        "n_words": n_words,
        "word_chars": each(~blank & ((raw & 0xC0) != 0x80)),
        "n_symbols": each(_SYMBOL[raw]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.diff(np.concatenate([[0], repeated[after]])),
        "n_lines": lines[:, 0],
        "n_capitals": each(_CAPITAL[raw]),
    }


def rolled_words(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of all windows of words, given where the words begin and end."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * shingles._power(len(raw)), out=sums[1:])
    words = shingles.mix((sums[ends] - sums[begins]) * shingles._power(len(raw), inverse=True)[begins] + (ends - begins).astype(np.uint64))
    window = np.zeros(len(words) - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        window = window * shingles._PRIME + words[j : len(words) - WINDOW + 1 + j]
    return shingles.mix(window, WINDOW)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row, written once. Null text is empty; a null stratum is one of its own."""
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(f"`{stratum_col}`").cast("string")), F.lit("n"))
    rows = keyed_texts(docs, id_col, text_col, stratum.alias("stratum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, shingles.AT_ONCE), side="right"))
                for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                    if a < b:
                        counts = measure(texts[a:b])
                        yield pa.RecordBatch.from_arrays([part.column("doc_id")[a:b], part.column("stratum")[a:b], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "stratum", *COUNTS])

    return staged(rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)), "measured")


# --- cut-offs ------------------------------------------------------------------------------------


def binomial_tail(x: int, n: int, share: float) -> float:
    """P(Bin(n, share) <= x), by the continued fraction of the incomplete beta function."""
    if x >= n:
        return 1.0
    a, b, q = n - x, x + 1, 1 - share

    def beta(a: float, b: float, q: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(q) + b * math.log1p(-q)) / a
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * q / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        value = d
        for m in range(1, 100_000):
            for top in (m * (b - m) * q / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * q / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                c = 1 + top / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                value *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * value

    return beta(a, b, q) if q < (a + 1) / (a + b + 2) else 1 - beta(b, a, share)


@dataclass
class Cuts:
    """``tried``: stratum, rule, step, cut, n, x, tail, vouched of each cut-off; ``chosen``: stratum and, by rule, the
    cut-off taken (null: none)."""

    tried: DataFrame
    chosen: DataFrame


def calibrate(counts: DataFrame, labels: DataFrame, lost: float = LOST, doubt: float = DOUBT, rules: dict = RULES) -> Cuts:
    """Cut-offs from labelled rows: ``labels`` has doc_id and ``good`` (0 or 1); the caller leaves out rows that are
    to judge the result.

    Only good documents that do not fail in any case count. An id with several rows is one document, rejected if any
    of its rows is; with several labels it is good if all say so. A null id has no label.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good")).where("good = 1").select("doc_id")
    passed = counts.where(~base_failed()).select("doc_id", "stratum", *(F.expr(e).alias(r) for r, (e, _) in rules.items()))
    one = passed.join(good, "doc_id").groupBy("stratum", "doc_id").agg(*(F.max(r).alias(r) for r in rules))
    steps = [(r, k, float(c)) for r, (_, cuts) in rules.items() for k, c in enumerate(cuts)]
    sums = one.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((F.col(r) > c).cast("long")).alias(f"x{i}") for i, (r, _, c) in enumerate(steps)))
    found = staged(sums, "calibrated")
    level = doubt / max(found.count() * len(rules), 1)
    share = lost / len(rules)

    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), share) for a, b in zip(x, n, strict=True)])

    every = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cut"), F.col(f"x{i}").alias("x")) for i, (r, k, c) in enumerate(steps))))
    tried = found.select("stratum", "n", every.alias("e")).select("stratum", "e.rule", "e.step", "e.cut", "n", "e.x").withColumn("tail", tail("x", "n"))
    tried = staged(tried.withColumn("vouched", F.col("tail") <= level), "tried")
    # a rule's counts grow along its cut-offs, and so do the tails: the last one vouched for is the last before the first failure
    chosen = tried.where("vouched").groupBy("stratum").agg(*(F.max_by(F.when(F.col("rule") == r, F.col("cut")), F.when(F.col("rule") == r, F.col("step"))).alias(r) for r in rules))
    return Cuts(tried, chosen)


def base_failed():
    """Whether a document fails whatever the cut-offs are."""
    return F.expr(f"n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def judge(counts: DataFrame, cuts: Cuts, rules: dict = RULES) -> DataFrame:
    """``counts`` with base_failed, kept and ``failed``: the rules that reject a document, comma-joined.

    A stratum without cut-offs rejects nothing beyond base_failed.
    """
    chosen = staged(cuts.chosen.withColumnsRenamed({r: f"__{r}" for r in rules}), "chosen")
    small = chosen.count() <= MOST_STRATA
    joined = counts.join(F.broadcast(chosen) if small else chosen, "stratum", "left")
    failed = F.concat_ws(",", *(F.when(F.expr(e) > F.col(f"__{r}"), F.lit(r)) for r, (e, _) in rules.items()))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop(*(f"__{r}" for r in rules))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; cut-offs by language from the labels of all folds but the held-out one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    counts = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cuts = calibrate(counts, labels.select("doc_id", F.col("quality").alias("good")))
    return judge(counts, cuts).select("doc_id", *COUNTS[:5], "base_failed", "kept", "failed")


def sql() -> str:
    """The same in DuckDB."""
    share = LOST / len(RULES)
    blank = r"[\x20\x09-\x0D]"
    steps = ", ".join(f"('{r}', {k}, {float(c)})" for r, (_, cuts) in RULES.items() for k, c in enumerate(cuts))
    measures = ", ".join(f"CAST({e} AS DOUBLE) AS {r}" for r, (e, _) in RULES.items())
    value = "CASE s.rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    tail = f"list_sum(list_transform(range(x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({share}) + (n - k) * ln({1 - share}))))"
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN c.{r} > k.{r} THEN '{r}' END" for r in RULES) + ")"
    return rf"""
WITH {CRC_BITS}, told AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS stratum, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{blank}+'), lambda w: w <> '') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM told
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w) AS times FROM (SELECT row, i, words[i:i + {WINDOW - 1}] AS w FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split))
), repeated AS (
  SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS spot FROM windows WHERE times > 1) GROUP BY row
), counts AS (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(translate(text, '{UPPER}', '')) AS n_capitals
  FROM split LEFT JOIN repeated ON repeated.row = split.row
), based AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {measures} FROM counts
), good AS (
  SELECT doc_id FROM labels, bits WHERE doc_id IS NOT NULL AND {crc32("doc_id")} % {FOLDS} <> 0 GROUP BY doc_id HAVING min(quality) = 1
), one AS (
  SELECT stratum, doc_id, {", ".join(f"max({r}) AS {r}" for r in RULES)} FROM based JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL
), tried AS (
  SELECT stratum, s.rule, s.step, s.cut, count(*) AS n, count(*) FILTER ({value} > s.cut) AS x FROM one, (VALUES {steps}) s(rule, step, cut) GROUP BY ALL
), vouched AS (
  SELECT *, {tail} <= {DOUBT} / ((SELECT count(DISTINCT stratum) FROM one) * {len(RULES)}) AS ok FROM tried
), cuts AS (
  SELECT stratum, {", ".join(f"arg_max(cut, step) FILTER (ok AND rule = '{r}') AS {r}" for r in RULES)} FROM vouched GROUP BY stratum
)
SELECT doc_id, {", ".join(COUNTS[:5])}, base_failed, NOT base_failed AND {failed} = '' AS kept, {failed} AS failed FROM based c LEFT JOIN cuts k ON k.stratum = c.stratum
"""
