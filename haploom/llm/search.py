"""Ranked lexical search, term at a time, with accumulators that are limited without losing a result.

Every document is tokenised once into an index row (its terms and how often each stands in it), from which
the corpus statistics are counted. Queries go to all executors in blocks of bounded size; each task holds
some index rows at a time, inverted into postings. A query's terms are taken rarest first. While a document
that has no accumulator yet could still reach the k-th best partial score with all remaining terms, each
posting creates one; once the sum of the remaining terms' largest contributions is below that score, no more
are created, those that cannot reach it are dropped, and the survivors are updated exactly by the remaining
terms. The k-th best score of earlier rows of a task counts as well. What tasks keep of each query is merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.llm.licenses import LOWER, UPPER
from haploom.llm.textkit import keyed_texts, slices
from haploom.session import staged

#: What is found for each query.
BEST = 50
#: Query terms that are broadcast at a time.
BLOCK_TERMS = 200_000
#: Postings of query terms that a task inverts at a time.
AT_ONCE = 1_000_000
#: A task's results of a query are merged with those of some others first.
MERGED = 64
#: Bytes that part terms become blanks, A-Z become a-z; bytes of other characters stay.
_FOLDED = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: runs of digits, letters (A-Z in lower case) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs: number of terms, the different ones and how often each occurs; written once.

    Rows without a term (null, empty) are left out; repeated rows and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [Counter(terms_of(t)) for t in part.column("text").to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32))
                terms = pa.array([t for c in found for t in c], type=pa.binary())
                tfs = pa.array([n for c in found for n in c.values()], type=pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c.total() for c in found], type=pa.int64()), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)], names=["doc_id", "n", "terms", "tfs"])

    rows = keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<binary>, tfs array<int>")
    return staged(rows.where("n > 0"), "index")


def weighted(queries: DataFrame, indexed: DataFrame, n_docs: int) -> DataFrame:
    """item, term, weight of every query term that a document holds; ``queries``: item, terms."""
    asked = staged(queries.select("item", F.explode("terms").alias("term")).distinct(), "asked")
    vocabulary = staged(asked.select("term").distinct(), "vocabulary")
    df = indexed.select(F.explode("terms").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return staged(asked.join(df, "term").select("item", "term", weight.alias("weight")), "weighted")


class _Postings:
    """Index rows of a task, inverted for the terms of a query block."""

    def __init__(self, ids: pa.Array, n: np.ndarray, code: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, total: int):
        self.ids, self.n_rows = ids, len(n)
        m = 50 + 50 * n * n_docs // total
        order = np.argsort(code, kind="stable")  # within a term, rows ascend
        self.code, self.doc = code[order], doc[order]
        tf = tf[order].astype(np.int64)
        self.share = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.code, codes, side="left"), np.searchsorted(self.code, codes, side="right")

    def search(self, codes: np.ndarray, weights: np.ndarray, best: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that may be among the best of a query, whose terms come rarest first.

        ``floor``: a score that ``best`` rows elsewhere have at least (0: none known)."""
        begin, end = self.of(codes)
        here = np.flatnonzero(end > begin)
        begin, end, weights = begin[here], end[here], weights[here]
        most = np.array([w * self.share[a:b].max() for a, b, w in zip(begin, end, weights, strict=True)], dtype=np.int64)
        left = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
        score = np.zeros(self.n_rows, dtype=np.int64)
        survivors = None
        for j, (a, b, w) in enumerate(zip(begin.tolist(), end.tolist(), weights.tolist(), strict=True)):
            if survivors is None and left[j] < floor:
                survivors = np.flatnonzero(score)
            if survivors is None:
                score[self.doc[a:b]] += w * self.share[a:b]
                # the k-th best partial score is only worth finding once the rest might fall below it
                if left[j + 1] < score.max() and np.count_nonzero(score) >= best:
                    floor = max(floor, int(np.partition(score, -best)[-best]))
                continue
            survivors = survivors[score[survivors] + left[j] >= floor]
            if not len(survivors):
                break
            at = np.minimum(np.searchsorted(self.doc[a:b], survivors), b - a - 1)
            hit = self.doc[a:b][at] == survivors
            score[survivors[hit]] += w * self.share[a:b][at[hit]]
        rows = np.flatnonzero(score) if survivors is None else survivors
        rows = rows[score[rows] >= max(floor, 1)]
        return rows, score[rows]


def _best(ids: np.ndarray, unknown: np.ndarray, scores: np.ndarray, best: int) -> np.ndarray:
    """Places of the best: larger scores first, then smaller ids, rows without an id last."""
    return np.lexsort((ids, unknown, -scores))[:best]


def _search_block(indexed: DataFrame, block: DataFrame, n_docs: int, total: int, best: int) -> DataFrame:
    """item, doc_id, score: what each task keeps of the queries of a block, whose terms are broadcast."""
    told = block.toArrow()
    terms = told.column("term").combine_chunks()
    vocabulary = terms.unique()
    code = pc.index_in(terms, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    item, weight = told.column("item").to_numpy(), told.column("weight").to_numpy()
    # by item, rarest terms first
    order = np.lexsort((code, -weight, item))
    item, code, weight = item[order], code[order], weight[order]
    names, starts = np.unique(item, return_index=True)
    sent = indexed.sparkSession.sparkContext.broadcast((vocabulary, code, weight, names, np.append(starts, len(item))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, code, weight, names, starts = sent.value
        kept = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in names]
        held: list[tuple] = []

        def search() -> None:
            sizes = np.cumsum([0, *(len(x[1]) for x in held)])
            ids = np.concatenate([x[0] for x in held])
            unknown = np.concatenate([x[4] for x in held])
            doc = np.concatenate([x[3] + s for x, s in zip(held, sizes, strict=False)])
            postings = _Postings(ids, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), doc, np.concatenate([x[5] for x in held]), n_docs, total)
            held.clear()
            for q in range(len(names)):
                a, b = starts[q], starts[q + 1]
                own = kept[q]
                floor = int(own[2][best - 1]) if len(own[2]) >= best else 0
                rows, scores = postings.search(code[a:b], weight[a:b], best, floor)
                if len(rows):
                    every = [np.concatenate(x) for x in zip(own, (ids[rows], unknown[rows], scores), strict=True)]
                    top = _best(*every, best)
                    kept[q] = tuple(x[top] for x in every)

        for batch in batches:
            lists, tfs = batch.column("terms"), batch.column("tfs")
            flat = pc.index_in(lists.flatten(), value_set=vocabulary)
            found = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())[found]
            ids = batch.column("doc_id")
            held.append(
                (
                    ids.fill_null(0).to_numpy(), batch.column("n").to_numpy(), flat.fill_null(0).to_numpy()[found].astype(np.int32), doc.astype(np.int32),
                    ids.is_null().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy()[found],
                )
            )
            if sum(len(x[2]) for x in held) >= AT_ONCE:
                search()
        if held:
            search()
        for name, (ids, unknown, scores) in zip(names.tolist(), kept, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name)), pa.array(ids, mask=unknown), pa.array(scores)], names=["item", "doc_id", "score"])

    return indexed.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, queries: DataFrame, best: int = BEST, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", query_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``best`` documents of each item with a score above 0.

    Equal scores by ascending id, null ids last. A document counts once for each of its rows. The rows of an item are
    one query, whose terms count once each; an item without a term, or with terms that no document holds, has no rows,
    and neither has an empty table of either kind.
    """
    spark = docs.sparkSession
    indexed = index(docs, id_col, text_col)
    n_docs, total = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = staged(queries.groupBy(F.col(f"`{item_col}`").alias("item_id")).agg(F.collect_list(F.coalesce(F.col(f"`{query_text}`").cast("string"), F.lit(""))).alias("texts")).withColumn("item", F.monotonically_increasing_id()), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for x in texts for t in terms_of(x)}) for texts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(terms, type=pa.list_(pa.binary()))], names=["item", "terms"])

    asked = weighted(named.select("item", "texts").mapInArrow(run, "item long, terms array<binary>"), indexed, n_docs)
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = None
    for number in range(blocks):
        part = _search_block(indexed, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number), n_docs, total, best)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("__group", F.spark_partition_id() % MERGED)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("item", "__group").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH told AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}') AS terms FROM documents
), sums AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM told
), each AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM told) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM each GROUP BY term), sums
), scored AS (
  SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n_docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN each USING (term) JOIN told USING (row), sums GROUP BY item_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN told USING (row) WHERE score > 0
) WHERE rank <= {BEST}
"""
