"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are rotated by a fixed random orthogonal matrix; a code keeps the signs of the rotated
coordinates, packed, and two correction scalars: the vector's length, and the inner product of its
direction with its code. From them the inner product with a query is estimated without bias, with an
error bound that shrinks with the dimension. A query reranks, on original vectors, those candidates
whose upper bound reaches the best lower bounds found so far.

Rows are packed into blocks of bounded size. Each block of queries meets each block of rows once, and
hands on its nearest few, so the stated query set is searched against all rows without pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.session import shuffle_partitions, staged

#: Rows in a block, and queries in a block, at most (but for chance in how ids hash).
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
#: Standard deviations that the error bound covers.
BOUND = 4.0
SEED = 20240229


def rotation(dim: int) -> np.ndarray:
    """The fixed random orthogonal matrix for a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, lengths, inner products of the directions with their codes)."""
    dim = vectors.shape[1]
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norm[:, None]) @ rotation(dim)
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimates(queries: np.ndarray, bits: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, their error bounds) of each query with each coded vector."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * np.float32(2 / np.sqrt(dim)) - np.float32(1 / np.sqrt(dim))
    length = np.sqrt((queries * queries).sum(axis=1))
    turned = ((queries / length[:, None]) @ rotation(dim)).astype(np.float32)
    safe = np.maximum(align, 1e-9)
    scale = (norm / safe).astype(np.float32)
    got = (turned @ signs.T) * scale[None, :] * length[:, None].astype(np.float32)
    spread = BOUND * np.sqrt(np.maximum(1 - safe * safe, 0)) / (safe * np.sqrt(max(dim - 1, 1)))
    return got, length[:, None].astype(np.float32) * (norm * spread + 1e-6 * norm).astype(np.float32)[None, :]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>), dim: vectors that are not null, zero, or with null or non-finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row for each block: dim, block, ids, vectors, bits, norms, aligns as packed arrays."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((np.arange(table.num_rows), table.column("vec_id").to_numpy()))
        ids = table.column("vec_id").to_numpy()[order]
        dim = key[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(-1, dim)[order]
        bits, norm, align = encode(vectors)
        out = {"dim": [dim], block: [key[1].as_py()], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "bits": [bits.tobytes()], "norms": [norm.tobytes()], "aligns": [align.tobytes()]}
        return pa.table(out, schema=pa.schema([("dim", pa.int32()), (block, pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "bits", "norms", "aligns"))]))

    return rows.groupBy("dim", block).applyInArrow(pack, f"dim int, {block} int, ids binary, vectors binary, bits binary, norms binary, aligns binary")


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of one block's rows for each query of another."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            dim = row["dim"]
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, dim)
            bits = np.frombuffer(row["bits"], dtype=np.uint8).reshape(len(ids), -1)
            norm, align = np.frombuffer(row["norms"]), np.frombuffer(row["aligns"])
            q_ids = np.frombuffer(row["q_ids"], dtype=np.int64)
            queries = np.frombuffer(row["q_vectors"], dtype=np.float64).reshape(-1, dim)
            out_q, out_v, out_s = [], [], []
            for at in range(0, len(q_ids), 256):
                some = queries[at : at + 256]
                got, error = estimates(some, bits, norm, align)
                low, high = got - error, got + error
                if len(ids) > k + 1:
                    floor = np.partition(low, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]  # one may be the query itself
                else:
                    floor = np.full(len(some), -np.inf)
                for j in range(len(some)):
                    chosen = np.flatnonzero(high[j] >= floor[j])
                    chosen = chosen[ids[chosen] != q_ids[at + j]]
                    exact = np.cumsum(vectors[chosen] * some[j], axis=1)[:, -1]  # terms added in order
                    if len(chosen) > k:
                        least = np.partition(exact, len(chosen) - k)[len(chosen) - k]
                        keep = exact >= least
                        chosen, exact = chosen[keep], exact[keep]
                    best = np.lexsort((ids[chosen], -exact))[:k]
                    out_q.append(np.full(len(best), q_ids[at + j]))
                    out_v.append(ids[chosen[best]])
                    out_s.append(exact[best])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` for each row of ``queries``.

    Nearness is the largest inner product in double precision on the original vectors, ties to the
    smaller vec_id; a query's own id is no candidate. Vectors of another dimension than the query's,
    null, zero or with null or non-finite components take no part. Repeated rows of one id and vector
    count once; of different vectors of an id the greatest is taken. Fewer than k candidates give all of them.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    one = lambda df: df.groupBy("vec_id", "dim").agg(F.max("v").alias("v"))
    rows = staged(one(usable(vectors, id_col, vector_col)), "vectors")
    asked = staged(one(usable(queries, id_col, vector_col)), "queries")
    n_rows = -(-rows.count() // ROW_BLOCK) or 1
    n_queries = -(-asked.count() // QUERY_BLOCK) or 1
    blocks = _packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")), "block")
    q_blocks = _packed(asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int")), "q_block")
    q_blocks = q_blocks.select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    meet = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    both = meet.join(q_blocks, ["dim", "q_block"])
    both = both.repartition(parts, "block", "q_block")
    found = both.select("dim", "ids", "vectors", "bits", "norms", "aligns", "q_ids", "q_vectors").mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


#: The same in DuckDB by brute force.
SQL = """
WITH fine AS (
  SELECT vec_id, max(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id, len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
