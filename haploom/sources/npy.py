"""Matrices in NPY files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path) -> DataFrame:
    """path, ord, values: rows of matrices of one or two dimensions and any number type, as doubles."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in pdf.itertuples(index=False):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                m = m.reshape(len(m), -1).astype(np.float64)
                for at in range(0, len(m), 10_000):
                    part = m[at : at + 10_000]
                    yield pd.DataFrame({"path": name, "ord": np.arange(at, at + len(part)), "values": list(part)})

    return files.mapInPandas(run, "path string, ord long, values array<double>")


def split_overlay(rows: DataFrame, k: int) -> DataFrame:
    """features and labels of rows with one or two label columns after k features; other widths are an error."""
    extra = F.size("values") - k
    values = F.when(extra.isin(1, 2), F.col("values")).otherwise(F.raise_error(F.lit("rows must have one or two labels after their features")))
    return rows.withColumn("values", values).withColumn("features", F.slice("values", 1, k)).withColumn("labels", F.transform(F.slice("values", k + 1, 2), lambda x: F.round(x).cast("int"))).drop("values")


def tag_files(paths: DataFrame) -> DataFrame:
    """sample and contig of prediction files by their names ({sample}_{contig}.npy)."""
    name = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return paths.withColumn("sample", F.regexp_extract(name, r"^(.+)_([^_]+)$", 1)).withColumn("contig", F.regexp_extract(name, r"^(.+)_([^_]+)$", 2))


def pair_files(predictions: DataFrame, reads: DataFrame) -> DataFrame:
    """sample, contigs, paths, reads: the prediction files ({sample}_{contig}.npy, by contig) of each sample that
    has read support ({sample}_ps4g...), the first of several by name; samples without either are left out."""
    tagged = tag_files(predictions).where("sample <> ''").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("contig", "path"))).alias("f"))
    own = reads.select(F.regexp_extract("path", r"([^/]+?)_?ps4g[^/]*$", 1).alias("sample"), F.col("path").alias("reads")).where("sample <> ''").groupBy("sample").agg(F.min("reads").alias("reads"))
    return tagged.join(own, "sample").select("sample", F.col("f.contig").alias("contigs"), F.col("f.path").alias("paths"), "reads")


def in_contig_order(rows: DataFrame, contigs: list[str]) -> DataFrame:
    """Rows of tagged files (see ``tag_files``) with ``place``, their ordinal over all listed contigs of their
    sample, in the order of the list; other contigs are left out."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(contigs)), "__c int, contig string")
    size = rows.groupBy("sample", "contig").agg((F.max("ord") + 1).alias("__n")).join(listed, "contig")
    before = W.partitionBy("sample").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    offset = size.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("sample", "contig", "__off")
    return rows.join(offset, ["sample", "contig"]).withColumn("place", F.col("__off") + F.col("ord")).drop("__off")


def to_npy(sites: DataFrame, keys: list[str], by: str) -> DataFrame:
    """keys, content: each key's cells as the bytes of an NPY file (a matrix of one contig of one sample)."""
    fields = {f.name: f.dataType.simpleString() for f in sites.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.array(pdf.sort_values(by)["features"].tolist(), dtype=np.int8))
        return pdf[keys].head(1).assign(content=[out.getvalue()])

    return sites.groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {fields[c]}" for c in keys) + ", content binary")
