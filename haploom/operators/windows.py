"""Fixed-length windows over ordinals, stitching, votes, and nearest-neighbour imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def n_windows(n: Column, size: int, step: int, mode: str = "full") -> Column:
    """Windows over n ordinals: ``full`` counts the last one that fits, ``legacy`` one less, ``padded`` enough to hold all."""
    if mode == "padded":
        return F.ceil(n / step)
    most = F.floor((n - size) / step)
    return F.greatest(most + 1 if mode == "full" else most, F.lit(0))


def sliding(df: DataFrame, keys: list[str], ord_col: str, size: int, step: int, mode: str = "full") -> DataFrame:
    """Each row once for each window that holds it: ``window`` and ``t``, its place there."""
    total = df.groupBy(*keys).agg((F.max(ord_col) + 1).alias("__n"))
    o = F.col(ord_col)
    first = F.greatest(F.floor((o - size) / step) + 1, F.lit(0)).cast("long")
    last = F.least(F.floor(o / step), n_windows(F.col("__n"), size, step, mode) - 1).cast("long")
    laid = df.join(F.broadcast(total) if not keys else total, keys) if keys else df.crossJoin(F.broadcast(total))
    return laid.where(last >= first).withColumn("window", F.explode(F.sequence(first, last))).withColumn("t", (o - F.col("window") * step).cast("int")).drop("__n")


def window_scores(windowed: DataFrame, keys: list[str], founder: str, cell: str) -> DataFrame:
    """For each window and founder: the sum of cells and the longest run of cells equal to 1, added."""
    from haploom.operators.islands import longest_run

    group = [*keys, "window", founder]
    runs = longest_run(windowed, group, ["t"], cell)
    sums = windowed.groupBy(*group).agg(F.sum(cell).alias("total"))
    return sums.join(runs, group).withColumn("score", F.col("total") + F.col("longest"))


def top_founders(scores: DataFrame, keys: list[str], founder: str, n: int, exclude: list[int] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """The n founders of the largest scores of each window (equal ones by number): rank from 1, founder, score.

    ``exclude`` never takes part. ``weights`` (founder, weight) multiply the scores of what was chosen;
    founders without a weight have 1.
    """
    left = scores.where(~F.col(founder).isin(exclude)) if exclude else scores
    order = W.partitionBy(*keys, "window").orderBy(F.desc("score"), founder)
    top = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*keys, "window", "rank", founder, "score")
    if weights is None:
        return top
    return top.join(weights.select(founder, "weight"), founder, "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).select(*keys, "window", "rank", founder, "score")


def majority_vote(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each key, the lowest of equal ones."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("__n"), -F.col(label))).alias(label), F.max("__n").alias("votes"))


def owned(windowed: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """Of overlapping windows, each ordinal from the one whose middle owns it: borders lie half a window
    into the overlap; the first keeps its head, the last its tail."""
    last = windowed.groupBy(*keys).agg(F.max("window").alias("__last"))
    border = (step + size) // 2
    low = F.when(F.col("window") == 0, 0).otherwise(border - step)
    high = F.when(F.col("window") == F.col("__last"), size).otherwise(border)
    return windowed.join(last, keys).where((F.col("t") >= low) & (F.col("t") < high)).drop("__last")


def knn(sites: DataFrame, keys: list[str], by: list, k: int, window: int, diploid: bool = False, threshold: float = 0.9) -> DataFrame:
    """Founders of each site by sums over a centred window of ``window`` (odd) sites, cut at the ends.

    The two founders of the largest sums, of equal ones the higher index first. Haploid: the best twice.
    Diploid: both, if (s1 - s2) / (s1 + s2) is below the threshold, an empty sum counting as 0.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    frame = W.partitionBy(*keys).orderBy(*by).rowsBetween(-half, half)
    sums = F.array(*(F.sum(F.element_at("features", i + 1)).over(frame) for i in range(k)))
    ranked = sites.withColumn("__s", sums).withColumn("__r", F.slice(F.reverse(F.array_sort(F.transform("__s", lambda x, i: F.struct(x.alias("s"), i.alias("i"))))), 1, 2))
    s1, s2 = F.col("__r")[0]["s"], F.col("__r")[1]["s"]
    p1, p2 = F.col("__r")[0]["i"], F.col("__r")[1]["i"]
    share = F.coalesce((s1 - s2) / F.nullif(s1 + s2, F.lit(0)), F.lit(0.0))
    second = F.when(share < threshold, p2).otherwise(p1) if diploid else p1
    return ranked.withColumn("p1", p1.cast("int")).withColumn("p2", second.cast("int")).drop("__s", "__r")


def padded_windows(sites: DataFrame, keys: list[str], ord_col: str, size: int, k: int, label: str | None = None) -> DataFrame:
    """Tumbling windows that hold all rows; the last is filled up with zero cells (and label k)."""
    total = sites.groupBy(*keys).agg((F.max(ord_col) + 1).alias("__n"))
    every = total.withColumn(ord_col, F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("__n") / size) * size - 1).cast("long")))).drop("__n")
    out = every.join(sites, [*keys, ord_col], "left").withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0), k)))
    if label:
        out = out.withColumn(label, F.coalesce(label, F.lit(k)))
    return out.withColumn("window", F.floor(F.col(ord_col) / size)).withColumn("t", (F.col(ord_col) % size).cast("int"))


def smoothed(df: DataFrame, keys: list[str], value: str, by_key: bool = True) -> DataFrame:
    """z-scores of a value, within each key or over all rows."""
    if by_key:
        w = W.partitionBy(*keys)
        return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif(F.col("__d"), F.lit(0.0))).drop("__m", "__d")
