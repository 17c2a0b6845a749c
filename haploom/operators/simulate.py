"""Generators: crossovers, recombinant mosaics and allele sharing, each a function of a seed and an id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploom.session import staged


def crossover_positions(length: int, low: int, high: int, rng: np.random.Generator) -> list[int]:
    """Positions below ``length``: the first up to ``high``, then at uniform gaps of low to high; so the tail is
    no longer than ``high``. None where low and high do not fit the length."""
    if not 0 < low < high <= length:
        return []
    at = np.cumsum([rng.integers(0, high + 1), *rng.integers(low, high + 1, length // low + 1)])
    return at[at < length].tolist()


def crossover_range(dense: bool, sites: int) -> tuple[int, int]:
    """Fewest and most crossovers of a chromosome: 1 to 3, or if ``dense`` 2 to 10 for every 1024 sites."""
    if not dense:
        return 1, 3
    return max(1, round(2 * sites / 1024)), max(2, round(10 * sites / 1024))


def crossovers(spark: SparkSession, lengths: DataFrame, lines: int, low: int, high: int, seed: int) -> DataFrame:
    """line, chrom, pos: crossovers of each line and chromosome (``lengths``: chrom, length)."""
    grid = spark.range(lines).withColumnRenamed("id", "line").crossJoin(F.broadcast(lengths.select("chrom", F.col("length").cast("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line, chrom, length in pdf[["line", "chrom", "length"]].itertuples(index=False):
                rng = np.random.default_rng([seed, line, *chrom.encode()])
                rows += [(line, chrom, int(p)) for p in crossover_positions(length, low, high, rng)]
            yield pd.DataFrame(rows, columns=["line", "chrom", "pos"])

    return grid.mapInPandas(run, "line long, chrom string, pos long")


def mosaics(lengths: DataFrame, founders: list[str], rounds: int, low: int, high: int, seed: int) -> DataFrame:
    """line, chrom, start, end, founder after rounds of crossing pairs of lines, one chromosome a task.

    Each round pairs all lines anew (their number must be even) and draws crossovers for each pair. Those of
    all rounds act in the order of their positions: both lines of a pair go on with the other's founder. One
    that would leave a segment without length is passed over; neighbours of one founder stay apart.
    """
    if len(founders) % 2:
        raise ValueError("lines are crossed in pairs: their number must be even")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        chrom, length = pdf["chrom"].iloc[0], int(pdf["length"].iloc[0])
        rng = np.random.default_rng([seed, *chrom.encode()])
        events = []
        for _ in range(rounds):
            for x, y in rng.permutation(len(founders)).reshape(-1, 2).tolist():
                events += [(p, x, y) for p in crossover_positions(length, low, high, rng)]
        starts: list[list[int]] = [[0] for _ in founders]
        owners = [[n] for n in range(len(founders))]
        for p, x, y in sorted(events, key=lambda e: e[0]):
            if p > max(starts[x][-1], starts[y][-1]):
                ahead = owners[x][-1], owners[y][-1]
                for line, owner in ((y, ahead[0]), (x, ahead[1])):
                    starts[line].append(p)
                    owners[line].append(owner)
        rows = [(line, chrom, s, e, founders[o]) for line, own in enumerate(starts) for s, e, o in zip(own, [*own[1:], length], owners[line], strict=True)]
        return pd.DataFrame(rows, columns=["line", "chrom", "start", "end", "founder"])

    return lengths.groupBy("chrom").applyInPandas(one, "line long, chrom string, start long, end long, founder string")


def write_keys(mosaic: DataFrame, path: str) -> None:
    """A folder for each line: chrom, start, end, founder by tabs, in order, without a header."""
    laid = mosaic.repartition("line").sortWithinPartitions("line", "chrom", "start")
    laid.select("line", "chrom", "start", "end", "founder").write.mode("overwrite").partitionBy("line").option("sep", "\t").csv(path)


def allele_windows(spark: SparkSession, windows: int, sites: int, founders: int, switches: float, sharing: float, seed: int) -> DataFrame:
    """window, t, features, h1: founder paths with Poisson switches, and sites where founders that share a
    lineage with the true one match as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w in pdf["id"]:
                rng = np.random.default_rng([seed, int(w)])
                cuts = np.sort(rng.integers(1, sites, rng.poisson(switches))) if sites > 1 else []
                path = np.repeat(rng.integers(0, founders, len(cuts) + 1), np.diff([0, *cuts, sites]))
                lineage = rng.integers(0, max(1, int(founders / (1 + sharing))), (sites // 16 + 1, founders)).repeat(16, axis=0)[:sites]
                cells = (lineage == lineage[np.arange(sites), path][:, None]).astype(np.int32)
                out.append(pd.DataFrame({"window": int(w), "t": np.arange(sites, dtype=np.int32), "features": list(cells), "h1": path.astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["window", "t", "features", "h1"])

    return spark.range(windows).mapInPandas(run, "window long, t int, features array<int>, h1 int")


def segment_sizes(mosaic: DataFrame) -> DataFrame:
    """Base pairs of each founder and mean size of its segments."""
    return mosaic.groupBy("founder").agg(F.sum(F.col("end") - F.col("start")).alias("bp"), F.avg(F.col("end") - F.col("start")).alias("mean_size"))


def tree_walk(edges: DataFrame, samples: DataFrame, most: int = 64) -> DataFrame:
    """tree, node, root: the founder above each sample node (``edges``: tree, child, parent), by doubling hops
    until nothing moves; at most ``most`` generations. Each round is written, so plans stay small."""
    hops = staged(edges.select("tree", "child", "parent"), "hops")
    for _ in range(max(1, most.bit_length())):
        up = hops.select("tree", F.col("child").alias("parent"), F.col("parent").alias("__next"))
        hops = staged(hops.join(up, ["tree", "parent"], "left").select("tree", "child", F.coalesce("__next", "parent").alias("parent"), F.col("__next").isNotNull().alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return samples.join(hops, (samples.tree == hops.tree) & (samples.node == hops.child), "left").select(samples.tree, samples.node, F.coalesce("parent", "node").alias("root"))
