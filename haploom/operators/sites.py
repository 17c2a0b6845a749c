"""Site-by-founder tables: encode, collapse, densify, pack, mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Counts are capped at this value.
CAP = 127


def multihot(members: Column, k: int) -> Column:
    """A set of indices as 0/1 cells; indices beyond k are dropped."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.array_contains(members, i).cast("int"), F.lit(0)))


def counted(members: Column, count: Column, k: int) -> Column:
    """A set of indices as capped counts."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.array_contains(members, i), F.least(count, F.lit(CAP))).otherwise(0))


def collapse_sets(reads: DataFrame, keys: list[str], members: str, count: str, first: str | None = None, ord_col: str = "ord") -> DataFrame:
    """One row for each site: the sorted union of its sets, the sum of its counts, and ``first`` of its first row by ``ord_col``."""
    more = [F.min_by(first, ord_col).alias(first)] if first else []
    return reads.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(members)))).alias(members), F.sum(count).alias(count), *more)


def founder_counts(reads: DataFrame, keys: list[str], members: str, count: str) -> DataFrame:
    """Long form: the summed count of every founder of a site."""
    return reads.select(*keys, F.explode(F.array_distinct(members)).alias("founder"), F.col(count).alias("__c")).groupBy(*keys, "founder").agg(F.sum("__c").alias("n"))


def features(reads: DataFrame, keys: list[str], members: str, count: str, k: int, cap: bool = True) -> DataFrame:
    """Dense form: an array of k summed counts for each site, summed before anything is gathered."""
    n = lambda i: F.sum(F.when(F.array_contains(members, F.lit(i)), F.col(count)).otherwise(0))
    cells = [F.least(n(i), F.lit(CAP)) if cap else n(i) for i in range(k)]
    return reads.groupBy(*keys).agg(F.array(*cells).cast("array<int>").alias("features"))


def labelled(reads: DataFrame, keys: list[str], members: str, count: str, k: int, labels: list[str], ord_col: str = "ord", cap: bool = True) -> DataFrame:
    """``features`` with the labels of each site's first row by ``ord_col``; no label is -1."""
    n = lambda i: F.sum(F.when(F.array_contains(members, F.lit(i)), F.col(count)).otherwise(0))
    cells = [F.least(n(i), F.lit(CAP)) if cap else n(i) for i in range(k)]
    # a struct is never null, so a first row without a label is not passed over
    own = F.min_by(F.struct(*labels), ord_col)
    return reads.groupBy(*keys).agg(F.array(*cells).cast("array<int>").alias("features"), own.alias("__l")).select(*keys, "features", *(F.coalesce(F.col(f"__l.{c}"), F.lit(-1)).alias(c) for c in labels))


def fill_bins(sites: DataFrame, keys: list[str], bin_col: str, last: DataFrame, k: int) -> DataFrame:
    """All bins from 0 to each key's last one (``last``: keys, last_bin); absent ones hold zeros."""
    every = last.withColumn(bin_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_bin").cast("long")))).drop("last_bin")
    return every.join(sites, [*keys, bin_col], "left").withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0), k)))


def pack_bits(cells: Column) -> Column:
    """Up to 63 0/1 cells as the bits of a number, the first lowest."""
    marks = F.zip_with(cells, F.sequence(F.lit(0), F.size(cells) - 1), lambda x, i: F.when(x != 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def unpack_bits(packed: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.call_function("shiftright", packed, i).bitwiseAND(F.lit(1)).cast("int"))


def pair_index(i: Column, j: Column, k: int) -> Column:
    """Place of the unordered pair {i, j} among pairs i <= j of k founders."""
    a, b = F.least(i, j), F.greatest(i, j)
    return (a * k - F.floor(a * (a - 1) / 2) + (b - a)).cast("int")


def pair_members(index: Column, k: int) -> tuple[Column, Column]:
    """The founders i <= j of a pair's place, the inverse of ``pair_index``; null outside the pairs of k."""
    inside = F.when((index >= 0) & (index < k * (k + 1) // 2), index)
    i = F.floor((2 * k + 1 - F.sqrt(F.lit((2 * k + 1) ** 2) - 8 * inside)) / 2)
    return i.cast("int"), (inside - (i * k - F.floor(i * (i - 1) / 2)) + i).cast("int")


def soft_label(label: Column, k: int, share: float) -> Column:
    """A label as k probabilities: ``share`` is spread over all, the rest stands at the label."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(share / k) + F.when(i == label, 1 - share).otherwise(0.0))


def pair_states(spark, k: int) -> DataFrame:
    """All unordered pairs with their places."""
    one = spark.range(k).select(F.col("id").cast("int").alias("i"))
    two = spark.range(k).select(F.col("id").cast("int").alias("j"))
    return one.join(F.broadcast(two), F.col("i") <= F.col("j")).withColumn("pair", pair_index(F.col("i"), F.col("j"), k))


def switches(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    """Founders that change between two unordered pairs: 0, 1 or 2."""
    ne = lambda x, y: (x != y).cast("int")
    return F.least(ne(i1, i2) + ne(j1, j2), ne(i1, j2) + ne(j1, i2))


def switch_matrix(spark, k: int) -> DataFrame:
    """Founders that change between every two unordered pairs: 0, 1 or 2."""
    p = pair_states(spark, k)
    a, b = p.select(F.col("pair").alias("p"), F.col("i").alias("i1"), F.col("j").alias("j1")), p.select(F.col("pair").alias("q"), F.col("i").alias("i2"), F.col("j").alias("j2"))
    return a.crossJoin(F.broadcast(b)).select("p", "q", switches(*map(F.col, ("i1", "j1", "i2", "j2"))).alias("switches"))


def mask_sites(sites: DataFrame, keys: list[str], k: int, fraction: float, seed: int) -> DataFrame:
    """Zero whole sites with a given probability, by a hash of their keys; ``masked`` tells which."""
    from haploom.operators.order import hashed_uniform

    m = hashed_uniform(*keys, seed=seed) < fraction
    return sites.withColumn("masked", m).withColumn("features", F.when(m, F.array_repeat(F.lit(0), k)).otherwise(F.col("features")))


def normalise_label(label: Column, k: int) -> Column:
    """-1 and null become k (unknown), others stay within 0 to k."""
    return F.when(label.isNull() | (label < 0), F.lit(k)).otherwise(F.least(label, F.lit(k)))


def pad(cells: Column, k: int, value=0) -> Column:
    """Cells padded to k."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(value), k)), 1, k)


def positional(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """pos_minmax (0 to 127, truncated), pos_z and pos_log of positions within their key."""
    w = W.partitionBy(*keys)
    low, high = F.min(pos).over(w), F.max(pos).over(w)
    share = F.when(high > low, (F.col(pos) - low) / (high - low)).otherwise(0.0)
    z = (F.col(pos) - F.avg(pos).over(w)) / (F.stddev_pop(pos).over(w) + 1e-8)
    return df.withColumn("pos_minmax", F.floor(share * CAP).cast("int")).withColumn("pos_z", z).withColumn("pos_log", F.log10(F.col(pos) + 1))


def adjacent_jaccard(df: DataFrame, keys: list[str], by: list, cells: str = "features") -> DataFrame:
    """One less the mean Jaccard similarity of adjacent sites, a proxy of heterozygosity; empty unions count 1."""
    order = W.partitionBy(*keys).orderBy(*by)
    both = df.withColumn("__before", F.lag(cells).over(order)).where(F.col("__before").isNotNull())
    hit = lambda how: F.aggregate(F.zip_with(cells, "__before", how), F.lit(0), lambda a, b: a + b)
    inter, union = hit(lambda x, y: ((x != 0) & (y != 0)).cast("int")), hit(lambda x, y: ((x != 0) | (y != 0)).cast("int"))
    return both.withColumn("__j", F.when(union == 0, 1.0).otherwise(inter / union)).groupBy(*keys).agg((1 - F.avg("__j")).alias("het_proxy"))


def het_scale(proxy: Column, inbred: float, outbred: float) -> Column:
    """A proxy of heterozygosity from 0 (inbred or less) to 1 (outbred or more)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (proxy - inbred) / (outbred - inbred)))


def decode_position(code: Column) -> tuple[Column, Column]:
    """(contig index, position) of a packed 32-bit position: 8 bits of contig, 24 of bins of 256."""
    return F.call_function("shiftright", code, F.lit(24)).bitwiseAND(F.lit(255)).cast("int"), code.bitwiseAND(F.lit(16777215)) * 256
