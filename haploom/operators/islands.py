"""Change points, segments and run collapse over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed(columns: list[str], order: W, nulls_differ: bool = True) -> Column:
    """Whether any column differs from the row before; the first row does. Nulls differ from each other by default."""
    out = None
    for c in columns:
        one = F.col(c) != F.lag(c).over(order) if nulls_differ else ~F.col(c).eqNullSafe(F.lag(c).over(order))
        out = one if out is None else out | one
    return F.coalesce(out, F.lit(True))


def with_segments(df: DataFrame, columns: list[str], by: list, partition: list[str], name: str = "run", nulls_differ: bool = True) -> DataFrame:
    """Number the runs of equal columns in each partition, from 1."""
    order = W.partitionBy(*partition).orderBy(*by)
    return df.withColumn("__new", changed(columns, order, nulls_differ).cast("int")).withColumn(name, F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def collapse_runs(df: DataFrame, partition: list[str], by: list, labels: list[str], start: str = "start", end: str | None = None) -> DataFrame:
    """One interval for each run of equal labels: the smallest start, the largest of ``end`` (or of the
    starts, so that a run of one site has no length), and the labels. Unlabelled rows never merge."""
    runs = with_segments(df, labels, by, partition)
    return runs.groupBy(*partition, "run").agg(F.min(start).alias("start"), F.max(end or start).alias("end"), *(F.first(c).alias(c) for c in labels), F.count("*").alias("n_sites")).drop("run")


def crossovers(df: DataFrame, partition: list[str], by: list, labels: list[str]) -> DataFrame:
    """Changes of any label along each partition, the first row not counted."""
    order = W.partitionBy(*partition).orderBy(*by)
    flag = changed(labels, order).cast("int")
    return df.withColumn("__c", F.when(F.row_number().over(order) > 1, flag).otherwise(0)).groupBy(*partition).agg(F.sum("__c").alias("crossovers"))


def longest_run(df: DataFrame, partition: list[str], by: list, cell: str) -> DataFrame:
    """The longest run of cells equal to exactly 1 in each partition."""
    runs = with_segments(df, [cell], by, partition)
    return runs.groupBy(*partition, "run").agg(F.sum((F.col(cell) == 1).cast("int")).alias("__n")).groupBy(*partition).agg(F.max("__n").alias("longest"))
