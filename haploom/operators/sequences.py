"""Sequences from variant blocks: gaps, fills, down-sampling, recombinant assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.operators.order import hashed_uniform, numbered, running_sum
from haploom.session import staged


def blocks_to_sequence(blocks: DataFrame, reference: DataFrame, fill: str = "N", no_call: str = "N") -> DataFrame:
    """contig, seq of a sample from ordered blocks (contig, start, end, alt; 1-based, closed; null alt: reference).

    What no block covers is filled with N, the reference or nothing (``fill``: 'N', 'ref', 'none'). An
    alt of '.' is a no call, written by the same choice. Contigs without blocks are the reference whole.
    """
    order = W.partitionBy("contig").orderBy("start")
    laid = blocks.withColumn("__end", F.lag("end").over(order)).withColumn("__last", F.lead("start").over(order).isNull()).join(reference, "contig")
    piece = lambda how, a, b: F.lit("") if how == "none" else F.repeat(F.lit("N"), F.greatest(b - a + 1, F.lit(0)).cast("int")) if how == "N" else F.substring(F.col("seq"), a.cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int"))
    before = piece(fill, F.coalesce(F.col("__end"), F.lit(0)) + 1, F.col("start") - 1)
    own = F.when(F.col("alt").isNull(), piece("ref", F.col("start"), F.col("end"))).when(F.col("alt") == ".", piece(no_call, F.col("start"), F.col("end"))).otherwise(F.col("alt"))
    after = F.when(F.col("__last"), piece(fill, F.col("end") + 1, F.length("seq"))).otherwise("")
    parts = laid.select("contig", "start", F.concat(before, own, after).alias("part"))
    joined = parts.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("seq"))
    return joined.unionByName(reference.join(blocks, "contig", "left_anti").select("contig", "seq"))


def out_of_order(blocks: DataFrame) -> DataFrame:
    """Blocks that begin at or before the one before them, by their order in the file."""
    order = W.partitionBy("contig").orderBy("ord")
    return blocks.withColumn("__s", F.lag("start").over(order)).where(F.col("start") <= F.col("__s")).drop("__s")


def marked_blocks(records: DataFrame, rate: float, min_block: int, seed: int) -> DataFrame:
    """Records (contig, start, end, is_ref) with ``block`` and ``kept``, written once: what ``downsample_blocks`` keeps
    and the blocks' sizes are both read from it.

    A draw is made at the first variant after a reference block of ``min_block`` or more, and at a contig's first
    variant; ``block`` numbers the draws of a contig (a record before the first has 0), ``drawn`` tells the variants where they are made. Blocks
    are counted by ranges of records (``order.running_sum``), not in one task a contig.
    """
    qualifies = (F.col("is_ref") & (F.col("end") - F.col("start") + 1 >= min_block)).cast("long")
    seen = running_sum(records, ["start", "end"], qualifies, ["contig"], "__seen")
    # of the variants between two qualifying blocks the first one draws
    first = seen.where("NOT is_ref").groupBy("contig", "__seen").agg(F.min(F.struct("start", "end")).alias("__first"))
    told = seen.join(first, ["contig", "__seen"], "left").withColumn("drawn", ~F.col("is_ref") & (F.struct("start", "end") == F.col("__first")))
    told = running_sum(told.drop("__first", "__seen"), ["start", "end"], F.col("drawn").cast("long"), ["contig"], "block").withColumn("block", F.col("block") + F.col("drawn").cast("long"))
    return staged(told.withColumn("kept", (F.col("block") == 0) | (hashed_uniform("contig", "block", seed=seed) < rate)), "marked")


def kept_records(marked: DataFrame, keep_ref: bool = True) -> DataFrame:
    """Variants of kept blocks, and reference records: all of them, or those of kept blocks."""
    return marked.where("kept OR is_ref" if keep_ref else "kept")


def block_sizes(marked: DataFrame) -> DataFrame:
    """contig, start, size, id of every change between keeping and dropping: the distance from the change before it (from
    0, if it is the first) and what ends there, 'query' (kept until now) or 'ref'. A contig begins as kept."""
    draws = marked.where("drawn").select("contig", "block", "start", "kept")
    before = draws.select("contig", (F.col("block") + 1).alias("block"), F.col("kept").alias("__before"))
    changes = draws.join(before, ["contig", "block"], "left").where(F.coalesce("__before", F.lit(True)) != F.col("kept"))
    placed = numbered(changes.select("contig", "start", "kept"), ["start"], ["contig"], "__n")
    last = placed.select("contig", (F.col("__n") + 1).alias("__n"), F.col("start").alias("__from"))
    return placed.join(last, ["contig", "__n"], "left").select("contig", "start", (F.col("start") - F.coalesce("__from", F.lit(0))).alias("size"), F.when(F.col("kept"), "ref").otherwise("query").alias("id"))


def downsample_blocks(records: DataFrame, rate: float, min_block: int, seed: int) -> DataFrame:
    """Keep or drop whole stretches of records: the draw is made anew only at the first variant after a
    reference block of ``min_block`` or more, or on a new contig."""
    order = W.partitionBy("contig").orderBy("start")
    until = order.rowsBetween(W.unboundedPreceding, 0)
    qualifies = (F.col("is_ref") & (F.col("end") - F.col("start") + 1 >= min_block)).cast("int")
    marked = records.withColumn("__seen", F.coalesce(F.sum(qualifies).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("block", F.max(F.when(~F.col("is_ref"), F.col("__seen"))).over(until)).withColumn("block", F.coalesce("block", F.lit(0)))
    return marked.where(hashed_uniform("contig", "block", seed=seed) < rate).drop("__seen")


def assemble(pieces: DataFrame, sequences: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """keys, seq: ranges (parent, contig, start, end; 0-based, half open) of sequences laid end to end."""
    cut = pieces.join(sequences, ["parent", "contig"]).withColumn("__p", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return cut.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("__p").alias("p")))), lambda x: x["p"]), "").alias("seq"))


def wrapped(seq, width: int = 60):
    """A sequence in lines of a width."""
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")
