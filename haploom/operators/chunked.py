"""Sequences of any length as rows of a fixed number of bases: (contig, chunk, bases).

Ranges are fetched, recombinants assembled and gaps filled by equi-joins on (contig, chunk); what is made is a table
of chunks again. No row and no group holds more than a chunk and the pieces that fall into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haploom.operators.order import numbered, running_sum

#: Bases of a chunk; a multiple of the width of FASTA lines, so that chunks are wrapped each by itself.
SIZE = 61_440


def _chunks(start: Column, end: Column, size: int) -> Column:
    """The chunks that a range (half open, not empty) meets."""
    return F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size)))


def stitch(parts: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, chunk, bases of parts laid side by side: keys, to (place of the first base), n, bases (null: a run of N)."""
    laid = parts.where("n > 0").withColumn("chunk", _chunks(F.col("to"), F.col("to") + F.col("n"), size))
    begin, end = F.greatest(F.col("to"), F.col("chunk") * size), F.least(F.col("to") + F.col("n"), (F.col("chunk") + 1) * size)
    width = (end - begin).cast("int")
    text = F.when(F.col("bases").isNull(), F.repeat(F.lit("N"), width)).otherwise(F.substring(F.col("bases"), (begin - F.col("to") + 1).cast("int"), width))
    pieces = laid.select(*keys, "chunk", F.struct(begin.alias("at"), text.alias("text")).alias("piece"))
    return pieces.groupBy(*keys, "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"]), "").alias("bases"))


def cut(sequences: DataFrame, size: int = SIZE) -> DataFrame:
    """contig, chunk, bases of whole sequences (contig, seq)."""
    return stitch(sequences.select("contig", F.lit(0).cast("long").alias("to"), F.length("seq").cast("long").alias("n"), F.col("seq").alias("bases")), ["contig"], size)


def lengths(store: DataFrame, size: int = SIZE) -> DataFrame:
    """contig, length."""
    return store.groupBy("contig").agg(F.max(F.col("chunk") * size + F.length("bases")).alias("length"))


def parts_of(ranges: DataFrame, store: DataFrame, size: int = SIZE) -> DataFrame:
    """Each range (contig, start, end; 0-based, half open) as the pieces of chunks that it covers: ``at`` (place in the
    contig) and ``bases``. Ranges are cut at a contig's end."""
    asked = ranges.where("end > start").withColumn("chunk", _chunks(F.col("start"), F.col("end"), size))
    begin, end = F.greatest(F.col("start"), F.col("chunk") * size), F.least(F.col("end"), (F.col("chunk") + 1) * size)
    joined = asked.join(store.select("contig", "chunk", F.col("bases").alias("__b")), ["contig", "chunk"])
    text = F.substring(F.col("__b"), (begin - F.col("chunk") * size + 1).cast("int"), (end - begin).cast("int"))
    return joined.select(*ranges.columns, begin.alias("at"), text.alias("bases")).where("bases <> ''")


def fetch(ranges: DataFrame, store: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Every range, named by its keys, with its sequence in one row: for ranges of a size that a row can hold. An empty
    range, or one that lies outside its contig, has an empty sequence."""
    found = parts_of(ranges, store, size).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "bases"))), lambda p: p["bases"]), "").alias("seq"))
    return ranges.join(found, keys, "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def assemble(pieces: DataFrame, store: DataFrame, keys: list[str], order: str = "ord", size: int = SIZE) -> DataFrame:
    """keys, chunk, bases: ranges (contig, start, end; inside their contigs) of a store, laid end to end in order.

    Where a piece goes is the sum of the lengths before it, by ranges (``order.running_sum``): neither the
    pieces of a sequence nor its bases meet in one task.
    """
    placed = running_sum(pieces.where("end > start"), [order], F.col("end") - F.col("start"), keys, "to")
    parts = parts_of(placed, store, size).withColumn("to", F.col("to") + F.col("at") - F.col("start"))
    return stitch(parts.select(*keys, "to", F.length("bases").cast("long").alias("n"), "bases"), keys, size)


def fill(blocks: DataFrame, store: DataFrame, gap: str = "N", no_call: str = "N", size: int = SIZE) -> DataFrame:
    """contig, chunk, bases of a sample from its blocks (contig, start, end, alt; 1-based, closed; null alt: reference).

    What no block covers is N, the reference or nothing (``gap``: 'N', 'ref', 'none'), and so is an alt of
    '.' (``no_call``). Contigs without blocks are the reference whole; blocks of contigs that the store lacks are left out.
    """
    total = lengths(store, size)
    known = numbered(blocks.join(total, "contig"), ["start"], ["contig"], "__i")
    earlier = known.select("contig", (F.col("__i") + 1).alias("__i"), F.col("end").alias("__end"))
    with_end = known.join(earlier, ["contig", "__i"], "left").withColumn("__end", F.coalesce("__end", F.lit(0)))
    kind = lambda how: F.lit({"N": "run", "ref": "ref", "none": "none"}[how])
    own = F.when(F.col("alt").isNull(), F.lit("ref")).when(F.col("alt") == ".", kind(no_call)).otherwise(F.lit("alt"))
    piece = lambda side, how, a, b, text: F.struct(F.lit(side).alias("side"), how.alias("how"), a.alias("start"), b.alias("end"), text.alias("alt"))
    none = F.lit(None).cast("string")
    two = F.explode(F.array(piece(0, kind(gap), F.col("__end"), F.col("start") - 1, none), piece(1, own, F.col("start") - 1, F.col("end"), F.col("alt"))))
    inner = with_end.select("contig", F.col("__i").alias("i"), two.alias("p")).select("contig", "i", "p.*")
    last = blocks.groupBy("contig").agg(F.max_by("end", "start").alias("__end"), F.count("*").alias("i"))
    tail = total.join(last, "contig", "left").select(
        "contig", F.coalesce("i", F.lit(0)).alias("i"), F.lit(0).alias("side"), F.when(F.col("__end").isNull(), F.lit("ref")).otherwise(kind(gap)).alias("how"),
        F.coalesce("__end", F.lit(0)).cast("long").alias("start"), F.col("length").alias("end"), none.alias("alt"),
    )
    every = inner.unionByName(tail)
    n = F.when(F.col("how") == "alt", F.length("alt")).when(F.col("how") == "none", 0).otherwise(F.greatest(F.col("end") - F.col("start"), F.lit(0))).cast("long")
    placed = running_sum(every.withColumn("n", n).where("n > 0"), ["i", "side"], F.col("n"), ["contig"], "to")
    reference = parts_of(placed.where("how = 'ref'"), store, size).withColumn("to", F.col("to") + F.col("at") - F.col("start"))
    text = placed.where("how <> 'ref'").select("contig", "to", "n", F.when(F.col("how") == "alt", F.col("alt")).alias("bases"))
    return stitch(reference.select("contig", "to", F.length("bases").cast("long").alias("n"), "bases").unionByName(text), ["contig"], size)
