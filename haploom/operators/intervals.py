"""Intervals: repair, offsets, range joins, nearest sites, tolerance joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.operators.order import natural_key, numbered


def make_contiguous(df: DataFrame, lengths: DataFrame | None = None, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Close gaps and overlaps at their midpoints; each chromosome begins at 0 and ends at its length.

    ``lengths``: (chrom, length). An interval that would end before its start has no length.
    """
    order = W.partitionBy(chrom).orderBy(start, end)
    s, e = F.col(start), F.col(end)
    before, after = F.lag(e).over(order), F.lead(s).over(order)
    out = df.withColumn("__s", F.when(before.isNull(), F.lit(0)).otherwise(F.floor((before + s) / 2))).withColumn("__last", after.isNull()).withColumn("__e", F.floor((e + after) / 2))
    out = out.join(lengths.select(F.col(chrom), F.col("length").alias("__len")), chrom, "left") if lengths is not None else out.withColumn("__len", F.lit(None).cast("long"))
    out = out.withColumn("__e", F.when(F.col("__last"), F.coalesce("__len", e)).otherwise(F.col("__e")))
    return out.withColumn(start, F.col("__s").cast("long")).withColumn(end, F.greatest("__e", "__s").cast("long")).drop("__s", "__e", "__last", "__len")


def adjust_coords(df: DataFrame, lengths: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Each start becomes the end before it (the first 0), the last end the length; empty ones go."""
    order = W.partitionBy(chrom).orderBy(start, end)
    out = df.withColumn("__s", F.coalesce(F.lag(end).over(order), F.lit(0))).withColumn("__last", F.lead(start).over(order).isNull())
    out = out.join(lengths.select(F.col(chrom), F.col("length").alias("__len")), chrom, "left")
    out = out.withColumn(end, F.when(F.col("__last"), F.coalesce("__len", F.col(end))).otherwise(F.col(end)).cast("long")).withColumn(start, F.col("__s").cast("long"))
    return out.where(F.col(start) != F.col(end)).drop("__s", "__last", "__len")


def running_offsets(df: DataFrame, partition: list[str], by: list, length: Column) -> DataFrame:
    """fa_start and fa_end of pieces laid end to end."""
    order = W.partitionBy(*partition).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("fa_end", F.sum(length).over(order)).withColumn("fa_start", F.col("fa_end") - length)


def shift(df: DataFrame, by: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals moved by a constant."""
    return df.withColumn(start, F.col(start) + by).withColumn(end, F.col(end) + by)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, low: str, high: str, bucket: int, closed: bool = True, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them, by buckets of positions.

    An interval is listed under each bucket it touches, a point under its own, so the join is an
    equi-join on (keys, bucket) that shuffles and can be split on skew, not a nested loop. ``bucket``
    should be near the usual interval length. ``closed``: the upper end belongs to the interval.
    ``how``: 'inner', or 'left' to keep points that no interval holds, with nulls.
    """
    top = F.col(high) if closed else F.col(high) - 1
    laid = intervals.where(top >= F.col(low)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(top / bucket))))
    own = points.withColumn("__b", F.floor(F.col(pos) / bucket))
    hit = own.alias("p").join(laid.alias("i"), [*keys, "__b"], "inner").where((F.col(pos) >= F.col(low)) & (F.col(pos) <= F.col(high) if closed else F.col(pos) < F.col(high)))
    hit = hit.drop("__b")
    if how == "inner":
        return hit
    held = hit.select(*keys, pos).distinct()
    none = points.alias("p").join(held.alias("h"), [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*keys, pos)], "left_anti")
    return hit.unionByName(none, allowMissingColumns=True)


def label_points(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, low: str, high: str, label: str, ord_col: str, bucket: int, closed: bool = True, default=None) -> DataFrame:
    """Each point with the label of the last interval (by ``ord_col``) that holds it, else ``default``."""
    wanted = points.select(*keys, pos).distinct()
    hit = interval_join(wanted, intervals.select(*keys, low, high, label, ord_col), keys, pos, low, high, bucket, closed)
    best = hit.groupBy(*keys, pos).agg(F.max_by(label, ord_col).alias(label))
    out = points.join(best, [*keys, pos], "left")
    return out if default is None else out.withColumn(label, F.coalesce(label, F.lit(default)))


def nearest_site(queries: DataFrame, sites: DataFrame, keys: list[str], target: str, pos: str, bucket: int = 1 << 16) -> DataFrame:
    """Each query with the nearest site of its key, the greater of two at the same distance.

    Sites and queries are ordered together, within buckets of positions and then over each bucket's
    first and last site, so that a long key is not one task.
    """
    found = sites.select(*keys, F.col(pos).alias("__at")).distinct()
    asked = queries.select(*keys, F.col(target).alias("__at")).distinct()
    both = found.withColumn("__own", F.col("__at")).unionByName(asked.withColumn("__own", F.lit(None).cast(found.schema["__at"].dataType))).withColumn("__b", F.floor(F.col("__at") / bucket))
    # frames that only look back are kept up row by row; a frame to the end would be added up anew for each row
    inside, back = (W.partitionBy(*keys, "__b").orderBy(o) for o in (F.asc("__at"), F.desc("__at")))
    near = both.withColumn("__lo", F.max("__own").over(inside.rangeBetween(W.unboundedPreceding, 0))).withColumn("__hi", F.min("__own").over(back.rangeBetween(W.unboundedPreceding, 0)))
    edge = both.groupBy(*keys, "__b").agg(F.min("__own").alias("__first"), F.max("__own").alias("__last"))
    over, down = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("__b"), F.desc("__b")))
    edge = edge.withColumn("__below", F.max("__last").over(over)).withColumn("__above", F.min("__first").over(down))
    told = near.where("__own IS NULL").join(edge, [*keys, "__b"]).withColumn("__lo", F.coalesce("__lo", "__below")).withColumn("__hi", F.coalesce("__hi", "__above"))
    lo, hi, at = F.col("__lo"), F.col("__hi"), F.col("__at")
    best = F.when(lo.isNull(), hi).when(hi.isNull(), lo).when(hi - at <= at - lo, hi).otherwise(lo)
    return queries.join(told.select(*keys, at.alias(target), best.alias("nearest")), [*keys, target], "left")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], pos: str, tol: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` within ``tol`` of them, as an equi-join on buckets."""
    size = 2 * tol + 1
    near = right.select(*keys, F.col(pos).alias("__p")).distinct().withColumn("__b", F.explode(F.array(*(F.floor((F.col("__p") + d) / size) for d in (-tol, tol)))))
    own = left.withColumn("__b", F.floor(F.col(pos) / size))
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.__b") == F.col("r.__b"), F.abs(F.col(f"l.{pos}") - F.col("r.__p")) <= tol]
    return own.alias("l").join(near.alias("r"), cond, "left_semi").drop("__b")


def region_codes(df: DataFrame, chrom: str = "chrom", start: str = "start", ord_col: str = "ord") -> DataFrame:
    """chrom, region, parent, code: the filled cells of a matrix of regions and parents. Regions are numbered
    by start, equal ones by their place in the file, by ranges of rows; code 1: first parent, 2: second, 3: both."""
    placed = numbered(df.select(chrom, start, ord_col, "parent1", "parent2"), [start, ord_col], [chrom], "region").withColumn("region", F.col("region").cast("int"))
    cell = lambda c, code: F.struct(F.col(c).alias("parent"), F.lit(code).alias("code"))
    # a region is one row, so its cells need not be gathered
    cells = F.when(F.col("parent1") == F.col("parent2"), F.array(cell("parent1", 3))).otherwise(F.array(cell("parent1", 1), cell("parent2", 2)))
    return placed.select(chrom, "region", F.explode(cells).alias("x")).select(chrom, "region", "x.*").where("parent IS NOT NULL")


def region_matrix(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", ord_col: str = "ord", block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(matrix, paths): each contig's regions against its parents, as compressed rows in blocks of regions.

    ``matrix``: chrom, block, regions (start, end of each), offsets, parents, codes: the cells of region r of a block are
    those from ``offsets[r]`` to before ``offsets[r + 1]``, a parent's number and its code (1: first parent, 2:
    second, 3: both). ``paths``: chrom, block, parent1, parent2: the parents' numbers along the regions. Parents are numbered within
    a contig in natural order, regions by start, equal ones by their place in the file. A region without a parent is
    left out. No row holds more than a block, and regions are numbered by ranges.
    """
    held = df.where("parent1 IS NOT NULL AND parent2 IS NOT NULL").withColumns({c: F.col(c).cast("string") for c in ("parent1", "parent2")})
    names = held.select(chrom, F.explode(F.array("parent1", "parent2")).alias("__p")).distinct()
    key, text = natural_key(F.col("__p"))
    parents = numbered(names.withColumn("__key", key), [F.asc_nulls_first("__key"), "__p"], [chrom], "__n").select(chrom, "__p", F.col("__n").cast("int").alias("__n"))
    placed = numbered(held.select(chrom, start, end, ord_col, "parent1", "parent2"), [start, ord_col], [chrom], "__r")
    for c in ("parent1", "parent2"):
        placed = placed.join(parents.withColumnsRenamed({"__p": c, "__n": f"__{c}"}), [chrom, c])
    one, two = F.col("__parent1"), F.col("__parent2")
    cell = lambda p, code: F.struct(p.alias("p"), F.lit(code).alias("code"))
    cells = F.when(one == two, F.array(cell(one, 3))).when(one < two, F.array(cell(one, 1), cell(two, 2))).otherwise(F.array(cell(two, 2), cell(one, 1)))
    row = F.struct(F.col("__r").alias("r"), F.col(start).alias("start"), F.col(end).alias("end"), one.alias("p1"), two.alias("p2"), F.col("__off").alias("off"), F.col("__cells").alias("cells"))
    blocked = placed.withColumn("block", F.floor(F.col("__r") / block)).withColumn("__cells", cells)
    before = W.partitionBy(chrom, "block").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    counted = blocked.withColumn("__off", F.coalesce(F.sum(F.size("__cells")).over(before), F.lit(0)).cast("int"))
    rows = counted.groupBy(chrom, "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    flat = F.flatten("rows.cells")
    offsets = F.concat("rows.off", F.array(F.size(flat)))
    regions = F.transform("rows", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    matrix = rows.select(chrom, "block", regions.alias("regions"), offsets.alias("offsets"), F.transform(flat, lambda x: x["p"]).alias("parents"), F.transform(flat, lambda x: x["code"]).alias("codes"))
    return matrix, rows.select(chrom, "block", F.col("rows.p1").alias("parent1"), F.col("rows.p2").alias("parent2"))


def lift_over(points: DataFrame, blocks: DataFrame, keys: list[str], pos: str, bucket: int) -> DataFrame:
    """Points in the coordinates of another assembly: blocks (keys, start, end, target, target_start, strand)."""
    hit = interval_join(points, blocks, keys, pos, "start", "end", bucket, closed=False)
    forward = F.col("target_start") + F.col(pos) - F.col("start")
    backward = F.col("target_start") + F.col("end") - 1 - F.col(pos)
    return hit.withColumn("target_pos", F.when(F.col("strand") == "-", backward).otherwise(forward))
