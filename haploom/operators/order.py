"""Order as data: natural keys, ordinals, top-k, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haploom.session import staged


def natural_key(name: Column) -> tuple[Column, Column]:
    """Sort keys of a contig or parent name: all its digits as a number, then the name itself."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    return F.when(digits != "", digits.cast("decimal(38,0)")), name


def natural_sort(df: DataFrame, name: str, *then: str) -> DataFrame:
    """Rows by natural order of ``name``, then by further columns."""
    number, text = natural_key(F.col(name))
    return df.orderBy(number.asc_nulls_first(), text, *then)


def version_key(name: Column) -> Column:
    """Sort key of version order: text and numbers in turn, numbers by value whatever their zeros and length.

    In texts the end comes first, but for '~' before it; then letters by their bytes, then all other characters.
    """
    text, digits = (F.regexp_extract_all(name, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(i)) for i in (1, 2))
    letter = lambda c: F.when(c == "~", -1).when(c.rlike("[A-Za-z]"), F.ascii(c)).otherwise(F.ascii(c) + 256)
    places = lambda t: F.concat(F.transform(F.filter(F.split(t, ""), lambda c: c != ""), letter), F.array(F.lit(0)))
    plain = lambda d: F.regexp_replace(d, "^0+", "")
    return F.transform(F.arrays_zip(text.alias("t"), digits.alias("d")), lambda x: F.struct(places(x["t"]).alias("t"), F.length(plain(x["d"])).alias("n"), plain(x["d"]).alias("d")))


def version_sort(df: DataFrame, name: str, *then: str) -> DataFrame:
    """Rows in version order of ``name``, then by further columns as they are (numbers by value), then by the name itself."""
    return df.orderBy(version_key(F.col(name)), *then, name)


def with_ordinal(df: DataFrame, by: list, partition: list[str] | None = None, name: str = "ord") -> DataFrame:
    """Number rows from 0 in a stated order, for each key of ``partition``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*(partition or [])).orderBy(*by)) - 1)


def _dealt(df: DataFrame, by: list, keys: list[str]) -> DataFrame:
    """Rows in ranges of (keys, order), so that a key may take many partitions; written once, with the number of each
    row's range (``__part``) and ``__id``, which ascends by one within a range."""
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *by]]
    laid = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__id", F.monotonically_increasing_id())
    # the upper bits of the id are the partition's number, the lower ones count its rows
    return staged(laid, "dealt").withColumn("__part", F.shiftright("__id", 33))


def _with_before(laid: DataFrame, keys: list[str], total) -> DataFrame:
    """Rows with the first id of their key in their range and the sum of ``total`` over the key's earlier ranges. Only
    one row for each range and key meets in a window."""
    sums = laid.groupBy("__part", *keys).agg(F.min("__id").alias("__first"), total.alias("__n"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    starts = starts.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(keys)}).withColumnRenamed("__part", "__own")
    same = F.col("__part") == F.col("__own")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return laid.join(starts, same)


def numbered(df: DataFrame, by: list, keys: list[str] | None = None, name: str = "ord") -> DataFrame:
    """``with_ordinal`` for keys of any size, or for the whole table, without a window over the rows.

    Ranges number their own rows, from where the counts of the ranges before them end. ``by`` should be a total order:
    equal rows lie in one range and are numbered in any order. A null key is a key of its own.
    """
    keys = keys or []
    joined = _with_before(_dealt(df, by, keys), keys, F.count("*"))
    return joined.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).select(*df.columns, name)


def running_sum(df: DataFrame, by: list, value: Column, keys: list[str] | None = None, name: str = "before") -> DataFrame:
    """The sum of a value over all earlier rows of each key, in the same way."""
    keys = keys or []
    laid = _dealt(df.withColumn("__v", value), by, keys)
    own = W.partitionBy("__part", *keys).orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    inside = laid.withColumn("__in", F.coalesce(F.sum("__v").over(own), F.lit(0)))
    return _with_before(inside, keys, F.sum("__v")).withColumn(name, F.col("__before") + F.col("__in")).select(*df.columns, name)


def distinct_in_order(df: DataFrame, value: str, by: list[str], name: str = "place") -> DataFrame:
    """Each value once, numbered by the first row (in the order of ``by``) that has it."""
    first = df.groupBy(value).agg(F.min(F.struct(*by)).alias("__first"))
    return numbered(first.select(value, "__first.*"), [*by, value], name=name).select(value, *by, name)


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Rows with a place in a random order that depends on their (unique) key and the seed alone."""
    return numbered(df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), ["__h", key], name=name).drop("__h")


def top_k_indices(values: Column, k: int, high_index_first: bool = False) -> Column:
    """Indices of the k largest elements; of equal ones the lower index first, or the higher."""
    sign = -1 if high_index_first else 1
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("v"), (F.lit(sign) * i).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])


def argmax(values: Column) -> Column:
    """Index of the largest element, the lowest of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_known(values: Column) -> Column:
    """Argmax over all but the last class, which stands for unknown."""
    return argmax(F.slice(values, 1, F.size(values) - 1))


def top_per_group(df: DataFrame, group: list[str], by: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*by))).where(F.col("__rn") <= k).drop("__rn")


def head_split(df: DataFrame, ord_col: str, total: int | Column, val: float, test: float, block: int = 1) -> DataFrame:
    """Split by ordinal: training head, then validation, test tail; bounds floor to whole blocks.

    ``total``: the number of rows, or a column of it for each row's group.
    """
    total = F.lit(total) if isinstance(total, int) else total
    n_test, n_val = (F.floor(F.floor(total * share) / block) * block for share in (test, val))
    n_train = F.floor((total - n_test - n_val) / block) * block
    o = F.col(ord_col)
    return df.withColumn("split", F.when(o < n_train, "train").when(o < n_train + n_val, "val").otherwise("test"))


def ordinal_slice(df: DataFrame, ord_col: str, start: int, end: int) -> DataFrame:
    """Rows of the ordinals from start to before end."""
    return df.where((F.col(ord_col) >= start) & (F.col(ord_col) < end))


def present_or_best(values: Column, least: float) -> Column:
    """Indices of an array that reach a cut-off, with the largest of all but the last, and the last (unknown) in any case."""
    best = argmax_known(values)
    last = F.size(values) - 1
    return F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(values, i) >= least) | (i == best) | (i == last))


def whole_windows(df: DataFrame, ord_col: str, total: int | Column, window: int) -> DataFrame:
    """Only the ordinals that fill whole windows."""
    return df.where(F.col(ord_col) < total - total % window)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def hashed_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on keys and seed alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def bracketed(df: DataFrame, group: list[str], by: str, n: int) -> DataFrame:
    """n rows of each group, evenly spread from the smallest to the largest."""
    w = W.partitionBy(*group)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(by)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.col("__n") - 1, F.lit(0))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * step / F.lit(max(n - 1, 1))).cast("int"))
    return ranked.where(F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def largest_gap_keep(df: DataFrame, group: list[str], rate: str, min_gap: float, margin: float = 0.0) -> DataFrame:
    """Rows above the largest gap of their group's sorted rates; all where no gap reaches ``min_gap``."""
    w = W.partitionBy(*group)
    gaps = df.withColumn("__next", F.lead(rate).over(w.orderBy(F.desc(rate)))).withColumn("__gap", F.col(rate) - F.col("__next"))
    cut = gaps.groupBy(*group).agg(F.max("__gap").alias("__most"), F.max_by("__next", F.struct("__gap", rate)).alias("__cut"))
    joined = df.join(cut, group, "left")
    keep = F.col("__most").isNull() | (F.col("__most") < min_gap) | (F.col(rate) > F.col("__cut") + margin)
    return joined.where(keep).drop("__most", "__cut")


def keep_above(df: DataFrame, group: list[str], rate: str, fraction: float, floor: float) -> DataFrame:
    """Rows whose rate reaches ``max(floor, fraction * the group's largest)``."""
    w = W.partitionBy(*group)
    return df.where(F.col(rate) >= F.lit(0)).withColumn("__m", F.max(rate).over(w)).where(F.col(rate) >= F.greatest(F.lit(floor), F.lit(fraction) * F.col("__m"))).drop("__m")


def zip_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: list, right_by: list) -> DataFrame:
    """Rows of equal place in a stated order on both sides; what is longer is cut."""
    return with_ordinal(left, left_by, keys, "__ord").join(with_ordinal(right, right_by, keys, "__ord"), [*keys, "__ord"]).drop("__ord")


def checked_zip(left: DataFrame, right: DataFrame, keys: list[str], left_by: list, right_by: list, what: tuple[str, str] = ("left", "right")) -> DataFrame:
    """``zip_join`` for sides that must be equally long: other counts are an error that names both.

    The counts are joined to the rows and compared where the rows are read, so there is no action before; with
    ``keys``, each key's counts must agree (a key that one side lacks counts 0 there).
    """
    one = [*keys, "__one"]
    count = lambda df, name: df.withColumn("__one", F.lit(1)).groupBy(*one).agg(F.count("*").alias(name))
    both = count(left, "__l").join(count(right, "__r"), one, "full_outer").na.fill(0, ["__l", "__r"])
    message = F.concat(F.lit(f"{what[0]} has "), F.col("__l").cast("string"), F.lit(f" rows, {what[1]} has "), F.col("__r").cast("string"))
    agreed = both.withColumn("__ok", F.when(F.col("__l") == F.col("__r"), True).otherwise(F.raise_error(message).cast("boolean"))).select(*one, "__ok")
    sides = [numbered(df.withColumn("__one", F.lit(1)), by, one, "__ord") for df, by in ((left, left_by), (right, right_by))]
    # the counts lead, so that an empty side cannot be left out before they are compared
    joined = agreed.where("__ok").join(sides[0], one, "left").join(sides[1], [*one, "__ord"], "left")
    return joined.drop("__ord", "__one", "__ok")


def joint_argmax(matrix: Column, known: bool = False) -> Column:
    """(i, j) of the largest element of an array of rows, the first of equal ones row by row; ``known``: the last class of
    either side, which stands for unknown, takes no part. Rows are compared by their maxima; no product is laid out."""
    cut = (lambda a: F.slice(a, 1, F.size(a) - 1)) if known else (lambda a: a)
    row = argmax(F.transform(cut(matrix), lambda r: F.array_max(cut(r))))
    return F.struct(row.alias("i"), argmax(cut(F.get(matrix, row))).alias("j"))


def joint_argmax_of(first: Column, second: Column, known: bool = False) -> Column:
    """The same for scores that are sums of one value for each side: the argmax of each."""
    pick = argmax_known if known else argmax
    return F.struct(pick(first).alias("i"), pick(second).alias("j"))


def highlights(df: DataFrame, by: list, value: str, n: int = 50) -> DataFrame:
    """The first non-zero cells."""
    return df.where(F.col(value) != 0).orderBy(*by).limit(n)


def renumbered(names: DataFrame, name: str, number: str) -> DataFrame:
    """Old and new number of each name in natural order, to reorder rows and to map paths back."""
    key, text = natural_key(F.col(name))
    laid = names.select(name, number, key.alias("__key"))
    return numbered(laid, [F.asc_nulls_first("__key"), name, number], name="place").select(name, number, "place")


def sort_by(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:
    """Rows by a chosen column and direction."""
    return df.orderBy(F.desc(column) if descending else F.asc(column), *ties)


def keep_with_probability(df: DataFrame, key: str, probability, seed: int) -> DataFrame:
    """Rows kept with a probability that may differ by row, by a hash of their key."""
    return df.where(hashed_uniform(key, seed=seed) < probability)
