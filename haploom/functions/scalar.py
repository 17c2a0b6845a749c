"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_position(text: Column) -> Column:
    """Positions such as '2.4M', '3 k', '3.14B' or '1,200' as whole numbers, else null: what is before the unit letter,
    less commas and blanks, must be a plain number."""
    t = F.trim(F.upper(F.replace(text, F.lit(","), F.lit(""))))
    unit = F.when(F.right(t, F.lit(1)).isin("K", "M", "B"), F.right(t, F.lit(1)))
    number = F.when(unit.isNull(), t).otherwise(F.trim(F.substring(t, F.lit(1), F.length(t) - 1)))
    # signs, exponents and names such as NaN cast as well, but are no positions
    plain = F.when(F.translate(number, "0123456789.", "") == "", number.try_cast("double"))
    inside = ~number.startswith(".") & ~number.endswith(".")
    return F.when(inside, F.round(plain * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0))).cast("long")


def bin_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size)


def unbin(bin_: Column, size: int) -> Column:
    return bin_ * size


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_intensity(value: Column, most: Column) -> Column:
    """log1p scaled to the largest value."""
    return F.when(most > 0, F.log1p(value) / F.log1p(most)).otherwise(0.0)


def strip_suffix(name: Column) -> Column:
    """A gamete's name without ':' and digits at its end."""
    return F.regexp_replace(name, r":\d+$", "")


def kept_contig(name: Column, patterns: list[str]) -> Column:
    """Whether no (non-blank) pattern stands in a contig's name."""
    keep = F.lit(True)
    for p in patterns:
        if p.strip():
            keep = keep & ~F.contains(name, F.lit(p.strip()))
    return keep


def is_chromosome(name: Column) -> Column:
    """Names that begin like a chromosome's, not a scaffold's."""
    return F.lower(name).startswith("chr")


def sample_of_bed(path: Column) -> Column:
    """The sample of a BED file's name. A name of the form sample_contig_imputed, where the contig is chr (in any case)
    and letters or digits, loses its last two parts; any other name is the sample as it is."""
    name = F.substring_index(path, "/", -1)
    bare = F.substring(name, F.lit(1), F.length(name) - 4)
    parts = F.split(bare, "_")
    contig, last = F.lower(F.get(parts, F.size(parts) - 2)), F.get(parts, F.size(parts) - 1)
    code = F.substring(contig, F.lit(4), F.length(contig))
    cut = (F.size(parts) > 2) & (F.lower(last) == "imputed") & contig.startswith("chr") & (code != "") & (F.translate(code, "abcdefghijklmnopqrstuvwxyz0123456789", "") == "")
    sample = F.when(cut, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(1))), "_")).otherwise(bare)
    return F.when(name.endswith(".bed"), sample).otherwise("")


def success(payload: Column) -> Column:
    """A JSON envelope around a struct."""
    return F.to_json(F.struct(F.lit(True).alias("success"), payload.alias("data")))


def failure(message: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("success"), message.alias("error")))


#: Number types of encoded arrays: bytes of an element and what its bits are.
KINDS = {"uint8": (1, "unsigned"), "int16": (2, "signed"), "int32": (4, "signed"), "uint32": (4, "unsigned"), "int64": (8, "signed"), "float32": (4, "float"), "float64": (8, "float")}


def encode_array(cells: Column, dtype: str = "uint32") -> Column:
    """Whole numbers as base64 of their little-endian bytes; a number beyond its type keeps its low bits, null is null."""
    width, kind = KINDS[dtype]
    if kind == "float":
        raise ValueError("only arrays of whole numbers are encoded")
    low = lambda x: x.cast("long") if width == 8 else x.cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1).cast("long"))
    text = F.array_join(F.transform(cells, lambda x: F.reverse(F.lpad(F.hex(_swapped(low(x))), 2 * width, "0"))), "")
    return F.base64(F.unhex(text))


def _swapped(x: Column) -> Column:
    """A long with the halves of each byte swapped: its digits backwards are then those of its bytes backwards."""
    half = F.lit(0x0F0F0F0F0F0F0F0F).cast("long")
    return F.shiftleft(x.bitwiseAND(half), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(half))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: an element of an array of one."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _whole(digits: Column, width: int, signed: bool) -> Column:
    """A little-endian number from its hexadecimal digits."""
    whole = _swapped(F.conv(F.reverse(digits), 16, -10).cast("long"))
    if width == 8 or not signed:
        return whole
    return _bound(whole, lambda x: F.when(x >= 1 << (8 * width - 1), x - (1 << (8 * width))).otherwise(x))


def _real(bits: Column, exponent: int, mantissa: int) -> Column:
    """The number that the bits of a binary floating-point format stand for."""
    field = F.shiftrightunsigned(bits, mantissa).bitwiseAND(F.lit((1 << exponent) - 1).cast("long")).cast("int")
    rest = bits.bitwiseAND(F.lit((1 << mantissa) - 1).cast("long")).cast("double")
    bias = (1 << (exponent - 1)) - 1
    sign = F.when(F.shiftrightunsigned(bits, exponent + mantissa).bitwiseAND(F.lit(1).cast("long")) == 1, -1.0).otherwise(1.0)
    # two factors, as the smallest powers of two have no double of their own
    small = sign * rest * F.lit(2.0**-500) * F.pow(F.lit(2.0), F.lit(float(501 - bias - mantissa)))
    usual = sign * (1.0 + rest / float(1 << mantissa)) * F.pow(F.lit(2.0), (field - bias).cast("double"))
    special = F.when(rest == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(field == 0, small).when(field == (1 << exponent) - 1, special).otherwise(usual)


def decode_array(text: Column, dtype: str = "uint32", n: Column | None = None) -> Column:
    """(values, reason) of little-endian numbers in base64: whole numbers as longs, others as doubles. Values are null and
    a reason is given where there is no data, it is not base64, or its size does not fit the type (or ``n`` elements)."""
    width, kind = KINDS[dtype]

    def element(piece: Column) -> Column:
        if kind == "float":
            return _bound(_whole(piece, width, False), lambda bits: _real(bits, *((8, 23) if width == 4 else (11, 52))))
        return _whole(piece, width, kind == "signed")

    def read(x: Column) -> Column:
        size = F.length(x["digits"]) / 2
        wrong = size % width != 0 if n is None else size != x["n"] * width
        reason = F.when(x["none"], "no data").when(x["digits"].isNull(), "not base64").when(wrong, "wrong size")
        return F.struct(x["digits"].alias("digits"), (size / width).cast("int").alias("count"), reason.alias("reason"))

    def told(x: Column) -> Column:
        own = lambda i: F.substring(x["digits"], i * (2 * width) + 1, F.lit(2 * width))
        values = F.when(x["count"] == 0, F.array().cast("array<double>" if kind == "float" else "array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(x["count"] - 1, F.lit(0))), lambda i: element(own(i))))
        return F.struct(F.when(x["reason"].isNull(), values).alias("values"), x["reason"].alias("reason"))

    size = F.lit(None).cast("long") if n is None else n
    digits = lambda x: F.struct(x["text"].isNull().alias("none"), F.hex(F.try_to_binary(x["text"], F.lit("base64"))).alias("digits"), x["n"].alias("n"))
    return _bound(_bound(_bound(F.struct(text.alias("text"), size.alias("n")), digits), read), told)


def decode_matrix(text: Column, rows: Column, columns: Column, dtype: str = "float64") -> Column:
    """(values, reason) of a matrix of a stated shape, row by row; a shape that is not known is a reason too."""
    kind = "double" if KINDS[dtype][1] == "float" else "bigint"

    def told(x: Column) -> Column:
        rows, columns, flat = x["rows"], x["columns"], x["flat"]
        reason = F.when(rows.isNull() | columns.isNull() | (rows < 0) | (columns < 0), "no shape").otherwise(flat["reason"])
        split = F.when(rows > 0, F.transform(F.sequence(F.lit(0), F.greatest(rows - 1, F.lit(0))), lambda r: F.slice(flat["values"], (r * columns + 1).cast("int"), columns.cast("int")))).otherwise(F.array().cast(f"array<array<{kind}>>"))
        return F.struct(F.when(reason.isNull(), split).alias("values"), reason.alias("reason"))

    return _bound(F.struct(rows.alias("rows"), columns.alias("columns"), decode_array(text, dtype, rows * columns).alias("flat")), told)


def encode_u32(cells: Column) -> Column:
    """Arrays as base64 of little-endian unsigned 32-bit numbers."""
    return encode_array(cells, "uint32")


def decode_u32(text: Column) -> Column:
    return decode_array(text, "uint32")["values"]
