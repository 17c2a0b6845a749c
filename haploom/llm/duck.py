"""Pieces of DuckDB SQL that several operators' queries share."""

from __future__ import annotations

#: Table expression of crc32's table of 256 numbers, as the one row ``bits (t)``.
CRC_BITS = "bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def crc32(number: str) -> str:
    """crc32 of a number's decimal text, where ``bits`` is joined."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
