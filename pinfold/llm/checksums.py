"""CRC-32 in SQL, for engines that have no function of that name."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII text: byte by byte, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    one = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, b: {one}), 4294967295)"
