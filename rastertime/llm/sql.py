"""CRC-32 as SQL text for the other engine, which has no such function."""

from __future__ import annotations

#: A common table expression, crc_table(t): the 256 entries of the reflected polynomial.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS b(i))"


def crc32_of(bytes_: str) -> str:
    """The unsigned CRC-32 of an SQL list of byte values; needs crc_table in FROM."""
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def crc32_of_ascii(text: str) -> str:
    return crc32_of(f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)")


def crc32_of_utf8(text: str) -> str:
    return crc32_of(f"list_transform(range(0, octet_length(encode({text})) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i + 1, 2))::BIGINT)")
