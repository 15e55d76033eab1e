"""CRC-32 in DuckDB's SQL, for the checks of queries that hash with it."""

#: A CTE with the table of the 256 bytes, which ``crc32`` reads as ``t``.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an expression; ``crc_table`` must be joined."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
