"""CRC-32 in the SQL of the oracles, by its definition: a table of remainders, then byte by byte."""

#: A relation with the 256 remainders as the list ``r``.
REMAINDERS = """remainders AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS r
)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an expression, beside ``remainders``."""
    return f"""xor(4294967295, coalesce(list_reduce(
    list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, b: xor(c // 256, r[1 + xor(c % 256, b)]), 4294967295), 4294967295))"""
