"""CRC-32 in DuckDB's SQL, for the SQL beside the queries: the 256 remainders as a list, and the fold over a text's bytes."""

from __future__ import annotations

#: Common table expression with the one row ``t``, the remainders of all bytes by the reversed polynomial.
TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT range::BIGINT AS i FROM range(256))))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of ``text`` in UTF-8, whose code points must be below 2048; needs ``crc_table`` in FROM."""
    two = "[192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]"
    own = f"flatten(list_transform(list_filter(string_split({text}, ''), lambda ch: ch <> ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE {two} END))"
    each = f"list_transform({own}, lambda b: b::BIGINT)"
    return f"xor(4294967295, list_reduce({each}, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT))"
