"""SQL for the queries that DuckDB can express."""

from __future__ import annotations

from gridweave.llm.secret_scan import BASE_RULES, RULES

# CRC-32 of strings: a table of 256 entries from the polynomial, then one step per byte.
CRC_TABLE = """
  polynomial(value, step, v) AS (
    SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL SELECT value, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM polynomial WHERE step < 8),
  lookup AS MATERIALIZED (SELECT list(v ORDER BY value) AS t FROM polynomial WHERE step = 8)"""


def crc32(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295)"


SHARDS = f"""
WITH RECURSIVE {CRC_TABLE},
  keys AS (SELECT DISTINCT coalesce(doc_id, 0) AS key FROM documents),
  walk(key, shards, k, here, nxt) AS (
    SELECT key, n, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616::HUGEINT ELSE key::HUGEINT END, -1::BIGINT, 0::BIGINT FROM keys, (VALUES (16), (17)) s(n)
    UNION ALL
    SELECT key, shards, k2, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
    FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE nxt < shards)),
  homes AS (SELECT key, (max(here) FILTER (shards = 16))::INTEGER AS shard, (max(here) FILTER (shards = 17))::INTEGER AS grown_shard FROM walk WHERE nxt >= shards GROUP BY key),
  sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, lookup),
  dealt AS (SELECT *, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || text_crc32")} % 4096 AS block FROM sized, lookup)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt JOIN homes ON key = coalesce(doc_id, 0)"""


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("\\x20", " ").replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(wholes) AS m, unnest(parts) AS v, unnest(gaps[:len(wholes)]) AS gap, generate_subscripts(wholes, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {quoted}) AS wholes, regexp_extract_all(text, {quoted}, {group}) AS parts, regexp_split_to_array(text, {quoted}) AS gaps FROM documents)))
  WHERE length(v) >= {least}"""


_COUNTS = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
_SPAN = "kind || ':' || s || ':' || e"
SECRETS = f"""
WITH found AS ({' UNION ALL '.join(_found(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))}),
  per_doc AS (SELECT doc_id, {_COUNTS}, string_agg({_SPAN}, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}) AS base, string_agg({_SPAN}, ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(d.text, '')) AS blob
FROM documents d LEFT JOIN per_doc USING (doc_id)"""

# SHA-1 comes as 40 hexadecimal digits; each 10 of them are 8 digits to the base of 32.
ARCHIVES = """
WITH told AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN response END AS refers_to
FROM told"""
