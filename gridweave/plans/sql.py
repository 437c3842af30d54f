"""SQL fragments for the counterpart of the column functions, as text around an expression."""

from __future__ import annotations

from gridweave.functions.scalars import PLAIN_NUMBER, SPACE, SPACE_CHARS
from gridweave.functions.segmentation import SENTENCE
from gridweave.rules import fixed


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Trim characters, spelled by code point where they are invisible.
TRIM = " || ".join(f"chr({ord(ch)})" for ch in SPACE_CHARS)
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def norm(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {quote(SPACE + '+')}, ' ', 'g'))"


def cut(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN substr({x}, 1, {limit - 1}) || '…' ELSE {x} END"


def clip(x: str, limit: int) -> str:
    return cut(squeeze(x), limit)


def parse_numeric(x: str) -> str:
    plain = f"replace({strip(x)}, ',', '')"
    body = strip(
        f"CASE WHEN {plain} LIKE '%\\%' ESCAPE '\\' THEN substr({plain}, 1, length({plain}) - 1) "
        f"ELSE translate({plain}, '¥$￥', '') END"
    )
    number = f"CASE WHEN regexp_matches({body}, {quote(PLAIN_NUMBER)}) THEN TRY_CAST({body} AS DOUBLE) END"
    return f"(CASE WHEN {plain} LIKE '%\\%' ESCAPE '\\' THEN ({number}) / 100.0::DOUBLE ELSE ({number}) END)"


def is_empty_like(x: str) -> str:
    return f"({x} IS NULL OR {norm(x)} IN ('', '待填', '待填写', '待补充', 'tbd', 'na', 'pending'))"


def loose_equal(a: str, b: str) -> str:
    na, nb = parse_numeric(a), parse_numeric(b)
    return (
        f"(({a}) IS NOT DISTINCT FROM ({b}) OR coalesce(CASE WHEN {na} IS NOT NULL AND {nb} IS NOT NULL "
        f"THEN {na} = {nb} ELSE {norm(a)} = {norm(b)} END, false))"
    )


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join([f"contains({x}, {quote(w.lower())})" for w in words] or ["false"]) + ")"


def occurrences(x: str, keyword: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {keyword}, ''))) // length({keyword}) AS INTEGER)"


def lines(x: str) -> str:
    return pieces(f"string_split_regex({x}, {quote(BREAK)})")


def pieces(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda piece: {strip('piece')}), lambda piece: piece <> '')"


def sentences(x: str) -> str:
    return pieces(f"regexp_extract_all({x}, {quote(SENTENCE)})")


def a1(row: str, column: str) -> str:
    n = f"({column} - 1)"
    two, three = f"({n} - 26)", f"({n} - 702)"
    return (
        f"(CASE WHEN {n} < 26 THEN chr(CAST(65 + {n} AS INTEGER)) "
        f"WHEN {n} < 702 THEN chr(CAST(65 + {two} // 26 AS INTEGER)) || chr(CAST(65 + {two} % 26 AS INTEGER)) "
        f"ELSE chr(CAST(65 + {three} // 676 AS INTEGER)) || chr(CAST(65 + ({three} // 26) % 26 AS INTEGER)) "
        f"|| chr(CAST(65 + {three} % 26 AS INTEGER)) END || CAST({row} AS VARCHAR))"
    )


def split_blocks(x: str) -> str:
    """Blocks of a stripped text `x` (a column name)."""
    paragraphs = pieces(rf"string_split_regex({x}, {quote(chr(92) + 'n' + SPACE + '*' + chr(92) + 'n+')})")
    return (
        f"CASE WHEN {x} = '' THEN [] WHEN len({paragraphs}) > 1 THEN {paragraphs} "
        f"WHEN len({lines(x)}) > 1 THEN {lines(x)} ELSE {sentences(x)} END"
    )


def slices(x: str, limit: int, overlap: int) -> str:
    step = max(fixed.MIN_SLICE_STEP, limit - overlap)
    last = f"CAST(ceil(greatest(length({x}) - {limit}, 0) / {float(step)}) AS BIGINT)"
    return pieces(f"list_transform(range({last} + 1), lambda i: substr({x}, i * {step} + 1, {limit}))")


def packed(parts: str, limit: int) -> str:
    item = "{'done': []::VARCHAR[], 'open': s, 'size': CAST(length(s) + 1 AS BIGINT)}"
    fold = (
        f"list_reduce(list_transform({parts}, lambda s: {item}), lambda a, x: CASE "
        f"WHEN a.size + (x.size - 1) + 1 > {limit} THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'size': x.size - 1}} "
        f"ELSE {{'done': a.done, 'open': a.open || ' ' || x.open, 'size': a.size + x.size}} END)"
    )
    return f"list_transform([{fold}], lambda r: list_append(r.done, r.open))[1]"


def segments(source: str, key: str, text: str, limit: int = 900, overlap: int = 120, extra: str = "") -> str:
    """CTEs `blocks` and `segments(key, seg_idx, text)` (seg_idx from 0) over `source`."""
    more = f", {extra}" if extra else ""
    return f"""
      stripped AS (SELECT {key}{more}, {strip(text)} AS t FROM {source}),
      blocks AS (SELECT {key}{more}, unnest({split_blocks('t')}) AS b, generate_subscripts({split_blocks('t')}, 1) AS bi FROM stripped),
      parted AS (SELECT *, {sentences('b')} AS parts FROM blocks),
      chunked AS (SELECT {key}{more}, bi, CASE WHEN length(b) <= {limit} THEN [b] WHEN len(parts) <= 1 THEN {slices('b', limit, overlap)}
                  ELSE {packed('parts', limit)} END AS chunks FROM parted),
      pieces AS (SELECT {key}{more}, bi, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS ci FROM chunked),
      segments AS (SELECT {key}{more}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY bi, ci) - 1 AS INTEGER) AS seg_idx, text FROM pieces)"""
