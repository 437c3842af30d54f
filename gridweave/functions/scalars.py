"""Scalar column functions: numbers, tokens, addresses, clipping, keywords, text merging."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.rules import fixed

# White space as text processing sees it (ASCII, control separators, Unicode spaces): once as the
# characters for trimming, once as a character class that Java and RE2 read alike.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CJK = r"[\x{4e00}-\x{9fff}]"


# Arguments of type `Column | str`: a string is SQL text (a column name is the simplest case). Functions
# with long word lists then build one parsed expression instead of one object per word.


def _col(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def sql_text(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lower(text: Column | str) -> Column | str:
    return f"lower({text})" if isinstance(text, str) else F.lower(text)


def sql_list(words: Sequence[str]) -> str:
    return ", ".join(sql_text(w) for w in words)


def string_array(values: Sequence[str]) -> Column:
    """A literal array of strings; empty lists keep their type."""
    return F.expr(f"array({sql_list(values)})" if values else "cast(array() as array<string>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct with the given names (they survive inside nested lambdas, where aliases are dropped)."""
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(SPACE_CHARS))


def blank_to_null(text: Column | str) -> Column:
    """Stripped text, with empty text as NULL."""
    return F.nullif(strip(text), F.lit(""))


# --- numbers ----------------------------------------------------------------------------------


def parse_numeric(text: Column | str) -> Column:
    """Number in a text: thousands commas and currency signs are dropped, a trailing % divides by 100.

    Only plain decimal notation counts: `1d`, `NaN`, `inf`, `1_000` and hexadecimal give NULL.
    """
    plain = F.replace(strip(text), F.lit(","), F.lit(""))
    percent = F.endswith(plain, F.lit("%"))
    body = strip(
        F.when(percent, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(F.translate(plain, "¥$￥", ""))
    )
    number = F.when(F.rlike(body, F.lit(PLAIN_NUMBER)), body.try_cast("double"))
    return F.when(percent, number / F.lit(100.0)).otherwise(number)


def round_for_display(value: Column | str) -> Column:
    """Half-even to 4 places; a display step, never applied before a comparison."""
    return F.bround(_col(value), 4)


def number_text(value: Column | str) -> Column:
    """Text of a number as a report shows it: whole numbers without a decimal point."""
    number = _col(value)
    whole = number == F.floor(number)
    return F.when(whole & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def unit_sum(value: Column | str, scale: int) -> Column:
    """Sum in whole units of 10^-scale as decimal. A value with more decimals, or of 9e15 units and more, is an error, never rounded."""
    number = _col(value).cast("double")
    raw = number * float(10**scale)
    whole = F.rint(raw)
    fits = (F.abs(raw) < 9e15) & (F.abs(raw - whole) <= 1e-9 * F.greatest(F.abs(raw), F.lit(1.0)))
    wrong = F.raise_error(F.concat(F.lit(f"not a number of {scale} decimals: "), number.cast("string"))).cast("double")
    return F.sum(F.when(number.isNull() | fits, whole).otherwise(wrong).cast("bigint").cast("decimal(19,0)"))


def from_units(units: Column, scale: int) -> Column:
    return (units / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("double")


def exact_sum(value: Column | str, scale: int | None = None) -> Column:
    """Sum of numbers as double.

    Without `scale` it is the plain sum of doubles, for values of any size, NaN and infinity included. With
    the `scale` of a column whose values have that many decimals at most it is exact and does not depend on
    the order of rows.
    """
    return F.sum(_col(value).cast("double")) if scale is None else from_units(unit_sum(value, scale), scale)


# --- tokens, headers, equality ----------------------------------------------------------------


def norm_token(text: Column | str) -> Column:
    """Lower case, letters and digits of any script only."""
    if isinstance(text, str):
        return F.expr(norm_token_sql(text))
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def norm_token_sql(text: str) -> str:
    return rf"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', '')"


def lookup(mapping: Mapping[str, str], key: Column | str) -> Column:
    """Value of a small literal map, NULL for other keys."""
    pairs = sql_list([part for pair in mapping.items() for part in pair])
    if isinstance(key, str):
        return F.expr(f"try_element_at(map({pairs}), {key})")
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def in_words(text: Column | str, words: Sequence[str]) -> Column:
    return F.expr(f"{text} IN ({sql_list(words)})") if isinstance(text, str) else text.isin(list(words))


def header_alias(header: Column | str, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Canonical name of a header; a header without an alias is its own lower-case name."""
    table = aliases if aliases is not None else fixed.CALC_HEADER_ALIASES
    names: dict[str, str] = {}
    for canonical, words in table.items():
        for word in [canonical, *words]:
            names.setdefault(word.lower(), canonical)
    name = F.lower(strip(header))
    return F.coalesce(lookup(names, name), name)


def py_token(text: str) -> str:
    """`norm_token` for a literal, for rule lists built on the driver."""
    return "".join(ch for ch in text.strip().lower() if ch.isalnum())


def is_empty_like(text: Column | str) -> Column:
    """NULL, or nothing but a placeholder. Zero is a value."""
    words = sorted({py_token(p) for p in fixed.PLACEHOLDERS})
    value = _col(text)
    return value.isNull() | norm_token(value).isin(words)


def loose_equal(left: Column | str, right: Column | str) -> Column:
    """Equal as text, as numbers if both are numbers, else as tokens."""
    a, b = _col(left), _col(right)
    number_a, number_b = parse_numeric(a), parse_numeric(b)
    by_kind = F.when(number_a.isNotNull() & number_b.isNotNull(), number_a == number_b).otherwise(
        norm_token(a) == norm_token(b)
    )
    return a.eqNullSafe(b) | F.coalesce(by_kind, F.lit(False))


def validation_equal(left: Column | str, right: Column | str) -> Column:
    """Equality of the re-read check: same text without case, and 5 equals 5.0."""
    def shown(value: Column) -> Column:
        text = F.lower(strip(F.coalesce(value, F.lit(""))))
        return F.when(F.rlike(text, F.lit(r"^-?[0-9]+\.0+$")), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)

    return shown(_col(left)) == shown(_col(right))


# --- addresses --------------------------------------------------------------------------------


def a1_encode(row: Column | str, column: Column | str) -> Column:
    """A1 address for columns 1 to 18278 (three letters)."""
    if isinstance(row, Column) or isinstance(column, Column):
        place = F.struct(_col(row).cast("bigint").alias("r"), _col(column).cast("int").alias("c"))
        return let(place, lambda p: F.concat(_letters(p["c"] - 1), p["r"].cast("string")))
    n = f"(cast({column} as int) - 1)"
    two, three = f"({n} - 26)", f"({n} - 702)"
    return F.expr(
        f"concat(CASE WHEN {n} < 26 THEN char(65 + {n}) WHEN {n} < 702 THEN concat(char(65 + {two} div 26), char(65 + {two} % 26)) "
        f"ELSE concat(char(65 + {three} div 676), char(65 + ({three} div 26) % 26), char(65 + {three} % 26)) END, cast({row} as string))"
    )


def _letters(n: Column) -> Column:
    def letter(value: Column) -> Column:
        return F.char(F.lit(65) + value)

    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def is_a1(ref: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(ref), F.lit("^[A-Za-z]+[0-9]+$")), F.lit(False))


def a1_column(ref: Column | str) -> Column:
    """Column number of an A1 address of up to three letters, else NULL."""
    letters = F.upper(F.regexp_extract(_col(ref), "^([A-Za-z]{1,3})[0-9]+$", 1))

    def digit(position: int) -> Column:
        return F.ascii(F.substring(letters, position, 1)) - 64

    return (
        F.when(F.length(letters) == 1, digit(1))
        .when(F.length(letters) == 2, digit(1) * 26 + digit(2))
        .when(F.length(letters) == 3, digit(1) * 676 + digit(2) * 26 + digit(3))
    )


def a1_row(ref: Column | str) -> Column:
    return F.regexp_extract(_col(ref), "^[A-Za-z]+([0-9]+)$", 1).try_cast("int")


# --- clipping, location, markdown -------------------------------------------------------------


def squeeze(text: Column | str) -> Column:
    """One space between words, none at the ends."""
    return F.btrim(F.regexp_replace(_col(text), SPACE + "+", " "))


def cut(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last one an ellipsis when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def clip(text: Column | str, limit: int = fixed.EXCERPT_CHARS, collapse: bool = True) -> Column:
    return cut(squeeze(text) if collapse else strip(text), limit)


def flag_long_text(text: Column | str, limit: int) -> tuple[Column, Column]:
    """Text cut at an upload limit, and whether it was cut. The limit is the feature here."""
    body = strip(text)
    too_long = F.length(body) > limit
    return F.when(too_long, F.substring(body, 1, limit)).otherwise(body), too_long


def location_text(
    page: Column | None = None,
    section: Column | None = None,
    sheet: Column | None = None,
    row_start: Column | None = None,
    row_end: Column | None = None,
    label: Column | None = None,
) -> Column:
    """Place of a segment in words: page / section / sheet / rows / label."""
    parts: list[Column] = []
    if page is not None:
        parts.append(F.when(page.isNotNull(), F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))))
    if section is not None:
        parts.append(F.concat(F.lit("章节 "), F.nullif(section, F.lit(""))))
    if sheet is not None:
        parts.append(F.concat(F.lit("工作表 "), F.nullif(sheet, F.lit(""))))
    if row_start is not None:
        end = row_end if row_end is not None else F.lit(None).cast("int")
        span = F.when(
            end.isNotNull() & (end != row_start),
            F.concat(F.lit("第 "), row_start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" 行")),
        ).otherwise(F.concat(F.lit("第 "), row_start.cast("string"), F.lit(" 行")))
        parts.append(F.when(row_start.isNotNull(), span))
    if label is not None:
        parts.append(F.nullif(label, F.lit("")))
    if not parts:
        return F.lit(fixed.NO_LOCATION)
    return F.coalesce(F.nullif(F.concat_ws(" / ", *parts), F.lit("")), F.lit(fixed.NO_LOCATION))


def md_cell(value: Column | str) -> Column:
    """Text for a Markdown table cell."""
    text = strip(F.translate(F.coalesce(_col(value).cast("string"), F.lit("-")), "\n\r", "  "))
    return F.coalesce(F.nullif(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("-"))


def join_present(separator: str, *values: Column) -> Column:
    """Non-blank values joined; "-" if there are none."""
    return F.coalesce(
        F.nullif(F.concat_ws(separator, *[blank_to_null(v.cast("string")) for v in values]), F.lit("")), F.lit("-")
    )


def ordered_distinct(values: Column | str, limit: int | None = None) -> Column:
    """Stripped non-empty items, first occurrence wins, cut at `limit` if given."""
    items = F.array_distinct(F.filter(F.transform(_col(values), strip), lambda x: x != ""))
    return items if limit is None else F.slice(items, 1, limit)


# --- keywords in text -------------------------------------------------------------------------


def contains_any(text_lower: Column | str, words: Sequence[str], word: bool = False) -> Column:
    """Does a lower-cased text hold one of a few words (as substrings, or as whole words)?"""
    if isinstance(text_lower, str) and not word:
        return F.expr(contains_any_sql(text_lower, words))
    text_lower, hit = _col(text_lower), F.lit(False)
    for item in words:
        if word:
            hit = hit | F.rlike(text_lower, F.lit(r"\b\Q" + item.lower() + r"\E\b"))
        else:
            hit = hit | F.contains(text_lower, F.lit(item.lower()))
    return hit


def contains_any_sql(text_lower: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join([f"contains({text_lower}, {sql_text(w.lower())})" for w in words] or ["false"]) + ")"


def keywords_found(text_lower: Column, words: Sequence[str]) -> Column:
    """The words that occur, in the order of the list."""
    return F.filter(string_array([w.lower() for w in words]), lambda k: F.contains(text_lower, k))


def occurrences(text_lower: Column, keyword: Column) -> Column:
    """Number of non-overlapping occurrences."""
    removed = F.length(text_lower) - F.length(F.replace(text_lower, keyword, F.lit("")))
    return (removed / F.length(keyword)).cast("int")


def labels_found(text_lower: Column | str, table: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Names of a keyword table whose words occur, in table order; `[default]` when none does."""
    if isinstance(text_lower, str):
        cases = ", ".join(f"CASE WHEN {contains_any_sql(text_lower, ws)} THEN {sql_text(n)} END" for n, ws in table.items())
        found = f"array_compact(array({cases}))"
        return F.expr(found if default is None else f"coalesce(nullif({found}, cast(array() as array<string>)), array({sql_text(default)}))")
    found = F.array_compact(F.array(*[F.when(contains_any(text_lower, words), F.lit(n)) for n, words in table.items()]))
    return found if default is None else F.when(F.size(found) == 0, string_array([default])).otherwise(found)


def time_tokens(text: Column | str, tokens: Sequence[str] | None = None, longest_first: bool = False) -> Column:
    """Known months, quarters and years in a request; "11月" also yields "1月" unless `longest_first`."""
    words = list(tokens if tokens is not None else fixed.TIME_TOKENS)
    lowered = F.lower(_col(text))
    if not longest_first:
        return F.filter(string_array(words), lambda t: F.contains(lowered, t))

    def visible(token: str) -> Column:
        rest = lowered
        for longer in words:
            if longer != token and token in longer:
                rest = F.replace(rest, F.lit(longer), F.lit(" "))
        return F.when(F.contains(rest, F.lit(token)), F.lit(token))

    return F.array_compact(F.array(*[visible(t) for t in words]))


def operations_requested(text: Column | str) -> Column:
    """Operations named in a request; sum and count when none is."""
    found = labels_found(_lower(text), fixed.OPERATION_KEYWORDS)
    return F.when(F.size(found) == 0, string_array(fixed.DEFAULT_OPERATIONS)).otherwise(found)


def message_labels(text: Column | str) -> Column:
    """Labels of a message in fixed order, `general` when none applies."""
    lowered = _lower(text)
    found = labels_found(lowered, fixed.MESSAGE_LABELS)
    counted = F.when(
        ~F.array_contains(found, "count") & contains_any(lowered, fixed.CALCULATION_WORDS),
        F.concat(found, string_array(["count"])),
    ).otherwise(found)
    return F.when(F.size(counted) == 0, string_array([fixed.DEFAULT_KIND])).otherwise(counted)


def label_confidence(labels: Column, has_documents: Column) -> Column:
    """0.62 to 0.9 by the number of labels and the presence of documents."""
    general = (F.size(labels) == 1) & (F.element_at(labels, 1) == fixed.DEFAULT_KIND)
    return (
        F.when(general, F.when(has_documents, 0.66).otherwise(0.62))
        .when(F.size(labels) > 1, F.when(has_documents, 0.9).otherwise(0.86))
        .otherwise(F.when(has_documents, 0.84).otherwise(0.8))
    )


def required_kinds(text: Column | str) -> Column:
    """Document kinds a request needs; the report words do not count when a report is to be written."""
    lowered = F.lower(_col(text))
    writes = request_flags(text)["writes_report"]
    groups = []
    for word, kinds in fixed.REQUIRED_KINDS.items():
        hit = F.contains(lowered, F.lit(word))
        if word in fixed.REPORT_KIND_WORDS:
            hit = hit & ~writes
        groups.append(F.when(hit, string_array(kinds)).otherwise(string_array([])))
    return F.array_distinct(F.flatten(F.array(*groups)))


def request_flags(text: Column | str) -> dict[str, Column]:
    """What a request asks for, as boolean columns by name."""
    lowered = _lower(text)
    topic = contains_any(lowered, fixed.TOPIC_REQUEST_WORDS)
    report = contains_any(lowered, fixed.REPORT_WORDS)
    outline = contains_any(lowered, fixed.OUTLINE_WORDS)
    section = contains_any(lowered, fixed.SECTION_ONLY_HINTS)
    full = contains_any(lowered, fixed.FULL_REPORT_HINTS)
    explicit = length_requirement(text)["explicit"]
    writing = contains_any(lowered, fixed.REPORT_WRITING_WORDS)
    labels = message_labels(text)
    fill = contains_any(lowered, fixed.TABLE_FILL_WORDS) | (
        contains_any(lowered, fixed.TABLE_TARGET_WORDS) & contains_any(lowered, fixed.WRITE_WORDS)
    )
    writes_report = topic & report & (full | explicit | (writing & ~outline & ~section))
    return {
        "is_topic_request": topic,
        "checks_material": F.array_contains(labels, "check_missing") | contains_any(lowered, fixed.GAP_WORDS),
        "extracts_kpis": F.array_contains(labels, "count") | contains_any(lowered, fixed.KPI_WORDS),
        "wants_outline": F.array_contains(labels, "revise") | outline,
        "writes_report": writes_report,
        "fills_table": fill,
        "needs_documents": writes_report | contains_any(lowered, fixed.DOCUMENT_REFERENCE_WORDS),
    }


# --- counting and lengths ---------------------------------------------------------------------


def word_count(markdown: Column | str) -> Column:
    """CJK characters plus Latin words, without Markdown marks."""
    text = F.translate(F.coalesce(_col(markdown), F.lit("")), "#*_>`-|[]()", " " * 11)
    cjk = F.regexp_count(text, F.lit(CJK))
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*"))
    return (cjk + words).cast("int")


def length_requirement(request: Column | str) -> Column:
    """Report length asked for, as a struct: explicit, target, lower, upper, label.

    A range wins over a single number; both are clamped. Without a number the default applies.
    """
    text = F.coalesce(_col(request), F.lit(""))
    low, high = fixed.LENGTH_MIN, fixed.LENGTH_MAX

    def count(value: Column, unit: Column) -> Column:
        number = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
        factor = F.when(unit == "万", 10000.0).when(F.lower(unit).isin("千", "k"), 1000.0).otherwise(1.0)
        # Lengths beyond the clamp are all the same, so huge numbers need no wide integer.
        return F.when(number.isNotNull(), F.bround(F.least(number * factor, F.lit(1e9)), 0).cast("int"))

    none = F.lit("")
    first = count(F.regexp_extract(text, fixed.LENGTH_RANGE_PATTERN, 1), none)
    second = count(F.regexp_extract(text, fixed.LENGTH_RANGE_PATTERN, 2), none)
    range_label = F.regexp_extract(text, fixed.LENGTH_RANGE_PATTERN, 3)
    single = count(F.regexp_extract(text, fixed.LENGTH_PATTERN, 1), F.regexp_extract(text, fixed.LENGTH_PATTERN, 2))
    single_label = F.regexp_extract(text, fixed.LENGTH_PATTERN, 3)

    lower = F.greatest(F.lit(low), F.least(first, second))
    upper = F.least(F.lit(high), F.greatest(first, second))
    target = F.least(F.lit(high), F.greatest(F.lit(low), single))
    tolerance = F.greatest(F.lit(120), F.bround(target * F.lit(0.1), 0).cast("int"))

    def result(explicit: bool, goal: Column, least: Column, most: Column, label: Column) -> Column:
        return F.struct(
            F.lit(explicit).alias("explicit"),
            goal.cast("int").alias("target"),
            least.cast("int").alias("lower"),
            most.cast("int").alias("upper"),
            label.alias("label"),
        )

    default = [F.lit(v) for v in fixed.LENGTH_DEFAULT]
    return (
        F.when((first > 0) & (second > 0), result(True, F.bround((lower + upper) / 2, 0), lower, upper, range_label))
        .when(
            single > 0,
            result(
                True, target, F.greatest(F.lit(low), target - tolerance), F.least(F.lit(high), target + tolerance),
                single_label,
            ),
        )
        .otherwise(result(False, *default, F.lit("字")))
    )


def value_pattern(compat: bool = False) -> str:
    """Pattern of a number; `compat` knows no thousands separators."""
    return r"\d+(?:\.\d+)?" if compat else r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def number_pattern(compat: bool = False) -> str:
    """Pattern of `number unit?`."""
    return rf"(?i)({value_pattern(compat)})\s*({fixed.NUMBER_UNITS})?"


def number_units(text: Column | str, compat: bool = False) -> Column:
    """All numbers with their units as array<struct<value, unit>>, in text order."""
    source = _col(text)
    # What follows a number in the pattern has no digits, so the numbers alone are found at the same places.
    values = F.regexp_extract_all(source, F.lit(f"({value_pattern(compat)})"), 1)
    units = F.regexp_extract_all(source, F.lit(number_pattern(compat)), 2)

    def unit_name(unit: Column) -> Column:
        lowered = F.lower(unit)
        return F.when(lowered.isin(fixed.COUNT_UNIT_WORDS), F.lit(fixed.COUNT_UNIT)).otherwise(lowered)

    return F.transform(
        F.arrays_zip(values.alias("number"), units.alias("unit")),
        lambda pair: F.struct(
            F.replace(pair["number"], F.lit(","), F.lit("")).cast("double").alias("value"),
            unit_name(pair["unit"]).alias("unit"),
        ),
    )


# --- merging, verdicts, pages -----------------------------------------------------------------


def text_lines(text: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda line: line != "")


def comparable(text: Column) -> Column:
    return F.lower(squeeze(text))


def merge_text(primary: Column | str, secondary: Column | str, separator_label: str | None = None) -> Column:
    """Two versions of one text as one: the fuller one if one holds the other, else both without repeats."""
    a, b = strip(F.coalesce(_col(primary), F.lit(""))), strip(F.coalesce(_col(secondary), F.lit("")))

    def merged(pair: Column) -> Column:
        first, second, key_a, key_b = pair["a"], pair["b"], pair["ka"], pair["kb"]
        known = F.transform(text_lines(first), comparable)
        fuller = F.when(F.length(first) >= F.length(second), first).otherwise(second)
        joint = "\n" if not separator_label else f"\n\n[{separator_label}]\n"
        return (
            F.when(first == "", second)
            .when(second == "", first)
            .when(key_a == key_b, fuller)
            .when(F.contains(key_a, key_b), first)
            .when(F.contains(key_b, key_a), second)
            .otherwise(
                let(
                    F.filter(text_lines(second), lambda line: ~F.array_contains(known, comparable(line))),
                    lambda extra: F.when(F.size(extra) == 0, fuller).otherwise(
                        strip(F.concat(first, F.lit(joint), F.array_join(extra, "\n")))
                    ),
                )
            )
        )

    return let(
        F.struct(a.alias("a"), b.alias("b"), comparable(a).alias("ka"), comparable(b).alias("kb")), merged
    )


def drop_fences(text: Column) -> Column:
    """Text without code-fence lines, if it starts with one."""
    body = strip(text)
    lines = F.filter(F.split(body, LINE_BREAK), lambda line: ~F.startswith(strip(line), F.lit("```")))
    return F.when(F.startswith(body, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(body)


def json_object(text: Column | str) -> Column:
    """First `{` to last `}` when that is a JSON object, else NULL."""
    candidate = F.nullif(F.regexp_extract(drop_fences(_col(text)), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(candidate).isNotNull(), candidate)


def risk_level(value: Column) -> Column:
    name = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(name.isin(fixed.RISK_LEVELS), name).otherwise(F.lit("medium"))


VERDICT_SCHEMA = "approved BOOLEAN, riskLevel STRING, issues ARRAY<STRING>, suggestions ARRAY<STRING>"


def verdict(text: Column | str, block_on_high: bool = True, list_limit: int = 6) -> Column:
    """Reviewer verdict in a reply: status, approved, risk_level, block, issues, suggestions."""

    def build(raw: Column) -> Column:
        parsed = F.from_json(raw, VERDICT_SCHEMA)
        valid = raw.isNotNull()
        risk = F.when(valid, risk_level(parsed["riskLevel"])).otherwise(F.lit("unknown"))
        approved = F.coalesce(parsed["approved"], risk != "high")
        block = F.lit(block_on_high) & F.when(valid, (risk == "high") | ~approved).otherwise(F.lit(True))
        empty = string_array([])
        return F.struct(
            F.when(valid, F.lit("completed")).otherwise(F.lit("invalid_response")).alias("status"),
            F.when(valid, approved & ~block).otherwise(F.lit(not block_on_high)).alias("approved"),
            risk.alias("risk_level"),
            block.alias("block"),
            F.coalesce(ordered_distinct(parsed["issues"], list_limit), empty).alias("issues"),
            F.coalesce(ordered_distinct(parsed["suggestions"], list_limit), empty).alias("suggestions"),
        )

    return let(json_object(text), build)


def split_pages(text: Column | str, start_page: Column | int, end_page: Column | int) -> Column:
    """Text with page marker lines as map page -> text; empty when an expected page is missing."""
    start = F.lit(start_page) if isinstance(start_page, int) else start_page
    end = F.lit(end_page) if isinstance(end_page, int) else end_page
    body = drop_fences(_col(text))
    # Only line feeds delimit marker lines here; other breaks are rare inside recognised pages.
    marker = rf"(?im)^[ \t]*{fixed.PAGE_MARKER_PATTERN}[ \t]*\r?$"
    empty = F.create_map().cast("map<int,string>")

    def paged(raw: Column) -> Column:
        parts = F.transform(F.slice(F.split(raw, marker), 2, 1000000), strip)
        native = F.regexp_extract_all(raw, F.lit(marker), 1)
        latin = F.regexp_extract_all(raw, F.lit(marker), 2)
        pages = F.zip_with(native, latin, lambda a, b: F.when(a != "", a).otherwise(b).cast("int"))
        entries = F.arrays_zip(pages.alias("page"), parts.alias("text"))
        wanted = F.sequence(start, end)
        complete = F.size(F.array_except(wanted, pages)) == 0

        def last_text(page: Column) -> Column:
            return F.element_at(F.filter(entries, lambda e: e["page"] == page), -1)["text"]

        return F.when(complete, F.map_from_arrays(wanted, F.transform(wanted, last_text))).otherwise(empty)

    single = F.when(body != "", F.create_map(start, body)).otherwise(empty)
    return F.when(start == end, single).otherwise(let(body, paged))


# --- file types -------------------------------------------------------------------------------


def document_type(name: Column | str, mime: Column | None = None) -> Column:
    """One of ten document types from file name and MIME type; the first match wins."""
    suffix = F.regexp_extract(F.lower(_col(name)), r"[^./]\.([^./]+)$", 1)
    media = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")

    def has(*words: str) -> Column:
        return contains_any(media, words)

    return (
        F.when((suffix == "pdf") | (media == "application/pdf"), "pdf")
        .when(suffix.isin(fixed.IMAGE_SUFFIXES) | F.startswith(media, F.lit("image/")), "image")
        .when(suffix.isin(fixed.EXCEL_SUFFIXES) | has("spreadsheet", "excel"), "excel")
        .when(suffix.isin(fixed.PRESENTATION_SUFFIXES) | has("presentation", "powerpoint"), "presentation")
        .when(suffix.isin(fixed.WORD_SUFFIXES) | has("word", "document"), "word")
        .when(suffix.isin(fixed.EMAIL_SUFFIXES) | (media == "message/rfc822"), "email")
        .when(
            suffix.isin(fixed.ARCHIVE_SUFFIXES) | media.isin("application/zip", "application/x-zip-compressed"),
            "archive",
        )
        .when(suffix.isin(fixed.NOTE_SUFFIXES), "note")
        .when(
            suffix.isin(fixed.TEXT_SUFFIXES) | F.startswith(media, F.lit("text/")) | F.endswith(media, F.lit("+json")),
            "text",
        )
        .otherwise("other")
    )
