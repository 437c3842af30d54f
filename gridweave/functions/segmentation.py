"""Text segmentation as array functions on one document row: no shuffle, no Python.

A document row goes in, an array of segments comes out; the order of the array is the order of the
text. Everything here works inside the row, so its cost grows with the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions.scalars import CJK, LINE_BREAK, SPACE, let, string_array, strip
from gridweave.rules import fixed

PARAGRAPH_BREAK = rf"\n{SPACE}*\n+"
# Two forms of one rule: the pieces themselves, for engines without lookbehind, and the place to split at.
SENTENCE = rf"[^{fixed.SENTENCE_ENDS}]+[{fixed.SENTENCE_ENDS}]?|[{fixed.SENTENCE_ENDS}]"
SENTENCE_END = rf"(?<=[{fixed.SENTENCE_ENDS}])"


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda piece: piece != "")


def sentences(text: Column) -> Column:
    """Sentences, cut behind the CJK and Latin end marks (a full stop is none of them)."""
    return _pieces(F.split(text, SENTENCE_END))


def split_blocks(text: Column) -> Column:
    """Paragraphs if there are several, else lines if there are several, else sentences."""

    def blocks(body: Column) -> Column:
        return let(
            _pieces(F.split(body, PARAGRAPH_BREAK)),
            lambda paragraphs: F.when(F.size(paragraphs) > 1, paragraphs).otherwise(
                let(
                    _pieces(F.split(body, LINE_BREAK)),
                    lambda lines: F.when(F.size(lines) > 1, lines).otherwise(sentences(body)),
                )
            ),
        )

    return let(strip(text), lambda body: F.when(body == "", string_array([])).otherwise(blocks(body)))


def overlap_slices(text: Column, limit: int = fixed.SEGMENT_CHARS, overlap: int = fixed.SEGMENT_OVERLAP) -> Column:
    """Windows of `limit` characters that overlap; the last one ends with the text."""
    step = max(fixed.MIN_SLICE_STEP, limit - overlap)
    last = F.ceil(F.greatest(F.length(text) - limit, F.lit(0)) / step).cast("int")
    return _pieces(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(limit))))


FOLD_RUN = 512


def pack_sentences(parts: Column, limit: int = fixed.SEGMENT_CHARS) -> Column:
    """Sentences joined by a space as long as they fit into `limit`; one longer than that stays whole."""
    def step(acc: Column, sentence: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["size"] + F.length(sentence) + 1 > limit)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), sentence)
            .otherwise(F.concat(acc["open"], F.lit(" "), sentence))
            .alias("open"),
            F.when(full, F.length(sentence)).otherwise(acc["size"] + F.length(sentence) + 1).alias("size"),
        )

    # Appending copies the array, so chunks are gathered in runs of FOLD_RUN sentences, and the runs are joined
    # at the end: the work grows with the text and not with its square.
    def run(acc: Column, i: Column) -> Column:
        return let(
            F.aggregate(F.slice(parts, i * FOLD_RUN + 1, F.lit(FOLD_RUN)), F.struct(string_array([]).alias("done"), acc["open"].alias("open"), acc["size"].alias("size")), step),
            lambda part: F.struct(F.array_append(acc["runs"], part["done"]).alias("runs"), part["open"].alias("open"), part["size"].alias("size")),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.flatten(acc["runs"]), F.when(acc["open"].isNull(), string_array([])).otherwise(F.array(acc["open"])))

    runs = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD_RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    begun = F.struct(F.array().cast("array<array<string>>").alias("runs"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))
    return F.aggregate(runs, begun, run, finish)


def chunk_block(
    block: Column, limit: int = fixed.SEGMENT_CHARS, overlap: int = fixed.SEGMENT_OVERLAP
) -> Column:
    """A block as chunks of at most `limit` characters."""

    def long_block(body: Column) -> Column:
        return let(
            sentences(body),
            lambda parts: F.when(F.size(parts) <= 1, overlap_slices(body, limit, overlap)).otherwise(
                pack_sentences(parts, limit)
            ),
        )

    return F.when(F.length(block) <= limit, F.array(block)).otherwise(long_block(block))


def segment_texts(
    text: Column, limit: int = fixed.SEGMENT_CHARS, overlap: int = fixed.SEGMENT_OVERLAP
) -> Column:
    """All segment texts of a document in order."""
    return F.flatten(F.transform(split_blocks(text), lambda block: chunk_block(block, limit, overlap)))


def request_keywords(request: Column | str) -> Column:
    """Words of a request to look for: Latin tokens, CJK runs as bigrams, without stop words and repeats."""
    text = F.lower(F.col(request) if isinstance(request, str) else request)
    tokens = F.regexp_extract_all(text, F.lit(rf"[a-z0-9][a-z0-9_/-]+|{CJK}{{2,}}"), 0)
    trimmed = F.filter(F.transform(tokens, lambda t: F.btrim(t, F.lit("-_/"))), lambda t: t != "")

    def expand(token: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))
        whole = F.when(F.length(token) <= 4, F.array(token)).otherwise(string_array([]))
        is_cjk = F.rlike(token, F.lit(rf"^{CJK}+$"))
        return F.when(is_cjk & (F.length(token) > 2), F.concat(bigrams, whole)).otherwise(F.array(token))

    words = F.array_distinct(F.flatten(F.transform(trimmed, expand)))
    return F.filter(words, lambda w: ~w.isin(fixed.REQUEST_STOP_WORDS))
