"""Quality rules on repetition inside a document, from suffix arrays over its words.

Suffixes that share their first words lie next to one another in a suffix array; the intervals whose
longest common prefixes reach a given length are the repeated substrings, and a suffix's longest prefix
shared with a neighbour is the longest repeat that begins there. The union of these spans is what the
document repeats; its share of the characters and the longest repeat decide.

Documents of a slice share one suffix array. Their words are numbered per document, so no two documents
have a word in common and no repeat crosses a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import whole_text

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SLICE_WORDS = 1 << 17


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each place of a sequence, the length of the longest substring from there that occurs elsewhere too.

    Prefix doubling: suffixes are ranked by their first 1, 2, 4, ... symbols, and only those whose rank is
    shared are ranked further. The ranks of each length then give the common prefixes of neighbours in the
    suffix array, from the longest length down.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    counts = np.bincount(rank)
    first = np.cumsum(counts) - counts
    rank = first[rank]  # place in the suffix array of the first suffix with this rank
    levels = [rank]
    shared = np.flatnonzero(counts[np.searchsorted(first, rank, "right") - 1] > 1)
    width = 1
    while len(shared):
        after = shared + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[shared]))
        places, a, b = shared[order], rank[shared[order]], second[order]
        new_rank = np.r_[True, a[1:] != a[:-1]]
        new_pair = new_rank | np.r_[True, b[1:] != b[:-1]]
        at = np.arange(len(places))
        start_rank = np.maximum.accumulate(np.where(new_rank, at, 0))
        start_pair = np.maximum.accumulate(np.where(new_pair, at, 0))
        rank = rank.copy()
        rank[places] = a + start_pair - start_rank
        alone = new_pair & np.r_[new_pair[1:], True]
        shared = np.sort(places[~alone])
        levels.append(rank)
        width *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    left, right = array[:-1].copy(), array[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        inside = (left < n) & (right < n)
        same = inside & (ranks[np.minimum(left, n - 1)] == ranks[np.minimum(right, n - 1)])
        common[same] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    longest = np.zeros(n, np.int64)
    longest[array[:-1]] = common
    longest[array[1:]] = np.maximum(longest[array[1:]], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of `least` symbols or more."""
    n = len(longest)
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(longest >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return np.cumsum(change[:n]) > 0


def _rows(keys: list, texts: list[str], least: int) -> pd.DataFrame:
    raw = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in raw])
    owner = np.repeat(np.arange(len(raw)), sizes)
    words = np.empty(int(sizes.sum()), object)
    words[:] = [w for ws in raw for w in ws]
    codes, _ = pd.factorize(words)
    longest = longest_repeats(owner * (len(words) + 1) + codes)
    inside = covered(longest, least)
    # Code points of a word: its bytes that do not continue a character.
    lengths = np.array([len(w) if w.isascii() else len(w.decode()) for w in words], np.int64)
    total = lambda weights: np.bincount(owner, weights, len(raw)).astype(np.int64)
    most = np.zeros(len(raw), np.int64)
    np.maximum.at(most, owner, longest)

    def repeated_lines(text: str) -> int:
        lines = [line for line in text.split("\n") if line.strip(SPACE)]
        return len(lines) - len(set(lines))

    return pd.DataFrame({
        "doc_id": pd.array(keys, "Int64"), "n_words": sizes.astype(np.int64), "word_chars": total(lengths), "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [repeated_lines(t) for t in texts], "n_repeat_words": total(inside), "n_repeat_chars": total(lengths * inside), "longest_repeat": most,
    })


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text)
            if chars >= 6 * SLICE_WORDS or i == len(texts) - 1:
                yield pa.RecordBatch.from_pandas(_rows(keys[lo : i + 1], texts[lo : i + 1], least), preserve_index=False)
                lo, chars = i + 1, 0


def repetition(docs: DataFrame, least_words: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeat_chars, longest_repeat.

    A repeat is a run of `least_words` words or more that occurs twice in the text; places may overlap.
    `longest_repeat` is the longest one of any length. Null and empty texts count 0. Rows are looked at one by
    one, without a shuffle; repeated rows give repeated results.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_repeat_chars bigint, longest_repeat bigint"
    return rows.mapInArrow(partial(_scan, least=least_words), schema)


def judge_repetition(counts: DataFrame, share: float = 0.25, longest: int = 200) -> DataFrame:
    """Adds base_failed and kept: few words or many repeated ones fail; so does a covered share of the word
    characters above `share`, or a repeat of more than `longest` words."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = (F.col("n_repeat_chars") <= share * F.col("word_chars")) & (F.col("longest_repeat") <= longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
