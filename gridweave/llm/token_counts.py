"""Token counts of documents without token ids.

Documents become frequencies of pre-tokens. Each distinct pre-token of the corpus is encoded once, to find
how many tokens it makes; the count is joined to the frequencies, and frequency x tokens is summed per
document.

A row of the frequencies holds one pre-token of one block of documents and its counts in them, packed (a
posting list), so the pre-token itself travels once per block and not once per document. Sums go back to
the blocks packed as well. A block is a part of one task's input, bounded by its characters.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import whole_text

# Fixed value: how the byte-level vocabulary cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 1 << 25
PLACES = 1 << 16
PENDING = 1 << 22
# `on` is a pre-token, or for the row with the keys of a block (where counts is null) a name that no pre-token
# has: a zero byte and a digit, which the pattern never leaves together. `counts` holds pairs of 16-bit numbers: distance to the place of the document
# before, and how often the pre-token occurs in it; a larger number is given in several pairs.
FREQUENCIES = pa.schema([("on", pa.string()), ("block", pa.string()), ("counts", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])
NAME = regex.compile(r"\0[0-9]")
PARTIALS = pa.schema([("block", pa.string()), ("sums", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])


def _posting_rows(index: dict[str, int], words: array, places: array, counts: array, block: str) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its (word, place, count) entries by word, packed."""
    word, place, n = (np.frombuffer(a, np.uint32).astype(np.int64) for a in (words, places, counts))
    full = n // (PLACES - 1)
    if full.any():
        again = np.repeat(np.arange(len(n)), full + 1)
        last = np.r_[again[1:] != again[:-1], True]
        word, place, n = word[again], place[again], np.where(last, (n % (PLACES - 1))[again], PLACES - 1)
    order = np.argsort(word, kind="stable")  # places ascend within a word
    word, place, n = word[order], place[order], n[order]
    edges = np.searchsorted(word, np.arange(len(index) + 1))
    gaps = np.diff(place, prepend=0)
    gaps[edges[:-1]] = place[edges[:-1]]
    packed = np.ascontiguousarray(np.stack([gaps, n], axis=1).astype(np.uint16))
    names = list(index)
    for lo in range(0, len(names), 50_000):
        hi = min(lo + 50_000, len(names))
        part = packed[edges[lo] : edges[hi]]
        offsets = pa.py_buffer(((edges[lo : hi + 1] - edges[lo]) * 4).astype(np.int32))
        binary = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(part)])
        nothing = pa.nulls(hi - lo, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi], pa.string()), pa.array([block] * (hi - lo)), binary, nothing, nothing], schema=FREQUENCIES)


def _frequencies(batches: Iterator[pa.RecordBatch], pattern: str, specials: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Posting lists per block, and one row per block with its keys and sizes."""
    cut = regex.compile(pattern).findall
    special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    blocks = 0
    index: dict[str, int] = defaultdict(count().__next__)
    words, places, counts = array("I"), array("I"), array("I")
    keys: list = []
    sizes: list[int] = []
    chars = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal blocks, index, words, places, counts, keys, sizes, chars
        name = f"{task}-{blocks}"
        given = np.array([0 if k is None else k for k in keys], np.int64).tobytes() + np.packbits(np.array([k is None for k in keys], bool)).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"\0{name}"]), pa.array([name]), pa.array([None], pa.binary()), pa.array([given], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary())], schema=FREQUENCIES
        )
        if index:
            yield from _posting_rows(index, words, places, counts, name)
        blocks, index = blocks + 1, defaultdict(count().__next__)
        words, places, counts = array("I"), array("I"), array("I")
        keys, sizes, chars = [], [], 0

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: Counter[str] = Counter()
            if special is not None and any(s in text for s in specials):
                last = 0
                for m in special.finditer(text):
                    found.update(cut(text[last : m.start()]))
                    found[m.group()] += 1
                    last = m.end()
                found.update(cut(text[last:]))
            else:
                found.update(cut(text))
            words.extend(map(index.__getitem__, found))
            places.extend([len(keys)] * len(found))
            counts.extend(found.values())
            keys.append(key)
            sizes.append(len(text.encode()))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(keys) == PLACES:
                yield from flush()
    if keys:
        yield from flush()


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Pieces of each distinct pre-token; rows come sorted, so equal ones follow one another."""
    merges = bpe.load(path)
    before = None
    for batch in batches:
        words = list(dict.fromkeys(batch.column(0).to_pylist()))
        if words and words[0] == before:
            words = words[1:]
        before = words[-1] if words else before
        words = [w for w in words if not NAME.match(w)]
        pieces = merges.encode([w.encode() for w in words])
        counts = [1 if w in merges.specials else len(p) for w, p in zip(words, pieces, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["on", "pieces"])


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of count x pieces per document of each block, packed again; rows of keys pass through.

    A task adds up what it has of each document until PENDING entries have come together.
    """
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def flush() -> Iterator[pa.RecordBatch]:
        at, back = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.uint32)
        edges = np.searchsorted(at, np.arange(len(names) + 1) * PLACES)
        blocks = [(name, lo, hi) for name, lo, hi in zip(names, edges[:-1], edges[1:], strict=True) if hi > lo]
        packed = [(at[lo:hi] % PLACES).astype(np.uint16).tobytes() + sums[lo:hi].tobytes() for _, lo, hi in blocks]
        nothing = pa.nulls(len(blocks), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.string()), pa.array(packed, pa.binary()), nothing, nothing], schema=PARTIALS)

    for batch in batches:
        heads = pc.is_null(batch.column("counts"))
        if pc.any(heads).as_py():
            head = batch.filter(heads)
            yield pa.RecordBatch.from_arrays([head.column("block"), pa.nulls(head.num_rows, pa.binary()), head.column("keys"), head.column("sizes")], schema=PARTIALS)
            batch = batch.filter(pc.invert(heads))
        if not batch.num_rows:
            continue
        packed = batch.column("counts")
        lengths = pc.binary_length(packed).to_numpy() // 4
        pairs = np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(lengths)
        places = np.cumsum(pairs[:, 0])
        places -= np.repeat(np.r_[0, places[ends[:-1] - 1]], lengths)
        code = np.array([names.setdefault(b, len(names)) for b in batch.column("block").to_pylist()], np.int64)
        held.append((np.repeat(code, lengths) * PLACES + places, pairs[:, 1] * np.repeat(batch.column("pieces").to_numpy(), lengths)))
        pending += len(pairs)
        if pending >= PENDING:
            yield from flush()
            names, held, pending = {}, [], 0
    if held:
        yield from flush()


def _whole_sums(block: pd.DataFrame) -> pd.DataFrame:
    """All documents of one block with their sums."""
    head = block[block["keys"].notna()].iloc[0]
    sizes = np.frombuffer(head["sizes"], np.int64)
    keys = np.frombuffer(head["keys"][: 8 * len(sizes)], np.int64)
    nulls = np.unpackbits(np.frombuffer(head["keys"][8 * len(sizes) :], np.uint8), count=len(sizes)).astype(bool)
    total = np.zeros(len(sizes), np.int64)
    for packed in block["sums"].dropna():
        n = len(packed) // 6
        total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint32, n, 2 * n)
    return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(keys.copy(), nulls), "n_bytes": sizes, "n_tokens": total})


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """Tokens of each whole text under a byte-level vocabulary: doc_id, n_bytes, n_tokens, over_limit.

    `path` is the tokenizer file, which every executor has in place. Its special strings count as one token
    each where they occur in a text. Null text is empty and has no tokens. A repeated row is counted as a
    row of its own; a null key stays null. An empty table gives an empty result.
    """
    specials = tuple(bpe.load(path).specials)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    schema = "`on` string, block string, counts binary, keys binary, sizes binary"
    # Dealt once by pre-token: the same exchange feeds the distinct pre-tokens and the join.
    frequencies = rows.mapInArrow(partial(_frequencies, pattern=pattern, specials=specials), schema).repartition("on")
    pieces = frequencies.sortWithinPartitions("on").mapInArrow(partial(_count_pieces, path=path), "`on` string, pieces int")
    joined = frequencies.join(pieces, "on", "left").select("block", "counts", "keys", "sizes", "pieces")
    sums = joined.mapInArrow(_partial_sums, "block string, sums binary, keys binary, sizes binary")
    counted = sums.groupBy("block").applyInPandas(_whole_sums, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
