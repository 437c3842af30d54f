"""Encoding documents with a vocabulary of words with word ends, and decoding them again."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import chain
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import whole_text

# Fixed value: how the vocabulary of words cuts a normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 200_000
SLICE_CHARS = 1 << 20


def normalise(text: str) -> str:
    """Composed characters, lower case character by character. White space only parts words, so it stays."""
    if text.isascii():
        return text.lower()
    if not is_normalized("NFC", text):
        text = normalize("NFC", text)
    # A capital sigma becomes the inner form wherever it stands.
    return text.replace("Σ", "σ").lower()


def check_file(path: str) -> None:
    """Refuse a tokenizer file whose steps are not those of `normalise` and PATTERN."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    steps = [n["type"] for n in (content["normalizer"] or {}).get("normalizers", [])]
    cuts = (content["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or not cuts or cuts[0]["pattern"] != {"Regex": PATTERN} or content["decoder"] is not None:
        raise ValueError("the tokenizer file has other steps than this operator applies")


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merges = bpe.load(path)
    cut = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, merges.specials)))
    known: dict[str, int] = {}  # places of words in `table`, which has their ids
    kind = pa.list_(pa.int32())
    table = pa.array([], kind)

    def words_of(text: str) -> list[str]:
        if "<|" not in text:
            return cut(normalise(text))
        found, last = [], 0
        for m in special.finditer(text):
            found += cut(normalise(text[last : m.start()]))
            found.append(m.group())
            last = m.end()
        return found + cut(normalise(text[last:]))

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto

    for batch in batches:
        for part in slices(batch):
            # Copies of a text are encoded once.
            distinct = part.column("text").dictionary_encode()
            texts = [words_of(t) for t in distinct.dictionary.to_pylist()]
            new = set(chain.from_iterable(texts)).difference(known)
            if len(known) + len(new) > CACHE_WORDS:
                known, table = {}, table[:0]
                new = set(chain.from_iterable(texts))
            ordered = list(new)
            encoded = [[merges.specials[w]] if w in merges.specials else ids for w, ids in zip(ordered, merges.encode([w.encode() for w in ordered]), strict=True)]
            known.update(zip(ordered, range(len(table), len(table) + len(ordered)), strict=True))
            table = pa.concat_arrays([table, pa.array(encoded, kind)])
            ends = np.cumsum([0, *map(len, texts)])
            places = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32, ends[-1])
            of_words = table.take(pa.array(places))
            of_texts = pa.ListArray.from_arrays(pa.array(of_words.offsets.to_numpy()[ends]), of_words.values)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), of_texts.take(distinct.indices)], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = bpe.load(path).tokens
    table = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)], pa.large_string())
    for batch in batches:
        ids = batch.column("ids")
        at = 0
        while at < batch.num_rows:
            part = ids.slice(at, 256)
            named = pa.ListArray.from_arrays(pc.subtract(part.offsets, part.offsets[0]), table.take(part.flatten()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), part, pc.binary_join(named, " ")], names=["doc_id", "ids", "decoded"])
            at += 256


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, path), path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of each whole text: doc_id, ids; no begin or end is added, special strings become their ids.

    Null text is empty and has no ids. Rows stay as they are, one by one; the table is not shuffled. Words
    are encoded once per task while they are in a cache of bounded size.
    """
    check_file(path)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(partial(_encode, path=path), "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text: tokens with their word ends, one space between them."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`decode_ids` of `encode_documents` in one Python worker per task.

    Two operators in a row would hold two workers per task, each with a vocabulary, and ids would go to the JVM
    and back; idle workers stay with the executor and are used in turn by all that follows.
    """
    check_file(path)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(partial(_round_trip, path=path), "doc_id bigint, ids array<int>, decoded string")


def codec_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the checksums of ids and decoded text."""
    both = round_trip(docs, path)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
