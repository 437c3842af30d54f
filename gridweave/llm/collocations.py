"""Collocations: phrases that occur more often than their parts would let expect, by counting automata.

Words are cut and coded block by block. Only words that are frequent enough themselves can be part of a
frequent phrase, so each block is told the numbers of its frequent words, and the others end a window. The
windows of a block (the words from each place on, up to the longest phrase) are sorted and built into an
acyclic transducer, state by state as the prefix changes: the weight of a state is the number of windows
that begin so, which is the count of that phrase. Transducers are cut at fixed points of the order of
windows; all pieces of one range are united and their weights summed in one task. A phrase that lies on
the edge of a range gives its partial counts, which are added up.

The range of a window is where an arithmetic coder with the frequencies of single words would put it. So
ranges hold about equally many windows, and a very frequent first word is cut further by the words after it.

Counts of parts: blocks of phrases send the parts of their phrases, as transducers, to the tasks that hold
them, which compose them with their own and send the weights back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import settle, whole_text

BLOCK_WORDS = 1 << 21
RANGE_WORDS = 1 << 20
BUCKET_WORDS = 1 << 18
BLOCK_PHRASES = 1 << 15
#: Every byte that ends a piece becomes a full stop.
_STOPS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0 on, in their narrowest form, byte by byte of equal weight."""
    out = [struct.pack("<I", len(arrays))]
    for a in map(_narrow, arrays):
        out.append(struct.pack("<BQ", a.itemsize, len(a)))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
    return zstandard.compress(b"".join(out), 3)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        width, size = struct.unpack_from("<BQ", data, at)
        planes = np.frombuffer(data, np.uint8, width * size, at + 9).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 9 + width * size
    return out


def sort_order(windows: np.ndarray) -> np.ndarray:
    """The order of rows of numbers from 0 on; columns are joined into as few keys as 63 bits allow."""
    bits = max(1, int(windows.max()).bit_length()) if windows.size else 1
    per, keys = max(1, 63 // bits), []
    for lo in range(0, windows.shape[1], per):
        key = windows[:, lo].astype(np.int64)
        for c in range(lo + 1, min(lo + per, windows.shape[1])):
            key = (key << bits) | windows[:, c]
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def distinct_rows(windows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(windows):
        return windows, np.zeros(0, np.int64)
    order = sort_order(windows)
    rows = windows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    sums = np.diff(np.append(first, len(rows))) if counts is None else np.add.reduceat(counts[order], first)
    return rows[first], sums


class CountTransducer:
    """An acyclic automaton over words: the weight of a state is how many sequences begin with its path.

    States are numbered by depth in the order of their paths; `parents` and `labels` are the arcs into them.
    """

    def __init__(self, labels: list[np.ndarray], parents: list[np.ndarray], ends: list[np.ndarray]) -> None:
        self.labels, self.parents, self.ends = labels, parents, ends
        self.weights = [e.copy() for e in ends]
        for d in range(len(ends) - 1, 0, -1):
            np.add.at(self.weights[d - 1], parents[d], self.weights[d])

    @classmethod
    def from_sorted(cls, rows: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """From sorted distinct rows of words, 0 after the last word: a new state begins wherever the prefix changes."""
        labels, parents, ends = [], [], []
        changed = np.zeros(len(rows), bool)
        changed[:1] = True
        above = np.zeros(len(rows), np.int64)
        for d in range(rows.shape[1]):
            column = rows[:, d]
            changed[1:] |= column[1:] != column[:-1]
            begins = changed & (column != 0)
            at = np.flatnonzero(begins)
            if not len(at):
                break
            labels.append(column[at].astype(np.int64))
            parents.append(above[at])
            here = np.cumsum(begins) - 1
            last = (column != 0) & (rows[:, d + 1] == 0 if d + 1 < rows.shape[1] else True)
            stop = np.zeros(len(at), np.int64)
            stop[here[last]] = counts[last]  # a sequence that ends here is one row
            ends.append(stop)
            above = here
        return cls(labels, parents, ends)

    def paths(self, depth: int, states: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(states), width), np.int64)
        for d in range(depth, -1, -1):
            out[:, d] = self.labels[d][states]
            states = self.parents[d][states]
        return out

    def sequences(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences and their counts, sorted within each length."""
        found = [(d, np.flatnonzero(e)) for d, e in enumerate(self.ends)]
        rows = [self.paths(d, at, width) for d, at in found]
        return np.concatenate([np.zeros((0, width), np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *[self.ends[d][at] for d, at in found]])

    def to_bytes(self) -> bytes:
        children = [np.bincount(p, minlength=len(self.labels[d]) if d >= 0 else 1) for d, p in enumerate(self.parents, -1)]
        return pack_arrays([*self.labels, *children, *self.ends])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        arrays = unpack_arrays(data)
        n = len(arrays) // 3
        return cls(arrays[:n], [np.repeat(np.arange(len(c)), c) for c in arrays[n : 2 * n]], arrays[2 * n :])

    @classmethod
    def union(cls, many: list[CountTransducer], width: int) -> CountTransducer:
        """All sequences of several transducers, with the sums of their weights."""
        rows, counts = zip(*[t.sequences(width) for t in many], strict=True)
        return cls.from_sorted(*distinct_rows(np.concatenate(rows), np.concatenate(counts)))

    def compose(self, parts: CountTransducer, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of `parts` and the weights of the states that they lead to here, 0 where they lead to none."""
        rows, _ = parts.sequences(width)
        weights, at, state = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for d in range(len(self.labels)):
            span = int(max(self.labels[d].max(), rows[:, d].max(initial=0))) + 1
            arcs, wanted = self.parents[d] * span + self.labels[d], state * span + rows[at, d]
            to = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            on = (arcs[to] == wanted) & (rows[at, d] != 0)
            at, state = at[on], to[on]
            done = (rows[at, d + 1] == 0) if d + 1 < width else np.ones(len(at), bool)
            weights[at[done]] = self.weights[d][state[done]]
            at, state = at[~done], state[~done]
        return rows, weights


_BLOCKS = pa.schema([("block", pa.string()), ("lang", pa.string()), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("words", pa.binary()), ("coded", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of one language: their distinct words in order, how often each occurs, and the texts as codes (0 ends a piece)."""
    held: dict[str, list[bytes]] = {}
    made = total = 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal made
        tokens = held.pop(lang)
        flat = np.empty(len(tokens), object)
        flat[:] = tokens
        codes, distinct = pd.factorize(flat)
        order = sorted(range(len(distinct)), key=lambda i: (distinct[i] != b".", distinct[i]))
        rank = np.empty(len(distinct), np.int64)
        rank[order] = np.arange(len(distinct))
        coded = rank[codes]
        counts = np.bincount(coded)[1:]
        words = b"\n".join(distinct[i] for i in order[1:])
        row = {"block": f"{TaskContext.get().partitionId()}-{made}", "lang": lang, "n_words": int(counts.sum()), "n_distinct": len(counts), "words": words, "coded": pack_arrays([counts, coded])}
        made += 1
        return pa.RecordBatch.from_pylist([row], _BLOCKS)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            tokens = text.as_py().encode().lower().translate(_STOPS).replace(b".", b" . ").split()
            if tokens:
                tokens.append(b".")
                held.setdefault(lang, []).extend(tokens)
                total += len(tokens)
            if total >= block_words:
                largest = max(held, key=lambda k: len(held[k]))
                total -= len(held[largest])
                yield flush(largest)
    for lang in list(held):
        yield flush(lang)


def _word_messages(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of each block with their codes and counts, packed per bucket of the word."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("block", pa.string()), ("words", pa.binary()), ("numbers", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            counts = unpack_arrays(r["coded"])[0]
            words = np.array([*r["words"].split(b"\n"), None], object)[:-1] if len(counts) else np.zeros(0, object)
            bucket = np.array([crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            rows = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = order[lo:hi]
                rows.append({"lang": r["lang"], "bucket": int(bucket[at[0]]), "block": r["block"], "words": zstandard.compress(b"\n".join(words[at]), 3), "numbers": pack_arrays([at + 1, counts[at]])})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _frequent(messages: pd.DataFrame, least: int) -> pd.DataFrame:
    """Words of a bucket that all blocks together have often enough."""
    codes, words = pd.factorize(np.array([w for m in messages["words"] for w in zstandard.decompress(m).split(b"\n")] + [None], object)[:-1])
    sums = np.zeros(len(words), np.int64)
    np.add.at(sums, codes, np.concatenate([unpack_arrays(m)[1] for m in messages["numbers"]]))
    at = np.flatnonzero(sums >= least)
    return pd.DataFrame({"lang": messages["lang"].iloc[0], "word": [words[i].decode() for i in at], "n": sums[at].tolist()}, dtype=object)


def _replies(messages: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """To each block: codes and numbers of its frequent words of a bucket."""
    out: dict[str, list] = {"block": [], "told": [], "total": []}
    if len(messages) and len(known):
        index = pd.Index([w.encode() for w in known["word"]], dtype=object)
        numbers = known[["id", "before", "n_all"]].to_numpy(np.int64)
        for block, words, packed in zip(messages["block"], messages["words"], messages["numbers"], strict=True):
            found = index.get_indexer(pd.Index(zstandard.decompress(words).split(b"\n"), dtype=object))
            at = np.flatnonzero(found >= 0)
            if len(at):
                out["block"].append(block)
                out["told"].append(pack_arrays([unpack_arrays(packed)[0][at], *numbers[found[at]].T]))
                out["total"].append(int(known["total"].iloc[0]))
    return pd.DataFrame(out, dtype=object)


def windows_of(coded: np.ndarray, longest: int) -> np.ndarray:
    """The words from each place on, 0 from the end of the piece on."""
    padded = np.concatenate([coded, np.zeros(longest, coded.dtype)])
    starts = np.flatnonzero(coded)
    rows = np.zeros((len(starts), longest), np.int64)
    alive = np.ones(len(starts), bool)
    for d in range(longest):
        word = padded[starts + d]
        alive &= word != 0
        rows[alive, d] = word[alive]
    return rows


def places(rows: np.ndarray, before: np.ndarray, n: np.ndarray, total: float) -> np.ndarray:
    """Where each window falls among all, were words independent; along their order it never falls (each step is monotone, rounded or not)."""
    share = np.zeros(len(rows))
    for d in range(rows.shape[1] - 1, -1, -1):
        word = rows[:, d]
        share = np.where(word != 0, before[word] + n[word] * share, 0.0)
        if d:
            share = share / total
    return share


def _pieces(block: pd.DataFrame, known: pd.DataFrame, longest: int, range_words: int) -> pd.DataFrame:
    """The transducer of a block's windows, cut by ranges."""
    out: dict[str, list] = {"lang": [], "range": [], "piece": []}
    if len(block) and len(known):
        counts, coded = unpack_arrays(block["coded"].iloc[0])
        ids, before, n = np.zeros(len(counts) + 1, np.int64), np.zeros(len(counts) + 1), np.zeros(len(counts) + 1)
        for told in known["told"]:
            at, *numbers = unpack_arrays(told)
            ids[at], before[at], n[at] = numbers
        coded = np.where(ids[coded] != 0, coded, 0)
        rows, sums = distinct_rows(windows_of(coded, longest))
        ranges = np.floor(places(rows, before, n, float(known["total"].iloc[0])) / range_words).astype(np.int64)
        edges = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
        named = ids[rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            out["lang"].append(block["lang"].iloc[0])
            out["range"].append(int(ranges[lo]))
            out["piece"].append(CountTransducer.from_sorted(named[lo:hi], sums[lo:hi]).to_bytes())
    return pd.DataFrame(out, dtype=object)


def _phrases_of(rows: np.ndarray) -> list[bytes]:
    data, width = rows.astype(">i8").tobytes(), 8 * rows.shape[1]
    return [data[i : i + width] for i in range(0, len(data), width)]


def _rows_of(phrases: pd.Series, longest: int) -> np.ndarray:
    return np.frombuffer(b"".join(phrases), ">i8").astype(np.int64).reshape(-1, longest)


def _united(pieces: pd.DataFrame, least: int, longest: int) -> pd.DataFrame:
    """Phrases of a range with their counts: the frequent ones, and those that may reach over its edges."""
    whole = CountTransducer.union([CountTransducer.from_bytes(p) for p in pieces["piece"]], longest)
    phrases, counts = [], []
    for d, weights in enumerate(whole.weights):
        told = weights >= least
        told[[0, -1]] = True
        states = np.flatnonzero(told)
        phrases += _phrases_of(whole.paths(d, states, longest))
        counts.append(weights[states])
    return pd.DataFrame({"lang": pieces["lang"].iloc[0], "phrase": phrases, "n": np.concatenate(counts)})


def _parts(rows: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which phrases have more than `cut` words, their first `cut` words, and the rest of them."""
    at = np.flatnonzero(rows[:, cut]) if cut < rows.shape[1] else np.zeros(0, np.int64)
    first, rest = rows[at].copy(), np.zeros((len(at), rows.shape[1]), np.int64)
    first[:, cut:] = 0
    rest[:, : rows.shape[1] - cut] = rows[at, cut:]
    return at, first, rest


def _owner(rows: np.ndarray, owners: int) -> np.ndarray:
    """The task that holds a phrase."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(owners)).astype(np.int64)


def _asked(rows: np.ndarray) -> np.ndarray:
    """Distinct parts of some phrases."""
    longest = rows.shape[1]
    return distinct_rows(np.concatenate([p for cut in range(1, longest) for p in _parts(rows, cut)[1:]]))[0]


def _held_by(batches: Iterator[pa.RecordBatch], owners: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = _owner(_rows_of(batch.column("phrase").to_pylist(), longest), owners)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held)], names=[*batch.schema.names, "owner"])


def _requests(phrases: pd.DataFrame, owners: int, longest: int) -> pd.DataFrame:
    out: dict[str, list] = {"lang": [], "owner": [], "asker": [], "wanted": []}
    parts = _asked(_rows_of(phrases["phrase"], longest))
    to = _owner(parts, owners)
    for owner in np.unique(to):
        rows = parts[to == owner]
        out["lang"].append(phrases["lang"].iloc[0])
        out["owner"].append(int(owner))
        out["asker"].append(int(phrases["owner"].iloc[0]))
        out["wanted"].append(CountTransducer.from_sorted(rows, np.ones(len(rows), np.int64)).to_bytes())
    return pd.DataFrame(out, dtype=object)


def _answers(phrases: pd.DataFrame, requests: pd.DataFrame, longest: int) -> pd.DataFrame:
    out: dict[str, list] = {"lang": [], "asker": [], "told": []}
    if len(requests):
        whole = CountTransducer.from_sorted(*distinct_rows(_rows_of(phrases["phrase"], longest), phrases["n"].to_numpy()))
        whole.weights = whole.ends  # the counts are those of whole phrases already
        for lang, asker, wanted in zip(requests["lang"], requests["asker"], requests["wanted"], strict=True):
            rows, weights = whole.compose(CountTransducer.from_bytes(wanted), longest)
            out["lang"].append(lang)
            out["asker"].append(asker)
            out["told"].append(pack_arrays([*rows.T, weights]))
    return pd.DataFrame(out, dtype=object)


def _cuts(phrases: pd.DataFrame, answers: pd.DataFrame, longest: int) -> pd.DataFrame:
    """Each phrase of two words or more with the counts of the parts of each cut."""
    rows = _rows_of(phrases["phrase"], longest)
    at = np.flatnonzero(rows[:, 1]) if longest > 1 else np.zeros(0, np.int64)
    if not len(at):
        return pd.DataFrame({"lang": [], "phrase": [], "a": [], "l": [], "r": []}, dtype=object)
    told = [np.stack(unpack_arrays(t), axis=1) for t in answers["told"]]
    known = np.concatenate(told)
    places_of = {p: i for i, p in enumerate(_phrases_of(known[:, :-1]))}
    left, right = [[] for _ in rows], [[] for _ in rows]
    for cut in range(1, longest):
        longer, first, rest = _parts(rows, cut)
        for side, parts in ((left, first), (right, rest)):
            counts = known[[places_of[p] for p in _phrases_of(parts)], -1] if len(longer) else []
            for i, n in zip(longer, counts, strict=True):
                side[i].append(int(n))
    take = lambda values: [values[i] for i in at]
    return pd.DataFrame({"lang": phrases["lang"].iloc[0], "phrase": phrases["phrase"].to_numpy()[at], "a": phrases["n"].to_numpy()[at], "l": take(left), "r": take(right)})


def _unpacked(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Numbers of the words of each phrase, and the phrases without their first and without their last word."""
    for batch in batches:
        rows = _rows_of(batch.column("phrase").to_pylist(), longest)
        sizes = (rows != 0).sum(axis=1)
        shorter = rows.copy()
        shorter[np.arange(len(rows)), sizes - 1] = 0
        rest = np.zeros_like(rows)
        rest[:, :-1] = rows[:, 1:]
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(rows[rows != 0]))
        yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(_phrases_of(shorter), pa.binary()), pa.array(_phrases_of(rest), pa.binary())], names=[*batch.schema.names, "ids", "first", "rest"])


def vocabulary(words: DataFrame) -> DataFrame:
    """lang, word, id, before, n_all, total: words (lang, word, n) numbered from 1 in each language, with the occurrences of all words before.

    Words are dealt by ranges of their order; what windows add up is one row for each range and language.
    """
    dealt = settle(words.repartitionByRange("lang", "word").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("lang", "part").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang")
    offsets = dealt.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select(
        "lang", "part", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("ids"), F.coalesce(F.sum("s").over(along), F.lit(0)).alias("sums"), F.sum("s").over(whole).alias("total")
    )
    numbered = dealt.withColumn("i", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside)).join(offsets, ["lang", "part"])
    return settle(numbered.select("lang", "word", (F.col("ids") + F.col("i")).alias("id"), (F.col("sums") + F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("n_all"), "total"))


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that occur `least` times or more, per language; words; and all words per language.

    Texts (null: none) are taken in lower case (A to Z), pieces end at `.,;:!?` and line ends, words at blanks
    and tabs; a null language is `und`. Returns (lang, phrase, n) with phrases as packed word numbers, the
    vocabulary of frequent words, and (lang, n_words). All counts are exact. Empty tables give empty results.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    blocks = settle(rows.mapInArrow(partial(_blocks, block_words=block_words), "block string, lang string, n_words bigint, n_distinct bigint, words binary, coded binary"))
    buckets = 1 + int(blocks.agg(F.sum("n_distinct")).first()[0] or 0) // BUCKET_WORDS
    messages = blocks.mapInArrow(partial(_word_messages, buckets=buckets), "lang string, bucket bigint, block string, words binary, numbers binary")
    frequent = messages.groupBy("lang", "bucket").applyInPandas(partial(_frequent, least=least), "lang string, word string, n bigint")
    known = vocabulary(frequent).withColumn("bucket", F.crc32("word") % buckets)
    replies = messages.groupBy("lang", "bucket").cogroup(known.groupBy("lang", "bucket")).applyInPandas(_replies, "block string, told binary, total bigint")
    pieces = blocks.select("block", "lang", "coded").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(partial(_pieces, longest=longest, range_words=range_words), "lang string, range bigint, piece binary")
    counted = pieces.groupBy("lang", "range").applyInPandas(partial(_united, least=least, longest=longest), "lang string, phrase binary, n bigint")
    phrases = settle(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return phrases, known, blocks.groupBy("lang").agg(F.sum("n_words").alias("n_words"))


def part_counts(phrases: DataFrame, longest: int = 5, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """lang, phrase, a, l, r: phrases of two words or more with the counts of both parts of each cut, in order."""
    owners = 1 + phrases.count() // block_phrases
    held = settle(phrases.mapInArrow(partial(_held_by, owners=owners, longest=longest), "lang string, phrase binary, n bigint, owner bigint"))
    requests = held.groupBy("lang", "owner").applyInPandas(partial(_requests, owners=owners, longest=longest), "lang string, owner bigint, asker bigint, wanted binary")
    answers = held.groupBy("lang", "owner").cogroup(requests.groupBy("lang", "owner")).applyInPandas(partial(_answers, longest=longest), "lang string, asker bigint, told binary")
    return held.groupBy("lang", "owner").cogroup(answers.groupBy("lang", "asker")).applyInPandas(partial(_cuts, longest=longest), "lang string, phrase binary, a bigint, l array<bigint>, r array<bigint>")


def _lowest_cut() -> Column:
    """Score and counts of the cut that scores least, the first of equal ones; products are decimals, the quotient is whole."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = wide(F.col("a")).cast("decimal(18,0)") * wide(F.col("n")).cast("decimal(16,0)") * F.lit(1000).cast("decimal(4,0)")

    def scored(l: Column, r: Column) -> Column:  # noqa: E741
        return F.struct(F.call_function("div", top, l.cast("decimal(18,0)") * r.cast("decimal(18,0)")).alias("score"), l.alias("l"), r.alias("r"))

    cuts = F.zip_with("l", "r", scored)
    numbered = F.transform(cuts, lambda x, i: F.struct(x["score"].alias("score"), i.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    return F.array_min(numbered)


def top_collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **sizes: int) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(1000 a n / (l r)) with the counts of the phrase, of its parts, and of all words
    of the language; the least over the cuts counts. A phrase goes if a phrase of one word more that holds it
    is as frequent: then every longer one that is as frequent implies such a one.
    """
    phrases, known, sums = count_phrases(docs, least, longest, **sizes)
    told = part_counts(phrases, longest).mapInArrow(partial(_unpacked, longest=longest), "lang string, phrase binary, a bigint, l array<bigint>, r array<bigint>, ids array<bigint>, first binary, rest binary")
    cuts = settle(told)
    last = F.element_at("l", -1)
    same = cuts.where(last == F.col("a")).select("lang", F.col("first").alias("phrase")).unionByName(cuts.where(F.col("r")[0] == F.col("a")).select("lang", F.col("rest").alias("phrase"))).distinct()
    kept = cuts.join(same, ["lang", "phrase"], "left_anti").join(sums.withColumnRenamed("n_words", "n"), "lang")
    scored = kept.withColumn("cut", _lowest_cut()).select("lang", "phrase", "ids", "a", "n", "cut.score", "cut.l", "cut.r")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties stay until their words are known, as phrases decide among them.
    first = scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    spelled = (
        first.select("lang", "phrase", "a", "n", "score", "l", "r", F.posexplode("ids").alias("at", "id")).join(known.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "phrase", "a", "n", "score", "l", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("said"))
    )
    ranked = spelled.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "said")).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("said").alias("phrase"), "a", "l", "r", "n", "score")
