"""Similarity join of documents on word n-grams, by prefix filters under several token orders.

Two sets as similar as asked share a token among the first few of each, under any order of all tokens. So
a pair has to share such a token under every order before its sets are compared. Frequent tokens come last
in every order, which keeps shared passages out of the prefixes.

Copies are one node. Nodes that share a prefix token under the first order meet in the bucket of that
token's leader, the node with the least checksum; as most tokens of a group of near copies have the same
leader, a node goes to few buckets. A bucket is dealt in blocks of bounded size. A block finds its
candidates in an index of the prefixes, asks the further orders, compares the sets of what is left, skips
what is connected already, and returns a forest of links. Where a bucket of several blocks still has
several components, its blocks then meet two by two. No row is made per pair, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import settle, whole_text
from gridweave.llm.components import components

SLICE_CHARS = 1 << 20
BLOCK_TOKENS = 1 << 21
HOT_TOKENS = 1 << 22
BLOCK_WEIGHT = 1 << 21
NODE_WEIGHT = 64
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text, A-Z in lower case.

    A text of fewer words has one, the whole sequence; a text without words has none.
    """
    cut = [t.encode().lower().split() for t in texts]
    flat = np.empty(sum(map(len, cut)), object)
    flat[:] = [w for ws in cut for w in ws]
    codes, distinct = pd.factorize(flat)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes] if len(flat) else np.zeros(0, np.uint64)

    def grams(h: np.ndarray, n: int) -> np.ndarray:
        s = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return s

    # All texts at once; the n-grams that reach over the end of a text are left out.
    full = grams(hashed, words) if len(hashed) >= words else hashed[:0]
    out, at = [], 0
    for ws in cut:
        s = full[at : at + len(ws) - words + 1] if len(ws) >= words else grams(hashed[at : at + len(ws)], len(ws)) if ws else hashed[:0]
        at += len(ws)
        s = np.sort(s)
        out.append(s[np.diff(s, prepend=~s[:1]) != 0])
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lo, chars = 0, 0
    lengths = pc.utf8_length(batch.column("text")).to_pylist()
    for i, n in enumerate(lengths):
        chars += n
        if chars >= SLICE_CHARS or i == len(lengths) - 1:
            yield batch.slice(lo, i + 1 - lo)
            lo, chars = i + 1, 0


def _token_counts(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Low halves of the tokens of a block with the number of its documents that have them, packed per bucket of the token."""
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
    width = -(-(1 << 32) // buckets)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(tokens, np.arange(0, buckets + 1, dtype=np.uint64) * np.uint64(width))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            part, n = (tokens[edges[b] : edges[b + 1]] - np.uint64(b * width)).astype(np.uint32), counts[edges[b] : edges[b + 1]]
            gaps = np.diff(part, prepend=np.uint32(0))
            kind = np.uint16 if gaps.max() < 65536 else np.uint32
            many = np.flatnonzero(n > 1)
            rows.append((int(b), bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes(), np.concatenate([many, n[many]]).astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    held, size = [], 0
    for batch in batches:
        for part in _slices(batch):
            for s in shingle_sets(part.column("text").to_pylist(), words):
                held.append(s & _LOW)
                size += len(s)
            if size >= BLOCK_TOKENS:
                yield from flush(held)
                held, size = [], 0
    if size:
        yield from flush(held)


def _level(counts: np.ndarray) -> np.ndarray:
    """Eight levels per doubling of a count: at most 512, and each count up to 8 has its own."""
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def _frequent(bucket: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Tokens of a bucket that two documents or more have, packed per level of their count."""
    width = -(-(1 << 32) // buckets)
    tokens, counts = [], []
    for packed, many in zip(bucket["tokens"], bucket["counts"], strict=True):
        t = np.cumsum(np.frombuffer(packed, np.uint16 if packed[0] == 2 else np.uint32, offset=1), dtype=np.int64)
        n = np.ones(len(t), np.int64)
        at = np.frombuffer(many, np.uint32).astype(np.int64).reshape(2, -1)
        n[at[0]] = at[1]
        tokens.append(t)
        counts.append(n)
    distinct, back = np.unique(np.concatenate(tokens), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts))
    hot = (distinct[count > 1] + int(bucket["bucket"].iloc[0]) * width).astype(np.uint32)
    level = _level(count[count > 1])
    found = [(int(v), hot[level == v]) for v in np.unique(level)]
    return pd.DataFrame({"level": [v for v, _ in found], "n": [len(t) for _, t in found], "hot": [t.tobytes() for _, t in found]})


def frequent_tokens(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """Low halves of the most frequent tokens of two documents or more, HOT_TOKENS of them at most.

    Counts cover all documents. A block of documents sends each distinct token once, in two bytes mostly. The
    least count is the lowest level of counts at which the tokens counted fit the bound.
    """
    rows = docs.select(whole_text(text).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0]
    buckets = max(16, min(1 << 24, int(total or 0) >> 21))
    packed = rows.mapInArrow(partial(_token_counts, words=words, buckets=buckets), "bucket bigint, tokens binary, counts binary")
    found = settle(packed.groupBy("bucket").applyInPandas(partial(_frequent, buckets=buckets), "level bigint, n bigint, hot binary"))
    room, least = HOT_TOKENS, 1 << 62
    for level, n in sorted(found.groupBy("level").agg(F.sum("n")).collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    chosen = found.where(F.col("level") >= least).select("hot").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r["hot"]) for r in chosen), np.uint32))


def _is_hot(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), bool)
    # In their order, as neighbours are then found close to each other.
    low = (tokens & _LOW).astype(np.uint32)
    order = np.argsort(low)
    low = low[order]
    found = np.empty(len(tokens), bool)
    found[order] = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
    return found


def prefix(tokens: np.ndarray, late: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set under the first order, those that are not frequent and those that are.

    A set at least `percent` similar has one of them in its own prefix."""
    n = len(tokens)
    first = np.lexsort((_mix(tokens * np.uint64(ORDERS[0])), late))[: n - -(-percent * n // 100) + 1]
    late = late[first]
    return tokens[first[~late]], tokens[first[late]]


def _summaries(batches: Iterator[pa.RecordBatch], words: int, percent: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64), pa.int64()))

    for batch in batches:
        for part in _slices(batch):
            texts = part.column("text").to_pylist()
            sets = shingle_sets(texts, words)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            marks = [hashlib.sha1(t.encode()).digest() for t in texts]
            late = np.split(_is_hot(np.concatenate(sets), hot), np.cumsum([len(s) for s in sets])[:-1])
            firsts = [prefix(s, h, percent) if len(s) else (s, s) for s, h in zip(sets, late, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary()), lists([f[0] for f in firsts]), lists([f[1] for f in firsts])],
                names=["doc_id", "n_shingles", "digest", "key", "text_sha1", "prefix", "hot_prefix"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The sets of wanted texts. A row whose text is another one's with the same doc_id has not the digest asked for, and goes."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in _slices(batch):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            kept = []
            for i, (digest, tokens) in enumerate(zip(part.column("digest").to_pylist(), sets, strict=True)):
                if digest not in seen and hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() == digest:
                    seen.add(digest)
                    kept.append(i)
            mine = part.take(pa.array(kept, pa.int64()))
            columns = [mine.column(c) for c in ("doc_id", "digest", "places")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in kept], pa.binary())], names=["name", "digest", "places", "tokens"])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other; no range is empty."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)


def block_links(sets: list[np.ndarray], labels: np.ndarray, percent: int, hot: np.ndarray) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect all that links in a block: a forest, given what `labels` says is connected.

    Candidates share a prefix token under every order; only then are their sets compared. No set is empty.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, label = size[order], labels[order].copy()
    start = np.concatenate([[0], np.cumsum(size)])
    distinct, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    late = _is_hot(distinct, hot)[codes]
    first = size - -(-percent * size // 100) + 1
    first_start = np.concatenate([[0], np.cumsum(first)])
    inside = np.arange(len(codes)) - start[owner] < first[owner]
    prefixes = [codes[np.lexsort((_mix(distinct * np.uint64(seed))[codes], late, owner))[inside]] for seed in ORDERS]
    by_code = np.argsort(prefixes[0], kind="stable")
    has = np.repeat(np.arange(len(size)), first)[by_code]
    count = np.bincount(prefixes[0], minlength=len(distinct))
    code_start = np.cumsum(count) - count
    last = np.searchsorted(size, 100 * size // percent, side="right")
    met, mark, links = np.zeros(len(size), bool), np.zeros(len(distinct), bool), []

    def hits(mine: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        mark[mine] = True
        found = np.add.reduceat(mark[flat[_ranges(starts, lengths)]], np.cumsum(lengths) - lengths, dtype=np.int64)
        mark[mine] = False
        return found

    for i in range(len(size)):
        own = prefixes[0][first_start[i] : first_start[i + 1]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        met[has[_ranges(code_start[own], count[own])]] = True
        at = i + 1 + np.flatnonzero(met[i + 1 : last[i]])
        met[:] = False
        at = at[label[at] != label[i]]
        for p in prefixes[1:]:
            if len(at):
                at = at[hits(p[first_start[i] : first_start[i + 1]], p, first_start[at], first[at]) > 0]
        if not len(at):
            continue
        shared = hits(codes[start[i] : start[i + 1]], codes, start[at], size[at])
        at = at[100 * shared >= percent * (size[i] + size[at] - shared)]
        joined, which = np.unique(label[at], return_index=True)
        if len(joined):
            links.extend((int(order[i]), int(order[j])) for j in at[which])
            label[np.isin(label, joined)] = label[i]
    return links


def _links(batches: Iterator[pa.RecordBatch], percent: int, hot: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Links inside each block of rows sorted by block; small blocks are taken together."""

    def flush(held: dict) -> pa.RecordBatch:
        rows = list(held.values())
        _, labels = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
        found = block_links([np.frombuffer(r[2], np.uint64) for r in rows], labels, percent, hot) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([rows[pair[side]][0] for pair in found], pa.int64()) for side in (0, 1)], names=["u", "v"])

    held, weight, now = {}, 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("leader", "block", "digest", "name", "label", "tokens")]
        for leader, part, digest, name, label, tokens in zip(*columns, strict=True):
            if (leader, part) != now and weight >= block:
                yield flush(held)
                held, weight = {}, 0
            now = (leader, part)
            if digest not in held:
                held[digest] = (name, label, tokens)
                weight += len(tokens) // 8 + NODE_WEIGHT
    if held:
        yield flush(held)


def _buckets(nodes: DataFrame, percent: int) -> DataFrame:
    """leader, key and n of the nodes that share a prefix token, and near sizes, with the leader or under its name.

    A token that is not frequent has few nodes by its count: sorted by size they fall into runs between which
    no two are near. A frequent one is aggregated per band of sizes and joined back, so that it can be split;
    a node takes its own band and the next, as sizes that are near lie in one or two neighbouring bands.
    """
    by_size = Window.partitionBy("token").orderBy("n")
    run = Window.partitionBy("token", "run")
    few = nodes.select("key", F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("token"))
    few = few.withColumn("gap", (F.lit(percent) * F.col("n").cast("bigint") > F.lit(100) * F.lag("n").over(by_size).cast("bigint")).cast("int"))
    few = few.withColumn("run", F.sum(F.coalesce("gap", F.lit(0))).over(by_size))
    few = few.withColumn("df", F.count(F.lit(1)).over(run)).withColumn("leader", F.min("key").over(run)).where("df > 1")
    width = max(math.log(100 / percent), 1e-9) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width))
    many = nodes.where(F.size("hot_prefix") > 0).select("key", F.col("n_shingles").cast("int").alias("n"), F.explode(F.array(band, band + 1)).alias("band"), "hot_prefix")
    many = many.select("key", "n", "band", F.explode("hot_prefix").alias("token"))
    leaders = many.groupBy("token", "band").agg(F.count(F.lit(1)).alias("df"), F.min("key").alias("leader")).where("df > 1").drop("df")
    met = few.select("leader", "key", "n").unionByName(many.join(leaders, ["token", "band"]).select("leader", "key", "n"))
    return met.groupBy("leader", "key").agg(F.max("n").alias("n"))


def _block_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """leader, block, key and label of pairs of blocks of those leaders whose nodes are still in several components.

    A component of more than half a block has blocks of its own, which do not meet each other; smaller ones
    are dealt to common blocks. Blocks without near sizes do not meet.
    """
    half = max(1, block // 2)
    weighed = members.groupBy("leader", "label").agg(F.sum(F.col("n") + NODE_WEIGHT).alias("w")).withColumn("own", F.ceil(F.col("w") / half))
    small = F.when(F.col("own") == 1, F.col("w"))
    pool = weighed.groupBy("leader").agg(F.count(F.lit(1)).alias("labels"), F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(small), F.lit(0)) / half)).alias("pool")).where("labels > 1").drop("labels")
    common = F.col("own") == 1
    dealt = members.join(weighed.drop("w").join(pool, "leader"), ["leader", "label"])
    dealt = dealt.withColumn("of", F.when(common, F.lit(None).cast("bigint")).otherwise(F.col("label")))
    dealt = dealt.withColumn("part", F.when(common, F.pmod(F.xxhash64("label"), "pool")).otherwise(F.pmod(F.xxhash64("key"), "own")))
    dealt = settle(dealt.withColumn("mark", F.xxhash64(F.coalesce("of", F.lit(0)), F.col("of").isNull(), "part")).select("leader", "key", "label", "n", "of", "mark"))
    blocks = dealt.groupBy("leader", "mark").agg(F.max("of").alias("of"), F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = (blocks.select("leader", *[F.col(c).alias(f"{c}_{side}") for c in ("mark", "of", "low", "high")]) for side in "xy")
    near = (F.lit(100) * F.col("high_x").cast("bigint") >= F.lit(percent) * F.col("low_y").cast("bigint")) & (F.lit(100) * F.col("high_y").cast("bigint") >= F.lit(percent) * F.col("low_x").cast("bigint"))
    apart = F.coalesce(F.col("of_x") != F.col("of_y"), F.lit(True))
    pairs = x.join(y, "leader").where((F.col("mark_x") <= F.col("mark_y")) & near & apart).withColumn("block", F.xxhash64("mark_x", "mark_y"))
    sides = pairs.select("leader", "block", F.explode(F.array_distinct(F.array("mark_x", "mark_y"))).alias("mark"))
    return dealt.select("leader", "key", "label", "mark").join(sides, ["leader", "mark"]).select("leader", "block", "key", "label")


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK_WEIGHT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links) of each document, with checksums of its set and text.

    Two documents link when the sets of their word n-grams are at least `percent` similar (Jaccard). Null
    text is empty; texts without words link with nothing. A row without doc_id cannot name a component: its
    component is null and it links nothing. Rows that repeat a doc_id stand for one node if their texts have
    one set; texts that differ share the node's name and links. An empty table gives an empty result. `block` bounds what
    one task compares at a time, in tokens; the result does not depend on it.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    hot = frequent_tokens(rows, words)
    summary = settle(rows.mapInArrow(partial(_summaries, words=words, percent=percent, hot=hot), "doc_id bigint, n_shingles bigint, digest binary, key bigint, text_sha1 binary, prefix array<bigint>, hot_prefix array<bigint>"))
    named = summary.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    prefixes = named.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("key", "n_shingles", "prefix", "hot_prefix")])
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("key").alias("key"))
    members = settle(_buckets(prefixes, percent))

    def linked(dealt: DataFrame) -> DataFrame:
        """Links inside the blocks of (leader, block, key, label), each block in one task. A set goes from its text straight to its blocks."""
        places = dealt.groupBy("key").agg(F.collect_list(F.struct("leader", "block", "label")).alias("places"))  # as many as prefix tokens at most
        wanted = nodes.join(places, "key").select(F.col("node").alias("doc_id"), "digest", "places")
        schema = "name bigint, digest binary, places array<struct<leader: bigint, block: bigint, label: bigint>>, tokens binary"
        sets = rows.join(wanted, "doc_id").mapInArrow(partial(_sets, words=words), schema)
        placed = sets.select(F.explode("places").alias("at"), "digest", "name", "tokens")
        placed = placed.select("at.leader", "at.block", "digest", "name", F.coalesce("at.label", "name").alias("label"), "tokens")
        return placed.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(partial(_links, percent=percent, hot=hot, block=block), "u bigint, v bigint")

    weights = members.groupBy("leader").agg(F.ceil(F.sum(F.col("n") + NODE_WEIGHT) / block).alias("blocks"))
    dealt = members.join(weights, "leader")
    one = F.array(F.pmod(F.xxhash64("leader", "key"), "blocks"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)  # the leader, near to all, goes to each block
    once = dealt.select("leader", "key", F.explode(F.when(F.col("leader") == F.col("key"), everywhere).otherwise(one)).alias("block"))
    edges = settle(linked(once.withColumn("label", F.lit(None).cast("bigint"))))
    final = components(edges)
    large = dealt.where("blocks > 1").select("leader", "key", "n")
    if large.limit(1).count():
        placed = large.join(nodes.select("key", "node"), "key").join(final, "node", "left").withColumn("label", F.coalesce("component", "node"))
        more = settle(linked(_block_pairs(placed.select("leader", "key", "label", "n"), percent, block)))
        final = components(edges.unionByName(more))

    classes = nodes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    result = summary.select("doc_id", "n_shingles", "digest", "text_sha1").join(classes, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return result.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "digest", "text_sha1")


def keep_one_of_each(docs: DataFrame, linked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that name their component: one document of each group stays, the one with the least doc_id.

    Rows without doc_id stay. Rows that repeat a doc_id are decided one by one, by their texts: a text that
    resembles nothing stays, whatever the other texts of its doc_id do. Of rows with one doc_id and one set the
    least by all columns stays. Texts of one doc_id are not compared with each other.
    """
    named = linked.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key), F.col("digest").alias("__digest"), F.col("text_sha1").alias("__mark"))
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    without = docs.where(F.col(key).isNull())
    if repeated.limit(1).count() == 0:
        return docs.join(named.select(key).distinct().hint("shuffle_hash"), key, "left_semi").unionByName(without)
    repeated = settle(repeated)
    once = named.join(repeated, key, "left_anti").select(key).distinct()
    again = docs.join(repeated, key, "left_semi").withColumn("__mark", F.unhex(F.sha1(whole_text(text))))
    chosen = again.join(named.distinct(), [key, "__mark"]).groupBy(key, "__digest").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("__row")).select("__row.*")
    return docs.join(once.hint("shuffle_hash"), key, "left_semi").unionByName(chosen).unionByName(without)
