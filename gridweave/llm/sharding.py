"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring, no table. When shards are
appended, a row stays or moves into one of the new shards. All of it is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import whole_text
from gridweave.operators.scaling import number_rows

MULTIPLIER = 2862933555777941757
LIMB = 24
FIRST_STEPS = 64


def _next_key(key: Column) -> Column:
    """`key * MULTIPLIER + 1` modulo 2**64. In limbs of 24 bits, as a product of two longs would overflow."""
    mask = (1 << LIMB) - 1
    m0, m1, m2 = (F.lit((MULTIPLIER >> (LIMB * i)) & mask).cast("bigint") for i in range(3))
    k0 = key.bitwiseAND(F.lit(mask))
    k1 = F.shiftrightunsigned(key, LIMB).bitwiseAND(F.lit(mask))
    k2 = F.shiftrightunsigned(key, 2 * LIMB)
    low = k0 * m0 + F.lit(1)
    middle = k0 * m1 + k1 * m0 + F.shiftright(low, LIMB)
    high = k0 * m2 + k1 * m1 + k2 * m0 + F.shiftright(middle, LIMB)
    return F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 2 * LIMB).bitwiseOR(F.shiftleft(middle.bitwiseAND(F.lit(mask)), LIMB)).bitwiseOR(low.bitwiseAND(F.lit(mask)))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to shards - 1.

    Each step jumps to a bucket further right; the last one before `shards` is the answer. A jump moves
    right by one at least, so `shards` steps always suffice; the first 64 are enough but for about one
    key in 10**20, and the rest are only evaluated for such a key.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(state: Column, _: Column) -> Column:
        key2 = _next_key(state["key"])
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(key2, 33) + 1).cast("double")))
        live = state["next"] < shards
        return F.struct(
            F.when(live, key2).otherwise(state["key"]).alias("key"),
            F.when(live, state["next"]).otherwise(state["at"]).alias("at"),
            F.when(live, jump).otherwise(state["next"]).alias("next"),
        )

    start = F.struct(key.cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), start, step)
    if shards > FIRST_STEPS:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards - FIRST_STEPS)), state, step)
        return F.when(state["next"] >= shards, state["at"]).otherwise(rest["at"]).cast("int")
    return state["at"].cast("int")


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", blocks: int = 4096) -> DataFrame:
    """Shard, slot and shard after one more shard for each row: key, size, text_crc32, law, shard, slot, grown_shard.

    The size is that of the text in UTF-8 plus 1. Slots number the rows of a shard from 0 without gaps
    in the order of a hash block of the row, then key, checksum and size; rows that are equal in all of
    these get consecutive slots. A shard is numbered block by block, so no task holds a shard. The texts
    do not move.

    Null text: no bytes, checksum 0. Null key: hashed as 0, kept as null. Other columns are not read.
    """
    own = whole_text(text)
    hashed = F.coalesce(F.col(key).cast("bigint"), F.lit(0))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(own) + 1).cast("bigint").alias("size"),
        F.crc32(own.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(hashed, shards).alias("shard"),
        jump_hash(hashed, shards + 1).alias("grown_shard"),
    )
    block = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string")).cast("binary")) % blocks
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    numbered = number_rows(rows, ["shard"], order, block, "__slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("__slot") - 1).alias("slot"), "grown_shard")
