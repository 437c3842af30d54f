"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source, in a seeded order of its documents, are cut into blocks of equal length. Seats (one
per block of the mix) go to the sources by the highest quotients target / (2 k + 1); seat numbers are dealt
to the shards of the mix in turn, which gives each shard whole quotas per source that add up exactly. The
seats of a source are filled from its blocks in a second seeded order, again from the start when all are
taken, so a block is taken once more or once less than another at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import WORD, settle, word_count
from gridweave.operators.scaling import number_rows, running_total

BLOCK_WORDS = 64
ORDER_BLOCKS = 1024
SEATS_PER_BLOCK = 16384
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """Target words per source: source, source_size (given) -> plus weight and target.

    Sources in code point order, null last, get the weights in turn. `share` of all words is shared out by
    weight; a target stops at `repeats` times its source, and what is over is shared again by weight until
    none is above. With sources in the order of cap per weight that is one pass: the first source whose
    share of what is left stays below its cap fixes the level for itself and all after it.
    One row per source goes through one window.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    alphabetic = Window.orderBy(F.col("source").asc_nulls_last())
    capped = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(alphabetic) - 1) % len(weights) + 1).cast("int"))).withColumn(
        "__cap", repeats * F.col("source_size")
    )
    by_cap = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.least(F.sum("source_size").over(everything) * share, F.sum("__cap").over(everything)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("__level", level).withColumn("__fits", F.col("__level") * F.col("weight") <= F.col("__cap"))
    first = F.min(F.when(F.col("__fits"), F.struct(F.col("__cap") / F.col("weight"), F.col("__level").alias("level")))).over(everything)
    return levelled.withColumn("__first", first["level"]).select(
        "source", "source_size", "weight", F.when(F.col("__first").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__first") * F.col("weight"))).alias("target")
    )


def seat_quotas(targets: DataFrame, block_words: int, shards: int = 16) -> DataFrame:
    """Whole blocks per source and shard of the mix: source, shard, quota.

    As many seats as blocks in all targets. The quotient of seat k (from 0) of a source is target / (2 k + 1);
    a source cannot get more than its part of the seats, half its part of the number of sources, and one more,
    so that many are listed. Seats are ranked by quotient (ties by source), block by block of the inverse quotient, on which they lie
    evenly, so no task ranks all of them.
    """
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = targets.where(F.col("target") > 0).select(
        F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__null"), "target",
        F.sum("target").over(total).alias("__total"), F.round(F.sum("target").over(total) / block_words).cast("bigint").alias("__seats"), F.count(F.lit(1)).over(total).alias("__sources"),
    )
    seats = _listed(wanted, ["__null", "__name"], F.ceil(F.col("target") / F.col("__total") * (F.col("__seats") + F.col("__sources") / 2)) + 1, "__k")
    inverse = (2 * F.col("__k") + 1) / F.col("target")
    ranked = number_rows(
        seats.withColumn("__inverse", inverse), [], [F.col("__inverse"), F.col("__null"), F.col("__name")],
        F.floor(F.col("__inverse") * F.col("__seats") * block_words / 2 / SEATS_PER_BLOCK), "__rank",
    )
    return (
        ranked.where(F.col("__rank") <= F.col("__seats"))
        .groupBy("__null", "__name", ((F.col("__rank") - 1) % shards).cast("int").alias("shard"))
        .agg(F.count(F.lit(1)).alias("quota"))
        .select(F.when(~F.col("__null"), F.col("__name")).alias("source"), "shard", "quota")
    )


def _listed(df: DataFrame, keys: Sequence[str], count, name: str) -> DataFrame:
    """One row per number from 0 below `count`; few rows may list many numbers, so chunks of them are dealt to tasks first."""
    chunked = df.withColumn("__count", count.cast("bigint")).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / SEATS_PER_BLOCK))))
    first = F.col("__chunk") * SEATS_PER_BLOCK
    last = F.least(first + SEATS_PER_BLOCK, F.col("__count")) - 1
    return chunked.repartition(*keys, "__chunk").withColumn(name, F.explode(F.sequence(first, last))).drop("__count", "__chunk")


def _bucket(hashed: str):
    """Blocks of a 64-bit hash in its own order."""
    return F.shiftright(hashed, 64 - ORDER_BLOCKS.bit_length() + 1)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, repeats: int = 2, block_words: int | None = None, seed: int = 7, shards: int = 16,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken, and copies (the word ranges taken).

    `copies` lists, for each copy of the document in the mix, the ranges [first, last) of its words that the
    copy holds; `taken` is their sum. A block is BLOCK_WORDS words, less in tables of under four million
    words (a 65,536th of them), so that small sources are met closely too; a source is met to within a
    block. The seed decides the order, so reruns agree.

    Null text has no words and is never taken; null source is a source of its own; a repeated row is a row
    of its own. Without words all targets are 0. Only key, source and size go through shuffles: texts stay.
    """
    sized = settle(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sources, weights, share, repeats))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    block = block_words or max(1, min(BLOCK_WORDS, words >> 16))
    quotas = seat_quotas(targets, block, shards).groupBy("source").agg(F.sum("quota").alias("__seats"))
    blocks = F.ceil(F.col("source_size") / block)
    facts = targets.join(quotas.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "source_size", "target", blocks.alias("__blocks"),
        F.when(blocks > 0, F.least(F.coalesce("__seats", F.lit(0)), repeats * blocks)).otherwise(0).cast("bigint").alias("__seats"),
    )
    facts = facts.withColumn("__rounds", F.when(F.col("__blocks") > 0, F.floor(F.col("__seats") / F.col("__blocks"))).otherwise(0)).withColumn("__more", F.col("__seats") - F.col("__rounds") * F.col("__blocks"))
    facts = settle(facts.withColumn("__name", F.coalesce("source", F.lit(""))).withColumn("__null", F.col("source").isNull()).drop("source", "__seats"))

    # Blocks beyond the full rounds: those that come first in the second seeded order.
    listed = _listed(facts.where(F.col("__blocks") > 0).select("__name", "__null", "__more", "__blocks"), ["__null", "__name"], F.col("__blocks"), "__piece")
    listed = listed.withColumn("__draw", F.xxhash64(F.lit(seed), "__null", "__name", "__piece"))
    drawn = number_rows(listed, ["__null", "__name"], [F.col("__draw"), F.col("__piece")], _bucket("__draw"), "__place")
    extra = drawn.where(F.col("__place") <= F.col("__more")).select("__null", "__name", "__piece", F.lit(True).alias("__extra"))

    named = sized.select("doc_id", F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__null"), "size").withColumn(
        "__order", F.xxhash64(F.lit(seed + 1), "__null", "__name", "doc_id", "size")
    )
    placed = running_total(named, ["__null", "__name"], [F.col("__order"), F.col("doc_id"), F.col("size")], _bucket("__order"), F.col("size"), "__end")
    placed = placed.withColumn("__start", F.col("__end") - F.col("size"))
    pieces = placed.where(F.col("size") > 0).withColumn("__piece", F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__end") - 1) / block))))
    low = F.greatest(F.col("__piece") * block - F.col("__start"), F.lit(0))
    high = F.least((F.col("__piece") + 1) * block - F.col("__start"), F.col("size"))
    chosen = pieces.hint("merge").join(extra, ["__null", "__name", "__piece"]).select("__null", "__name", "__start", low.alias("low"), high.alias("high"))
    chosen = chosen.groupBy("__null", "__name", "__start").agg(F.sum(F.col("high") - F.col("low")).alias("__drawn"), F.sort_array(F.collect_list(F.struct("low", "high"))).alias("__ranges"))
    # A document without words has the start of its neighbour, but is never drawn.
    met = placed.hint("merge").join(chosen, ["__null", "__name", "__start"], "left").join(facts, ["__null", "__name"])
    drawn_here = (F.col("size") > 0) & F.col("__drawn").isNotNull()
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high")))
    rounds = F.when(F.col("size") > 0, F.array_repeat(whole, F.col("__rounds").cast("int"))).otherwise(F.array())
    return met.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("__rounds") + F.when(drawn_here, F.col("__drawn")).otherwise(0)).cast("bigint").alias("taken"),
        F.concat(rounds, F.when(drawn_here, F.array("__ranges")).otherwise(F.array())).alias("copies"),
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The mix as documents: a row for each copy of a document, with the words that the copy holds.

    A copy of the whole text keeps it as it is; a part has its words one space apart. Rows without a key
    cannot be told apart and stay as they are; keys are expected once. Other columns are repeated.
    """
    taken = mix_sources(docs, key=key, text=text, **settings).select(F.col("doc_id").alias("__key"), "size", F.explode("copies").alias("__ranges")).where(F.col("__key").isNotNull())
    met = docs.join(taken, F.col(key) == F.col("__key"))

    def joined(words: Column) -> Column:
        return F.array_join(F.transform("__ranges", lambda r: F.array_join(F.slice(words, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")), " ")), " ")

    # The words are the variable of a lambda: in place of it the text would be cut anew for each range.
    parts = F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), joined)[0]
    whole = F.aggregate("__ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["high"] - r["low"]) == F.col("size")
    mixed = met.withColumn(text, F.when(whole, F.col(text)).otherwise(parts)).select(*docs.columns)
    return mixed.unionByName(docs.where(F.col(key).isNull()))
