"""Ways to attach, number and look up at scale, used by the other operators.

A plain window or join by a business key puts the whole group of a hot key into one task. The three
functions here give the same result with bounded tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key facts (one row per key) to rows.

    A plain equi-join: the facts of a key are one row, so a hot key is skewed on the side of the rows only,
    and AQE splits such a partition by its measured size. Small facts become a broadcast at run time.
    """
    return rows.join(facts, list(keys), how)


def _checkpoint_folder(df: DataFrame) -> str:
    """The folder of `spark.checkpoint.dir`, or the one that is set on the context.

    Without either a cluster gets an error, as a folder of one machine would not outlive it; a local session
    takes its temporary folder.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        context.setCheckpointDir(folder or f"{context._jvm.java.lang.System.getProperty('java.io.tmpdir')}/gridweave-checkpoints")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write narrow rows that several later steps read, with a reliable checkpoint in `spark.checkpoint.dir`."""
    _checkpoint_folder(df)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write rows that several later steps read in part: by column and compressed, in the same folder as checkpoints.

    Meant for rows that are aggregated or ranked afterwards; as they are compressed, the planner takes them for few.
    """
    folder = f"{_checkpoint_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], block: Column, value: Column, name: str
) -> DataFrame:
    """`sum(value) over (partition by group order by order)` with bounded tasks.

    `block` cuts the order into consecutive pieces: it must not decrease along `order`. Values are
    summed per block, the block sums are summed along the blocks (few rows), and the running sum is
    taken inside each block. A group of any size is spread over its blocks.
    """
    blocked = df.select("*", block.alias("__block"), value.cast("bigint").alias("__value"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*group, "__block")
        .agg(F.sum("__value").alias("__sum"))
        .select(*group, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The rows are dealt and sorted by the join keys already; the hint keeps them from being broadcast where
    # their number is underestimated (rows unnested from a few).
    return (
        blocked.withColumn("__inside", F.sum("__value").over(inside))
        .hint("merge")
        .join(offsets, [*group, "__block"])
        .select(*df.columns, (F.col("__offset") + F.col("__inside")).alias(name))
    )


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], block: Column, name: str) -> DataFrame:
    """`row_number() over (partition by group order by order)` with bounded tasks."""
    return running_total(df, group, order, block, F.lit(1), name)


def row_block(order: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """Block for `number_rows` from an integer order column."""
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(rows))


def find_tokens(
    texts: DataFrame,
    text: str,
    vocabulary: DataFrame,
    token: str,
    keys: Sequence[str] = (),
    min_length: int = 2,
    max_length: int = 24,
) -> DataFrame:
    """Which tokens of a large vocabulary occur in which text, as an equi-join on exact substrings.

    Every position of a text gives its substrings of `min_length` to `max_length` characters; tokens
    join on the whole token, longer tokens on their first `max_length` characters followed by a
    `contains` check. No pair is built that does not match (but for the check of long tokens), so
    tokens with a common beginning cost nothing. Texts are meant to be short (labels, headers).
    Result: all columns of `texts` and of `vocabulary`, one row per text and token.
    """
    size = F.length(text)
    pieces = F.flatten(
        F.transform(
            F.when(size >= min_length, F.sequence(F.lit(1), size - (min_length - 1))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.transform(
                F.sequence(F.lit(min_length), F.least(F.lit(max_length), size - i + 1)),
                lambda n: F.substring(F.col(text), i, n),
            ),
        )
    )
    exploded = texts.withColumn("__piece", F.explode_outer(F.array_distinct(pieces)))
    keyed = vocabulary.where(F.length(token) >= min_length).withColumn("__piece", F.substring(token, 1, max_length))
    return (
        exploded.join(keyed, [*keys, "__piece"])
        .where((F.length(token) <= max_length) | F.contains(F.col(text), F.col(token)))
        .drop("__piece")
    )


def find_keywords(
    texts: DataFrame, text: str, vocabulary: DataFrame, keyword: str, key: str, carried: int = 64
) -> DataFrame:
    """Occurrences of a keyword table of any size in long texts, without a nested loop over it.

    Each keyword joins on its first three characters (or on itself if shorter) with the positions of
    the text that start so, and is verified there. Only `carried` characters per position travel along, not
    the text; places of a longer keyword that agree so far are verified in the text, joined by its key.
    `hits` counts
    occurrences that do not overlap, as a left-to-right search does.
    """
    lowered = F.lower(F.col(text))
    positions = F.sequence(F.lit(1), F.greatest(F.length("__text"), F.lit(1)))
    windows = texts.select(key, lowered.alias("__text")).select(
        key,
        F.posexplode_outer(F.transform(positions, lambda i: F.substring(F.col("__text"), i, F.lit(carried)))).alias(
            "__at", "__window"
        ),
    )
    grams = windows.select(
        key, "__at", "__window",
        F.explode_outer(F.array_distinct(F.array(*[F.substring("__window", 1, n) for n in (1, 2, 3)]))).alias("__gram"),
    )
    words = vocabulary.withColumn("__gram", F.substring(F.lower(F.col(keyword)), 1, 3))
    size = F.length(keyword)

    def next_hit(acc: Column, at: Column) -> Column:
        free = at >= acc["free"]
        return F.struct(
            (acc["hits"] + free.cast("int")).alias("hits"), F.when(free, at + acc["size"]).otherwise(acc["free"]).alias("free"),
            acc["size"].alias("size"),
        )

    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("free"), F.col("__size").alias("size"))
    # Rows unnested from a few are underestimated; the hint keeps them from being broadcast.
    begun = grams.hint("merge").join(words, "__gram").where(F.startswith(F.col("__window"), F.substring(F.lower(F.col(keyword)), 1, carried)))
    whole = texts.select(F.col(key).alias("__key"), lowered.alias("__text"))
    # Only places of long keywords meet the text; the others pass through, so positions are unnested once.
    placed = begun.join(whole, (F.col(key) == F.col("__key")) & (size > carried), "left")
    verified = (size <= carried) | (F.substring(F.col("__text"), F.col("__at") + 1, size) == F.lower(F.col(keyword)))
    return (
        placed.where(verified)
        .groupBy(key, *vocabulary.columns)
        .agg(F.sort_array(F.collect_list("__at")).alias("__all"), F.max(size).alias("__size"))
        .select(key, *vocabulary.columns, F.aggregate("__all", start, next_hit, lambda acc: acc["hits"]).alias("hits"))
    )
