"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and files of this session.

    It is the one the cluster names in `spark.checkpoint.dir`; a folder set on the context (as tests do) is
    taken as it is. Without either the call fails, as a folder of one machine would not outlive it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
            folder = f"{context._jvm.java.lang.System.getProperty('java.io.tmpdir')}/gridweave-checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows from 1 along a global order, without a task that holds all of them.

    Rows are dealt by ranges of the order and settled, so that the ranges stand; then they are counted
    per range, the counts are added up along the ranges (one row each), and rows are numbered inside
    their range. Meant for narrow rows. Rows that are equal in `order` are numbered in any order.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__inside", inside).join(offsets, "__range").select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))
