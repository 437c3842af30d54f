"""Set operations on job logs and documents: newest per key, runs to resume, stale keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing rows with newer rows of the same key put in their place; other new rows are appended.

    NULL keys count as empty text. `order` grows with arrival; `position` is that of the first row of a
    key. One aggregation by key with map-side combine: the newest row wins, the first place is kept.
    """
    columns = [c for c in existing.columns if c != "position"]
    both = existing.select(*columns).unionByName(incoming.select(*columns))
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{k}") for k in keys]
    newest = both.groupBy(*filled).agg(F.max_by(F.struct(*columns), order).alias("__row"), F.min(order).alias("position"))
    return newest.select("__row.*", "position")


def resumable(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Ids of queued jobs and of running jobs without a heartbeat since the cutoff, once each."""
    waiting = jobs.where("status = 'queued'").select("job_id")
    stale = jobs.where((F.col("status") == "running") & (F.col("heartbeat").isNull() | (F.col("heartbeat") < cutoff))).select("job_id")
    return waiting.union(stale).distinct()


def stale_keys(events: DataFrame, key: str, time: str, cutoff: Column) -> DataFrame:
    """Keys whose last event is older than the cutoff."""
    return events.groupBy(key).agg(F.max(time).alias("last_seen")).where(F.col("last_seen") < cutoff)
