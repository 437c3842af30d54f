"""Streams: document upsert into snapshot tables, running topic counts, runs that went stale, jobs to resume."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridweave.functions import scalars as S
from gridweave.operators.sets import upsert
from gridweave.operators.texts import with_segments
from gridweave.rules.sets import RuleSet


def upsert_stream(incoming: DataFrame, snapshots: str, checkpoint: str, keys: Sequence[str], order: str) -> StreamingQuery:
    """Keep the newest row per key in `snapshots`, one folder per micro-batch (`v<batch>`).

    Each batch is merged with the last complete snapshot by the batch operator and written as a new
    folder, so a batch that runs again overwrites only its own folder and gives the same result. The
    caller reads the folder named in the newest `_SUCCESS`.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [f for f in batch.schema.fields if f.name != "position"]
        if batch_id == 0:
            before = spark.createDataFrame([], batch.schema)
        else:
            before = spark.read.parquet(f"{snapshots}/v{batch_id - 1}")
        merged = upsert(before.select(*[f.name for f in columns]), batch, keys, order)
        merged.write.mode("overwrite").parquet(f"{snapshots}/v{batch_id}")

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- a snapshot in buckets --------------------------------------------------------------------


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose list of buckets is complete, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/buckets")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    done = [n for n in names if re.fullmatch("v[0-9]+", n) and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/buckets/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def _bucket_list(spark: SparkSession, root: str, version: int | None) -> dict[int, int]:
    """The version in which each bucket was written last: one entry per bucket at most."""
    return {} if version is None else {r["bucket"]: r["version"] for r in spark.read.parquet(f"{root}/buckets/v{version}").collect()}


def merge_buckets(batch: DataFrame, version: int, root: str, keys: Sequence[str], order: str, buckets: int = 64) -> None:
    """Merge a batch into a snapshot in buckets of the keys: only buckets with a key of the batch are read and written.

    The newest row of a key by `order` wins; `position` keeps the order of its first row. Rows go to
    `data/v<version>`, then the list of buckets is written to `buckets/v<version>`; its completion commits the
    version. A version that is merged again starts from the one before it and gives the same result. Null keys
    count as empty text. The number of buckets of a snapshot stays as it began.
    """
    spark = batch.sparkSession
    earlier = [v for v in _versions(spark, root) if v < version]
    known = _bucket_list(spark, root, earlier[-1] if earlier else None)
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    columns = [c for c in batch.columns if c != "position"]
    bucket = F.pmod(F.xxhash64(*filled), F.lit(buckets)).cast("int")
    arrived = batch.select(*columns, F.col(order).alias("position")).persist()
    try:
        touched = sorted(r[0] for r in arrived.select(bucket.alias("bucket")).distinct().collect())
        if not touched:
            return
        old = [f"{root}/data/v{known[b]}/bucket={b}" for b in touched if b in known]
        both = arrived.unionByName(spark.read.schema(arrived.schema).parquet(*old)) if old else arrived
        named = [f.alias(f"__{k}") for f, k in zip(filled, keys, strict=True)]
        newest = both.groupBy(*named).agg(F.max_by(F.struct(*columns), order).alias("__row"), F.min("position").alias("position")).select("__row.*", "position")
        newest.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/data/v{version}")
    finally:
        arrived.unpersist()
    listed = {**known, **dict.fromkeys(touched, version)}
    spark.createDataFrame(sorted(listed.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/buckets/v{version}")


def read_buckets(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest committed snapshot, or that of a version."""
    versions = _versions(spark, root)
    if not versions:
        raise ValueError("the snapshot has no committed version")
    listed = _bucket_list(spark, root, versions[-1] if version is None else version)
    return spark.read.parquet(*[f"{root}/data/v{v}/bucket={b}" for b, v in sorted(listed.items())])


def upsert_buckets(incoming: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Keep the newest row per key of a stream in a snapshot in buckets (see `merge_buckets`)."""
    merge = lambda batch, version: merge_buckets(batch, version, root, keys, order, buckets)
    return incoming.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- exact running coverage -------------------------------------------------------------------


def document_topics(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """Running number of segments per company, topic and document. The state is one number per such row, spread over all tasks."""
    segments = with_segments(documents).select("company", "doc_id", F.explode_outer("segments").alias("text")).where("text IS NOT NULL")
    topics = S.labels_found("lower(text)", {t.topic: t.keywords for t in rules.topics})
    hits = segments.select("company", "doc_id", F.explode_outer(topics).alias("topic")).where("topic IS NOT NULL")
    return hits.groupBy("company", "topic", "doc_id").agg(F.count(F.lit(1)).alias("evidence"))


def coverage_stream(documents: DataFrame, rules: RuleSet, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the counts of `document_topics` in a snapshot in buckets; a batch rewrites the buckets of its documents only."""
    return upsert_buckets(document_topics(documents, rules), root, checkpoint, ["company", "topic", "doc_id"], "evidence", buckets)


def running_coverage(counts: DataFrame) -> DataFrame:
    """Exact documents and segments per company and topic from the counts per document: a document that came in several batches counts once."""
    return counts.groupBy("company", "topic").agg(F.sum("evidence").alias("evidence"), F.count(F.lit(1)).alias("documents"))


def topic_counts(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """Running number of segments and (approximate) documents per company and topic, for update or complete mode.

    The segment and keyword steps are stateless; the state is one row per company and topic.
    """
    segments = with_segments(documents).select("company", "doc_id", F.explode_outer("segments").alias("text")).where("text IS NOT NULL")
    topics = S.labels_found("lower(text)", {t.topic: t.keywords for t in rules.topics})
    hits = segments.select("company", "doc_id", F.explode_outer(topics).alias("topic")).where("topic IS NOT NULL")
    return hits.groupBy("company", "topic").agg(F.count(F.lit(1)).alias("evidence"), F.approx_count_distinct("doc_id").alias("documents"))


def stale_sessions(events: DataFrame, key: str, time: str, timeout: str, lateness: str) -> DataFrame:
    """Runs of events per key that ended: no event for `timeout`. Events later than `lateness` are dropped.

    In append mode a run comes out once the watermark has passed its end; that is when its key is stale.
    """
    watched = events.withWatermark(time, lateness)
    return watched.groupBy(F.col(key), F.session_window(F.col(time), timeout).alias("run")).agg(
        F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("events")
    ).select(key, F.col("run.start").alias("run_start"), F.col("run.end").alias("run_end"), "last_seen", "events")


# --- jobs to resume, by timers ----------------------------------------------------------------

WATCH_STATE = "status string, seen bigint, rank bigint, shown string"
WATCH_LOG = "job_id string, state string, seen bigint, rank bigint"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`; without that setting only a local master has one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        base = context._jvm.java.lang.System.getProperty("java.io.tmpdir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["seen", "rank"], kind="stable").drop_duplicates("job_id", keep="last")


def _newest_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest row per job of each Arrow batch, so that a job with very many heartbeats sends one row per batch."""
    for frame in frames:
        yield _newest(frame)


def _watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    """One job: its newest status and heartbeat are the state; what changes about it goes to the log."""
    status, seen, rank, shown = state.get if state.exists else (None, None, None, "active")
    if not state.hasTimedOut:
        for frame in frames:
            last = _newest(frame).iloc[0]
            if seen is None or (last["seen"], last["rank"]) >= (seen, rank):
                status, seen, rank = last["status"], int(last["seen"]), int(last["rank"])
    now, due = state.getCurrentWatermarkMs(), seen // 1000 + timeout_ms
    running = status == "running"
    verdict = "queued" if status == "queued" else "overdue" if running and (state.hasTimedOut or due < now) else "active"
    state.update((status, seen, rank, verdict))
    if running and verdict == "active":
        state.setTimeoutTimestamp(max(due, now + 1))
    if verdict != shown:
        yield pd.DataFrame({"job_id": [key[0]], "state": [verdict], "seen": [seen], "rank": [rank]})


def watch_jobs(events: DataFrame, timeout_ms: int, lateness: str) -> DataFrame:
    """A log of jobs that become `queued`, `overdue` (running, and no heartbeat for the timeout) or `active` again, while the stream runs.

    `events`: job_id, status, time (timestamp), rank (a number that orders rows of one time). The newest row of
    a job counts. Each running job has an event-time timer at its last heartbeat plus the timeout, and a
    heartbeat moves it; it fires when the watermark (newest time less `lateness`) has passed it, so a job is overdue
    by the clock of the data. Rows older than the watermark are late and are left out by Spark. Rows without a job
    or a time are no heartbeat of anything and are left out. The state is one row per job. Log: job_id (text), state,
    seen (microseconds), rank.
    """
    named = events.where("job_id IS NOT NULL AND time IS NOT NULL").select(
        F.col("job_id").cast("string").alias("job_id"), F.coalesce("status", F.lit("")).alias("status"),
        F.unix_micros(F.col("time").cast("timestamp")).alias("seen"), F.coalesce(F.col("rank"), F.lit(0)).cast("bigint").alias("rank"),
    )
    newest = named.mapInPandas(_newest_of_task, named.schema)
    timed = newest.withColumn("time", F.timestamp_micros("seen")).withWatermark("time", lateness)
    return timed.groupBy("job_id").applyInPandasWithState(
        partial(_watch, timeout_ms=timeout_ms), WATCH_LOG, WATCH_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def jobs_to_resume(log: DataFrame) -> DataFrame:
    """job_id, state and seen of the jobs whose last entry in the log of `watch_jobs` is queued or overdue."""
    order = F.struct("seen", "rank", (F.col("state") == "overdue").cast("int"))
    last = log.groupBy("job_id").agg(F.max_by(F.struct("state", "seen"), order).alias("last")).select("job_id", "last.*")
    return last.where("state <> 'active'").select("job_id", "state", F.timestamp_micros("seen").cast("timestamp_ntz").alias("seen"))


def watch_into(events: DataFrame, path: str, checkpoint: str, timeout_ms: int, lateness: str) -> StreamingQuery:
    """Append the log of `watch_jobs` to Parquet files; every row goes out once."""
    log = watch_jobs(events, timeout_ms, lateness)
    return log.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
