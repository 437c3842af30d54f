"""Set queries over events: newest per key, stale keys, runs to resume, and the latter from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import sets as A
from gridweave.plans.catalog import Catalog, table
from gridweave.streaming import jobs as J


def register(catalog: Catalog) -> None:
    @catalog.add(
        """WITH e AS (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(CASE WHEN user_id % 10 <> 0 THEN user_id END AS VARCHAR), ''), event_type ORDER BY event_id DESC) AS n,
             min(event_id) OVER (PARTITION BY coalesce(CAST(CASE WHEN user_id % 10 <> 0 THEN user_id END AS VARCHAR), ''), event_type) AS position FROM events)
        SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_type, value, position FROM e WHERE n = 1"""
    )
    def latest_per_key(spark, folder):
        """Newest event per user and type in the place of the first one; some users have no id."""
        events = table(spark, folder, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
        return A.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")

    @catalog.add("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 18:00:00'")
    def stale_keys(spark, folder):
        """Users without an event since a cutoff."""
        return A.stale_keys(table(spark, folder, "events"), "user_id", "ts", F.lit("2024-01-30 18:00:00").cast("timestamp"))

    @catalog.add(
        """SELECT DISTINCT user_id AS job_id FROM events WHERE event_type = 'view' OR (event_type = 'click' AND (event_id % 9 = 0 OR ts < TIMESTAMP '2024-01-02 00:00:00'))"""
    )
    def stale_union(spark, folder):
        """Jobs to resume: queued ones, and running ones with an old heartbeat or none."""
        kind = F.col("event_type")
        jobs = table(spark, folder, "events").select(
            F.col("user_id").alias("job_id"), F.when(kind == "view", "queued").when(kind == "click", "running").otherwise("done").alias("status"),
            F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("heartbeat"),
        )
        return A.resumable(jobs, F.lit("2024-01-02 00:00:00").cast("timestamp"))

    @catalog.add(
        """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES AS mark FROM e)
        SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'view' THEN 'queued' ELSE 'overdue' END AS state, ts AS seen FROM e, w
        WHERE n = 1 AND (event_type = 'view' OR (event_type = 'click' AND date_trunc('milliseconds', ts) + INTERVAL 6 HOURS < mark))"""
    )
    def resume_watch(spark, folder):
        """Jobs to resume from a stream of events: queued ones, and running ones whose timer fired; all events there are, then the end."""
        path = f"{folder}/events.parquet"
        kind = F.col("event_type")
        # A stream takes a single file only by a pattern; this one fits a file and a folder of that name.
        events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/event[s].parquet")
        named = events.select(
            F.col("user_id").alias("job_id"), F.when(kind == "view", "queued").when(kind == "click", "running").otherwise("done").alias("status"),
            F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("rank"),
        )
        root = J.work_folder(spark, "resume-watch")
        J.watch_into(named, f"{root}/log", f"{root}/checkpoint", 6 * 3600 * 1000, "10 minutes").awaitTermination()
        return J.jobs_to_resume(spark.read.schema(J.WATCH_LOG).parquet(f"{root}/log"))
