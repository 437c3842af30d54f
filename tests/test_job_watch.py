"""Jobs to resume from a stream with timers, against the batch operator on the same log."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridweave.operators import sets as A
from gridweave.streaming import jobs

SCHEMA = "job_id string, status string, time timestamp, rank bigint"
HOUR = 3600 * 1000


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def run(spark, make, tmp_path, batches):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    seen = []
    for rows in batches:
        make(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.watch_into(stream, log, str(tmp_path / "cp"), HOUR, "0 seconds").awaitTermination()
        seen.append({(r["job_id"], r["state"]) for r in jobs.jobs_to_resume(spark.read.schema(jobs.WATCH_LOG).parquet(log)).collect()})
    return seen, spark.read.schema(jobs.WATCH_LOG).parquet(log)


def test_timers_fire_while_the_stream_runs_and_heartbeats_move_them(spark, make, tmp_path):
    first = [("q", "queued", at(0), 1), ("a", "running", at(0), 2), ("b", "running", at(0), 3), ("b", "running", at(30), 4), ("d", "done", at(1), 5), (None, "queued", at(1), 6), ("n", "queued", None, 7)]
    second = [("b", "running", at(85), 8), ("x", "running", at(70), 9), ("x", "running", at(70), 10)]
    third = [("q", "running", at(100), 11), ("a", "done", at(110), 12), ("late", "queued", at(5), 13), ("x", "running", at(131), 14)]
    seen, log = run(spark, make, tmp_path, [first, second, third])
    assert seen[0] == {("q", "queued")}
    assert seen[1] == {("q", "queued"), ("a", "overdue")}  # the newest time is minute 85, b's timer has moved with it
    assert seen[2] == set()  # q runs again, a is done; the row of minute 5 was late
    assert {(r["job_id"], r["state"]) for r in log.collect()} == {("q", "queued"), ("a", "overdue"), ("q", "active"), ("a", "active")}


def test_one_pass_equals_the_batch_operator(spark, make, tmp_path):
    kinds = ["queued", "running", "running", "done"]
    rows = [(f"j{(i * 7) % 60}", kinds[(i * 13 + i // 9) % 4], at((i * 37) % 500), i) for i in range(600)] + [("hot", "running", at(i % 400), 1000 + i) for i in range(3000)]
    seen, _ = run(spark, make, tmp_path, [rows])
    df = make(rows, SCHEMA).groupBy("job_id").agg(F.max_by(F.struct("status", "time"), F.struct("time", "rank")).alias("r"))
    last = df.select("job_id", "r.status", F.col("r.time").alias("heartbeat"))
    end = max(r[2] for r in rows)
    want = {r["job_id"] for r in A.resumable(last, F.lit(end).cast("timestamp") - F.expr("INTERVAL 1 HOUR")).collect()}
    assert {j for j, _ in seen[0]} == want and "hot" in want and len(want) > 5


def test_an_empty_stream_gives_nothing(spark, make, tmp_path):
    seen, log = run(spark, make, tmp_path, [[]])
    assert seen == [set()] and log.count() == 0
