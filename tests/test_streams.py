"""Streams against their batch forms: snapshots in buckets, exact running coverage; long texts in linear time."""

import os
import time

from pyspark.sql import functions as F

from gridweave.functions import segmentation as G
from gridweave.operators import coverage as C
from gridweave.operators import sets as A
from gridweave.operators import texts as T
from gridweave.rules.sets import default_rules
from gridweave.streaming import jobs


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


SCHEMA = "name string, source string, seq int, body string"


def batches():
    first = [(f"n{i}", "s", i, "old") for i in range(200)] + [(None, "s", 200, "null key")]
    second = [(f"n{i}", "s", 300 + i, "new") for i in range(0, 200, 3)] + [("fresh", None, 600, "x"), ("", "s", 601, "null key again")]
    third = [("n5", "s", 700, "newest")]
    return first, second, third


def test_three_batches_equal_the_batch_operator(spark, make, tmp_path):
    root, every = str(tmp_path / "snap"), []
    for version, rows in enumerate(batches()):
        jobs.merge_buckets(make(rows, SCHEMA), version, root, ["name", "source"], "seq", buckets=8)
        every += rows
        want = A.upsert(make([], SCHEMA), make(every, SCHEMA), ["name", "source"], "seq")
        columns = ["name", "source", "seq", "body", "position"]
        assert rows_of(jobs.read_buckets(spark, root), *columns) == rows_of(want, *columns)
    assert len([n for n in os.listdir(f"{root}/data/v2") if n.startswith("bucket=")]) == 1  # one key, one bucket
    before = rows_of(jobs.read_buckets(spark, root), "name", "seq", "body", "position")
    jobs.merge_buckets(make(batches()[2], SCHEMA), 2, root, ["name", "source"], "seq", buckets=8)
    assert rows_of(jobs.read_buckets(spark, root), "name", "seq", "body", "position") == before
    assert ("n5", 5, "old") in rows_of(jobs.read_buckets(spark, root, 0), "name", "seq", "body")


def test_a_version_without_a_complete_list_is_not_there(spark, make, tmp_path):
    root = str(tmp_path / "snap")
    jobs.merge_buckets(make(batches()[0], SCHEMA), 0, root, ["name", "source"], "seq", buckets=4)
    jobs.merge_buckets(make(batches()[1], SCHEMA), 1, root, ["name", "source"], "seq", buckets=4)
    os.remove(f"{root}/buckets/v1/_SUCCESS")
    assert {r["body"] for r in jobs.read_buckets(spark, root).collect()} == {"old", "null key"}
    jobs.merge_buckets(make([], SCHEMA), 2, root, ["name", "source"], "seq", buckets=4)  # an empty batch writes nothing
    assert jobs._versions(spark, root) == [0]


def test_running_coverage_is_exact(spark, make, tmp_path):
    rules, folder = default_rules(), str(tmp_path / "in")
    words = [t.keywords[0] for t in rules.topics]
    docs = [(i % 40, f"{words[i % len(words)]} one.\n\n{words[(i * 7) % len(words)]} two.", f"c{i % 3}") for i in range(120)]  # each document comes three times
    frame = make(docs, "doc_id int, text string, company string")
    for part in range(3):
        make(docs[part * 40 : part * 40 + 40], "doc_id int, text string, company string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.coverage_stream(stream, rules, str(tmp_path / "snap"), str(tmp_path / "cp"), buckets=4).awaitTermination(300)
    found = jobs.running_coverage(jobs.read_buckets(spark, str(tmp_path / "snap")))
    segs = T.explode_segments(T.with_segments(frame), ["company", "doc_id"]).select("*", F.col("doc_id").alias("doc_idx"), F.lit("n").alias("doc_name"))
    assert rows_of(found, "company", "topic", "evidence", "documents") == rows_of(C.topic_coverage(segs, rules), "company", "topic", "evidence", "documents")


def packed(parts, limit):
    done, open_, size = [], None, 0
    for p in parts:
        if open_ is not None and size + len(p) + 1 > limit:
            done.append(open_)
            open_, size = p, len(p)
        else:
            size += len(p) + 1
            open_ = p if open_ is None else f"{open_} {p}"
    return done + ([open_] if open_ is not None else [])


def test_packing_and_sections_grow_with_the_text(spark, make):
    for n in (0, 1, 511, 512, 513, 1300):
        parts = [f"s{i % 37}" * (i % 5 + 1) for i in range(n)]
        df = make([(parts,)], "p array<string>")
        assert df.select(G.pack_sentences(F.col("p"), 40).alias("c")).first()["c"] == packed(parts, 40)
    parts = [f"sentence number {i}." for i in range(200_000)]
    text = "\n".join(f"Heading {i}" if i % 9 == 4 else f"line {i}, with a mark." for i in range(200_000))
    began = time.time()
    chunks = make([(" ".join(parts),)], "t string").select(F.expr("split(t, '(?<=\\\\.) ')").alias("p")).select(F.size(G.pack_sentences(F.col("p"), 900)).alias("n")).first()["n"]
    assert chunks == len(packed(parts, 900))
    lines = T.line_sections(make([("d", text), ("e", ""), ("f", None)], "id string, text string"), "id")
    assert lines.groupBy().agg(F.count("line"), F.count("section"), F.count_distinct("section")).first() == (200_000, 199_996, 22_222)
    assert time.time() - began < 90
