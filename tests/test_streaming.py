"""Streams equal batch results over several batches."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import learner, text
from corpusloom.streaming import ingest, streams


def test_mastery_over_many_batches(spark, tmp_path):
    """Files in order of time, one per batch: the last state equals the batch fold."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    by_time = events.select("*", F.ntile(3).over(Window.orderBy("ts", "event_id")).alias("part"))
    for i in (1, 2, 3):
        by_time.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path / "out")
    seen = []

    def write(df, batch):
        seen.append(batch)
        df.write.parquet(f"{folder}/table/batch={batch}")

    streams.kept(streams.mastery_state(streams.stream_of(spark, str(tmp_path), "events", 1)), "update", write, folder)
    assert len(seen) >= 3
    out = spark.read.parquet(f"{folder}/table").groupBy("user_id").agg(F.max_by(F.struct("mastery", "attempts", "correct"), "batch").alias("s")).select("user_id", "s.*")
    want = learner.quiz_mastery(spark, SF_SMALL)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select("user_id", "mastery", "attempts", "correct").collect()))


def test_ingest_equals_batch(spark):
    a = {tuple(r) for r in streams.stream_ingest(spark, SF_SMALL).collect()}
    b = {tuple(r) for r in text.chunks(spark, SF_SMALL).select("doc_id", "chunk", "content_md5").collect()}
    assert a == b


def test_markers():
    assert "".join(streams.without_markers(iter(["a [1", "2] b", "[", "3][4]", " [x] [", "5"]))) == "a  b [x] [5"


def test_status_and_retries(spark, tmp_path):
    """A document that fails once is ready at its second try, one that always fails becomes a dead letter; two files make two batches."""
    docs = [(1, "good"), (2, "flaky"), (3, "bad" * 400), (4, ""), (5, None), (6, "late")]
    for part in (docs[:4], docs[4:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))

    def cut(text, attempt):
        if text and text.startswith("bad"):
            raise ValueError(text)
        if text == "flaky" and attempt == 1:
            raise ValueError("not yet")
        return ingest.chunks_or_error(text, attempt)

    folder = str(tmp_path / "out")
    ingest.ingested(streams.stream_of(spark, str(tmp_path), "documents", 1), folder, cut)
    got = {r["doc_id"]: (r["status"], r["attempts"], r["error"]) for r in ingest.statuses(spark, folder).collect()}
    assert got == {1: ("ready", 1, None), 2: ("ready", 2, None), 3: ("error", 3, ("bad" * 400)[:800]), 4: ("error", 3, "no text to index"), 5: ("error", 3, "no text to index"), 6: ("ready", 1, None)}
    assert sorted((r["doc_id"], r["chunk"], r["content"]) for r in ingest.chunks(spark, folder).collect()) == [(1, 1, "good"), (2, 1, "flaky"), (6, 1, "late")]
    assert {r["doc_id"] for r in ingest.dead_letters(spark, folder).collect()} == {3, 4, 5}
    # the stream goes on: a new file, nothing is tried again
    spark.createDataFrame([(7, "new")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    ingest.ingested(streams.stream_of(spark, str(tmp_path), "documents", 1), folder, cut)
    again = {r["doc_id"]: (r["status"], r["attempts"], r["error"]) for r in ingest.statuses(spark, folder).collect()}
    assert again == got | {7: ("ready", 1, None)}


def test_failed_documents_wait(spark, tmp_path):
    """Between batches a failed document with tries left is processing."""
    due = spark.createDataFrame([(1, "", 1), (2, "", 3), (3, "x", 2)], "doc_id long, text string, attempt int")
    ingest.tried(due, ingest.chunks_or_error).write.parquet(str(tmp_path / "done" / "part=b0"))
    assert sorted((r["doc_id"], r["status"]) for r in ingest.statuses(spark, str(tmp_path)).collect()) == [(1, "processing"), (2, "error"), (3, "ready")]
