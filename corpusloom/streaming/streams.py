"""Structured Streaming: learner mastery as keyed state, windowed activity, document ingestion, marker-free answer deltas.

Each registered query runs its stream over what is there (availableNow) and returns the table that the
stream keeps, so that it can be compared with the batch result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import learner, retrieval
from corpusloom.operators.text import chunks_of
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import shared_folder, table

catalogue = Catalogue()
query = catalogue.query

FILES_PER_BATCH = 64
WINDOW, LATENESS = "1 day", "1 hour"
_CARRY = 24
_MARKER = re.compile("|".join(retrieval.MARKS), re.IGNORECASE)


def stream_of(spark: SparkSession, folder: str, name: str, files: int = FILES_PER_BATCH) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern, since the stream source takes no single file by name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


def mastery_state(log: DataFrame) -> DataFrame:
    """Updates (user_id, mastery, attempts, correct) of log(user_id, ts, event_id, event_type): one fold step per answer.

    Answers of a batch are applied by time, batches in order of arrival; an answer that comes twice in one
    batch counts once. The state of a user is three numbers.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mastery, attempts, correct = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(parts)).drop_duplicates("event_id").sort_values(["ts", "event_id"])
        for right in (rows["event_type"] == "purchase").tolist():
            mastery = int((learner.QUIZ_ALPHA * right + (1 - learner.QUIZ_ALPHA) * mastery) * 10000 + 0.5) / 10000
            attempts, correct = attempts + 1, correct + int(right)
        state.update((mastery, attempts, correct))
        yield pd.DataFrame({"user_id": [key[0]], "mastery": [mastery], "attempts": [attempts], "correct": [correct]})

    answers = log.filter(F.col("event_type").isin("purchase", "error")).select("user_id", "ts", "event_id", "event_type")
    schema = "user_id long, mastery double, attempts long, correct long"
    return answers.groupBy("user_id").applyInPandasWithState(fold, schema, "mastery double, attempts long, correct long", "update", GroupStateTimeout.NoTimeout)


def kept(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run a stream over what is there, batch by batch; the checkpoint lies beside its table."""
    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table a stream wrote; without a batch it has no folder yet."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/table/batch=-1")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/table")


@query(learner.ORACLES["mastery_fold"])
def stream_mastery(spark: SparkSession, d: str) -> DataFrame:
    """The state after the last batch; equal to the batch fold."""
    folder = _folder(spark)
    kept(mastery_state(stream_of(spark, d, "events")), "update", lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}"), folder)
    out = _stored(spark, folder, "user_id long, mastery double, attempts long, correct long")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("mastery", "attempts", "correct"), "batch").alias("s"))
    return last.select("user_id", "s.*")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events and users per day and type; users are counted exactly, by one state row per day, type and user."""
    folder = _folder(spark)
    per_user = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS).groupBy(F.window("ts", WINDOW), "event_type", "user_id").agg(F.count(F.lit(1)).alias("events"))
    rows = per_user.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "user_id", "events")
    kept(rows, "update", lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}"), folder)
    out = _stored(spark, folder, "day timestamp_ntz, event_type string, user_id long, events long")
    last = out.groupBy("day", "event_type", "user_id").agg(F.max_by("events", "batch").alias("events"))
    return last.groupBy("day", "event_type").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("users"))


@query()
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks as they arrive; a batch that is repeated overwrites its own part."""
    folder = _folder(spark)
    arriving = stream_of(spark, d, "documents").select("doc_id", "text")
    kept(arriving, "append", lambda df, batch: chunks_of(df).write.mode("overwrite").parquet(f"{folder}/table/batch={batch}"), folder)
    out = _stored(spark, folder, "doc_id long, chunk int, content string")
    return out.select("doc_id", "chunk", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def without_markers(deltas: Iterator[str]) -> Iterator[str]:
    """An answer's pieces without citation marks, marks that two pieces share included; at most 24 characters wait."""
    held, seen = "", 0  # of what is held the first character may be known already: words are told apart by it
    for piece in deltas:
        held += piece
        cut = max(seen, len(held) - _CARRY)
        cut = min([cut, *(m.start() for m in _MARKER.finditer(held, seen) if m.start() < cut < m.end())])
        if out := _between(held, seen, cut):
            yield out
        held, seen = held[max(0, cut - 1) :], min(1, cut)
    if out := _between(held, seen, len(held)):
        yield out


def _between(text: str, start: int, stop: int) -> str:
    """Part of a text without the marks in it."""
    out = []
    for m in _MARKER.finditer(text, start):
        if m.end() <= stop:
            out.append(text[start : m.start()])
            start = m.end()
    return "".join(out) + text[start:stop]


@query(f"SELECT conv_id, md5(regexp_replace(string_agg(text, '' ORDER BY turn), '(?i){'|'.join(retrieval.MARKS)}', '', 'g')) AS text_md5 FROM conversations GROUP BY 1")
def delta_markers(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as streams of messages, without citation marks."""
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pieces"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "text": ["".join(without_markers(p or "" for p in x)) for x in pdf["pieces"]]})

    return m.mapInPandas(run, "conv_id long, text string").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
