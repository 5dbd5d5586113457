"""Ingestion with a status for every document: processing, ready or error, tries that are bounded, dead letters.

Each micro-batch takes new documents and those whose last try failed. A batch that is repeated after a failure overwrites its own
parts. One bad document fails alone; after its last try it is a dead letter with the error's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.text import split_text
from corpusloom.plans.catalogue import Catalogue
from corpusloom.streaming.streams import _folder, kept, stream_of

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

TRIES, ERROR_CHARS = 3, 800
RESULT = "doc_id long, text string, attempt int, status string, error string, chunks array<string>"
RETRY = "doc_id long, text string, attempt int"


def chunks_or_error(text: str | None, attempt: int) -> list[str]:
    """A document's chunks; one without any is an error."""
    pieces = split_text(text or "")
    if not pieces:
        raise ValueError("no text to index")
    return pieces


def tried(due: DataFrame, cut: Callable[[str | None, int], list[str]]) -> DataFrame:
    """due(doc_id, text, attempt) with what came of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, attempt in zip(pdf["doc_id"], pdf["text"], pdf["attempt"], strict=True):
                try:
                    rows.append((doc_id, None, attempt, "ready", None, cut(text, int(attempt))))
                except Exception as e:  # one bad document must not stop the others
                    rows.append((doc_id, text, attempt, "error", str(e)[:ERROR_CHARS], []))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return due.select("doc_id", "text", "attempt").mapInPandas(run, RESULT)


def ingested(stream: DataFrame, folder: str, cut: Callable[[str | None, int], list[str]] = chunks_or_error, tries: int = TRIES) -> None:
    """Run a stream of (doc_id, text) over what is there, retries included; `statuses` and `chunks` read the outcome."""
    spark = stream.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    none(RESULT).write.mode("overwrite").parquet(f"{folder}/done/part=none")
    none(RETRY).write.mode("ignore").parquet(f"{folder}/retry/part=none")
    last = {"part": "none"}

    def step(due: DataFrame, part: str, waiting: str) -> None:
        retry = spark.read.schema(RETRY).parquet(f"{folder}/retry/part={waiting}")
        tried(due.withColumn("attempt", F.lit(1)).unionByName(retry), cut).write.mode("overwrite").parquet(f"{folder}/done/part={part}")
        failed = spark.read.schema(RESULT).parquet(f"{folder}/done/part={part}").filter((F.col("status") == "error") & (F.col("attempt") < tries))
        failed.select("doc_id", "text", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(f"{folder}/retry/part={part}")
        last["part"] = part

    def batch(df: DataFrame, n: int) -> None:
        step(df, f"b{n}", f"b{n - 1}" if n else "none")

    kept(stream.select("doc_id", "text"), "append", batch, folder)
    # what still waits has its remaining tries now; then nothing waits, whether or not the stream goes on later
    end = last["part"]
    for i in range(1, tries):
        step(none("doc_id long, text string"), f"{end}r{i}", last["part"])
    none(RETRY).write.mode("overwrite").parquet(f"{folder}/retry/part={end}")


def _done(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{RESULT}, part string").parquet(f"{folder}/done")


def statuses(spark: SparkSession, folder: str, tries: int = TRIES) -> DataFrame:
    """(doc_id, status, attempts, error): a failed document is processing while it has tries left."""
    best = _done(spark, folder).groupBy("doc_id").agg(F.max(F.struct("attempt", "status", "error")).alias("s"))
    waits = (F.col("s.status") == "error") & (F.col("s.attempt") < tries)
    return best.select("doc_id", F.when(waits, "processing").otherwise(F.col("s.status")).alias("status"), F.col("s.attempt").alias("attempts"), F.col("s.error").alias("error"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk, content) of ready documents, chunks numbered from 1."""
    rows = _done(spark, folder).filter("status = 'ready'").select("doc_id", F.posexplode("chunks").alias("chunk", "content"))
    return rows.withColumn("chunk", F.col("chunk") + 1)


def dead_letters(spark: SparkSession, folder: str, tries: int = TRIES) -> DataFrame:
    return statuses(spark, folder, tries).filter("status = 'error'")


@query(r"""SELECT doc_id, CASE WHEN ok THEN 'ready' ELSE 'error' END AS status, CASE WHEN ok THEN 1 ELSE 3 END AS attempts, CASE WHEN NOT ok THEN 'no text to index' END AS error
FROM (SELECT doc_id, regexp_matches(coalesce(text, ''), '\S') AS ok FROM documents)""")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of every document that arrived."""
    folder = _folder(spark)
    ingested(stream_of(spark, d, "documents"), folder)
    return statuses(spark, folder)
