"""The corpus pipeline: five stages over `documents`, each on all that the one before it kept.

quality rules -> line dedup -> n-gram Jaccard join -> secret scan -> best-fit packing. All stages but the
last return the columns of documents; the last returns the pieces of all remaining documents with their
places in sequences. A document that loses every line to others' copies goes with its last line; texts
that a stage changes get their n_chars anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, jaccard, lines, packing, quality, secrets
from corpusloom.llm.common import scratch_dir


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*(f"`{c}`" for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the rules' posterior reject go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copied lines go; so do documents that no word is left of because of it."""
    out = lines.without_copied_lines(docs)
    out = out.filter((F.col("_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _recounted(out, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id."""
    return jaccard.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return _recounted(secrets.masked(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed into sequences."""
    return packing.packed_documents(docs, bpe.read_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing_stage),
]

#: EM, connected components and packing are iterative; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
