"""Readers for the driver's tables under the names that the learning domain gives them."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A parquet table, pruned to the given columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if {"text", "html"} & set(columns) else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: texts in few files would leave most cores without work. Tables in many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def where_equal(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """A conjunction of equalities; conditions whose value is None are left out."""
    for column, value in conditions.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def for_user(df: DataFrame, user: Column | str, column: str = "user_id") -> DataFrame:
    """The tenancy predicate that leads every user-scoped query."""
    return df.filter(F.col(column) == user)


def read_lexical(spark: SparkSession, path: str) -> DataFrame:
    """Chunk entries kept as JSON lines; malformed lines are dropped."""
    schema = "text string, metadata struct<doc_id:string,kb_id:string,source:string>, tokens array<string>, tokenizer_version string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One word per row: the part before `#`, trimmed and lower-cased, blank lines left out."""
    word = F.lower(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(word.alias("word")).filter("word <> ''").distinct()


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as the interaction log: purchase = right answer, error = wrong answer, view = study step."""
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem -> orders -> customer as attempt -> quiz -> document -> knowledge base (nation)."""
    line = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_shipdate")
    quiz = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    doc = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    return line.join(quiz, F.col("l_orderkey") == F.col("o_orderkey")).join(doc, F.col("o_custkey") == F.col("c_custkey"))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's shared checkpoint folder. Only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"
