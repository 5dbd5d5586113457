"""Tables kept as numbered versions in a shared folder: a version counts once it is whole, and nothing is written that would change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = [f.getPath() for f in store.listStatus(folder)]
    whole = [p.getName() for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.removeprefix("v=")) for name in whole if name.startswith("v="))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def publish(df: DataFrame, path: str) -> bool:
    """Write df as the next version unless the newest one has the same rows; whether it was written.

    Readers see the old version until the last file of the new one is in place: its marker is the switch.
    """
    spark = df.sparkSession
    old = current(spark, path)
    if old is not None and old.schema.names == df.schema.names and df.exceptAll(old).isEmpty() and old.exceptAll(df).isEmpty():
        return False
    df.write.parquet(f"{path}/v={(_versions(spark, path) or [-1])[-1] + 1}")
    return True
