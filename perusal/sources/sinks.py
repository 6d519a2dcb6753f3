"""Sinks with exact file names, and the state table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(df: DataFrame) -> int:
    """Write each (path, md) row to its path, whole or not at all; returns how many were written.

    Spark's writers choose file names themselves, so the driver streams the rendered rows, one
    partition at a time, and stores each through the Hadoop file system of its path: first
    under a temporary name, then by rename.
    """
    spark, n = df.sparkSession, 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in df.select("path", "md").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(r.path)
        fs = path.getFileSystem(conf)
        fs.setWriteChecksum(False)  # readers edit reports; a checksum file beside one would then forbid to read it
        part = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(r.md.encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"could not rename to {r.path}")
        n += 1
    return n


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a state table, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("version-")]
    return sorted(int(p.getName().removeprefix("version-")) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_state(state: DataFrame, path: str) -> None:
    """Add a version of the state table. Readers take the newest one that is whole, so a crash at any
    point leaves the one before; versions before that are deleted."""
    spark = state.sparkSession
    had = versions(spark, path)
    new = (had[-1] if had else 0) + 1
    state.orderBy("slug", "volume", "issue").coalesce(1).write.mode("overwrite").parquet(f"{path}/version-{new}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old in had[:-1]:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/version-{old}")
        gone.getFileSystem(conf).delete(gone, True)


def state_as_json(state: DataFrame) -> DataFrame:
    """One row ``json`` in the form {slug: {"processed": [[volume, issue], ...]}}, sorted."""
    per = state.groupBy("slug").agg(F.sort_array(F.collect_list(F.array("volume", "issue"))).alias("processed"))
    pairs = F.sort_array(F.collect_list(F.struct("slug", F.struct("processed").alias("v"))))
    return per.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
