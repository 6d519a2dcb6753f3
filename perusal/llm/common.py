"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this subpackage: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where the session names none (single-machine tests), a local one is made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='perusal-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    ``keep`` writes a frame and reads it back; ``drop`` deletes what is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """A broadcast hint only for a side whose counted rows are within ``limit``; else a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add, whatever their letter case."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])
