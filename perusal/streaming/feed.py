"""Streaming variants: landed payloads as file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """Files that land in a folder; of a single file, its folder is watched for that name."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def first_seen(rows: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """Each key once. With a time column and a lateness, state older than that is dropped; without,
    every key is remembered, as lateness is unbounded."""
    if time:
        return rows.withWatermark(time, late or "0 seconds").dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def run_available(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work through all that has landed and stop; the next call goes on from there. ``batch`` calls
    the same functions as a batch run."""
    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def track(spark: SparkSession, tracker, checkpoint: str, layout: str = "category/year/month/day") -> StreamingQuery:
    """Write the reports of every (category, day) that new payloads touch, over all that landed for it."""
    from ..schemas import RAW_PREPRINT
    from ..sources import sinks

    def batch(df: DataFrame, _: int) -> None:
        touched = df.select("category", F.date_format("day", "yyyy.MM").alias("month")).distinct().collect()  # days landed since the last trigger
        for category in sorted({r.category for r in touched}):
            sinks.write_reports(tracker.daily_report([category], sorted({r.month for r in touched if r.category == category}), layout))

    return run_available(stream(spark, f"{tracker.landing}/raw_arxiv", RAW_PREPRINT), checkpoint, batch)
