"""Which issues to report on: state, discovery, reports on disk, as set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["slug", "volume", "issue"]


def rebuild(processed: DataFrame, valid: DataFrame) -> DataFrame:
    """Processed issues without a valid report, however old."""
    return processed.select(KEY).join(valid.select(KEY), KEY, "left_anti")


def todo(candidates: DataFrame, processed: DataFrame) -> DataFrame:
    """Candidates never processed. One processed without a valid report is in ``rebuild`` already."""
    return candidates.join(processed.select(KEY), KEY, "left_anti")


def candidates(discovered: DataFrame, backfill: bool, order: list[str]) -> DataFrame:
    """All discovered issues for a backfill, else the newest of each journal by ``order``."""
    if backfill:
        return discovered
    newest = discovered.groupBy("slug").agg(F.max(F.struct(*order)).alias("__top"))
    same = F.lit(True)
    got = discovered.join(newest, "slug")
    for c in order:
        same = same & (F.col(c) == F.col("__top")[c])
    return got.filter(same).drop("__top")


def next_state(processed: DataFrame, done: DataFrame) -> DataFrame:
    return processed.select(KEY).union(done.select(KEY)).distinct()
