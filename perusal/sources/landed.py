"""Readers of landed payloads, earlier reports and state. Acquisition itself is not done here."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .sinks import versions

TABLES: dict[str, str] = {
    "raw_arxiv": schemas.RAW_PREPRINT, "raw_crossref": schemas.RAW_REGISTRY, "raw_acs_toc": schemas.RAW_ACS_TOC, "raw_acs_loi": schemas.RAW_ACS_LIST,
    "raw_aip_toc": schemas.RAW_AIP_TOC, "raw_aip_abstract": schemas.RAW_AIP_ABSTRACT, "raw_library": schemas.RAW_LIBRARY,
}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A landed table (Parquet, by any partition columns of its schema); empty if nothing landed."""
    return _or_empty(spark, lambda: spark.read.schema(TABLES[table]).parquet(f"{root}/{table}"), TABLES[table])


def _or_empty(spark: SparkSession, load, schema: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def reports(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, md) of all Markdown files below the roots; those that aren't there hold none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(r) for r in roots]
    there = [r for r, p in zip(roots, at) if p.getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], schemas.REPORTS)
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))


def day_keys(reports: DataFrame) -> DataFrame:
    """Reports with (category, day) from their path, in any of the layouts."""
    p = F.col("path")
    y, m, d = (F.regexp_extract(p, r"/arxiv/([^/]+)/(\d{4})/(\d{2})/(?:.*/)?(\d{2})\.md$", i) for i in (2, 3, 4))
    day = F.call_function("try_to_date", F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd"))
    return reports.select(F.regexp_extract(p, r"/arxiv/([^/]+)/\d{4}/", 1).alias("category"), day.alias("day"), "md").filter("day IS NOT NULL")


def issue_keys(reports: DataFrame) -> DataFrame:
    """Reports with (slug, volume, issue) from their path."""
    parts = [F.regexp_extract("path", r"/([^/]+)/([^/]+)/([^/]+)\.md$", i) for i in (1, 2, 3)]
    return reports.select(*[p.alias(n) for p, n in zip(parts, ("slug", "volume", "issue"))], "md").filter("slug <> ''")


def state(spark: SparkSession, path: str) -> DataFrame:
    """Processed issues, of the newest whole version; none before the first run."""
    had = versions(spark, path)
    if not had:
        return spark.createDataFrame([], schemas.PROCESSED)
    return spark.read.schema(schemas.PROCESSED).parquet(f"{path}/version-{had[-1]}")


def state_json(spark: SparkSession, path: str) -> DataFrame:
    """State in the JSON form {slug: {"processed": [[volume, issue], ...]}}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<processed: array<array<int>>>>")).alias("slug", "s"))
    rows = rows.select("slug", F.explode("s.processed").alias("p"))
    return rows.select("slug", F.get("p", F.lit(0)).alias("volume"), F.get("p", F.lit(1)).alias("issue"))
