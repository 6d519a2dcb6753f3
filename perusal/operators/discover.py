"""Issue discovery from landed issue lists and registry years."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, markup


def _links(lists: DataFrame, code: str) -> DataFrame:
    rows = lists.filter(F.col("acs_code") == code).select("group_url", "is_landing", F.posexplode(markup.call("extract_links", "html")).alias("pos", "a"))
    return rows.select("group_url", "is_landing", "pos", F.col("a.href").alias("href"))


def _issues(links: DataFrame, code: str) -> DataFrame:
    """Links to issues, at their start only; the 0/0 placeholder is none."""
    pattern = rf"^/toc/{code}/(\d+)/(\d+)"
    got = links.withColumns({"volume": F.regexp_extract("href", pattern, 1).try_cast("int"), "issue": F.regexp_extract("href", pattern, 2).try_cast("int")})
    return got.filter("volume IS NOT NULL AND issue IS NOT NULL AND NOT (volume = 0 AND issue = 0)")


def acs_issues(lists: DataFrame, code: str, as_of: datetime.date, from_year: int = 0) -> DataFrame:
    """(volume, issue, url) newest first. Year groups come from the landing page's links; without any
    (or any from ``from_year`` on) there are no issues at all, even if the landing page lists some."""
    links = _links(lists, code)
    groups = links.filter("is_landing").filter(F.col("href").contains("/loi/") & F.col("href").contains("/group/d"))
    groups = groups.groupBy("href").agg(F.min("pos").alias("place"))
    if from_year:
        groups = groups.filter(dates.group_year(F.col("href"), as_of) >= from_year)
    groups = groups.select(F.regexp_replace("href", r"^https?://[^/]+", "").alias("group_key"), "place")
    pages = links.filter("NOT is_landing").withColumn("group_key", F.regexp_replace("group_url", r"^https?://[^/]+", "")).join(groups, "group_key").select("place", "pos", "href")
    if not from_year or as_of.year >= from_year:
        landing = links.filter("is_landing").withColumn("any", F.lit(1)).join(groups.limit(1).select(F.lit(1).alias("any")), "any", "left_semi")
        pages = pages.unionByName(landing.select(F.lit(-1).alias("place"), "pos", "href"))
    got = _issues(pages, code).groupBy("volume", "issue").agg(F.min_by("href", F.struct("place", "pos")).alias("url"))
    return got.orderBy(F.desc("volume"), F.desc("issue"), F.desc("url"))


def acs_latest(lists: DataFrame, code: str) -> DataFrame:
    """The first issue link of the landing page, in page order (not the greatest)."""
    return _issues(_links(lists, code).filter("is_landing"), code).orderBy("pos").limit(1).select("volume", "issue", F.col("href").alias("url"))


def registry_issues(items: DataFrame, issn: str, as_of: datetime.date, from_year: int = 0) -> DataFrame:
    """(year, volume, issue) newest first: each issue in its earliest year; only integer numbers."""
    start = from_year or as_of.year - 10
    rows = items.filter((F.col("issn") == issn) & F.col("year").between(start, as_of.year))
    rows = rows.select("year", F.col("item.volume").try_cast("int").alias("volume"), F.col("item.issue").try_cast("int").alias("issue"))
    got = rows.filter("volume IS NOT NULL AND issue IS NOT NULL").groupBy("volume", "issue").agg(F.min("year").alias("year"))
    return got.select("year", "volume", "issue").orderBy(F.desc("year"), F.desc("volume"), F.desc("issue"))


def newest(issues: DataFrame, *order: str) -> DataFrame:
    return issues.orderBy(*[F.desc(c) for c in order]).limit(1)


def oldest_first(issues: DataFrame, *order: str) -> DataFrame:
    return issues.orderBy(*order)
