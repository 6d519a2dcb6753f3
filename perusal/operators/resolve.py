"""Which source an issue's articles come from, and filling of empty abstracts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefer(sources: list[DataFrame], issue: list[str]) -> DataFrame:
    """Rows of the first source that has any, chosen per issue as a whole."""
    ranked = [s.withColumn("__prio", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    best = F.min("__prio").over(Window.partitionBy(*issue))
    return both.withColumn("__best", best).filter("__prio = __best").drop("__prio", "__best")


def fill_abstracts(articles: DataFrame, registry: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Empty abstracts from the registry's first non-empty one of the DOI; no rows are added and
    nothing else changes."""
    on = on or ["doi"]
    fill = registry.filter("abstract <> ''").groupBy(*on).agg(F.min_by("abstract", "pos").alias("__fill"))
    got = articles.join(fill, on, "left")
    return got.withColumn("abstract", F.when(F.coalesce("abstract", F.lit("")) == "", F.coalesce("__fill", F.lit(""))).otherwise(F.col("abstract"))).drop("__fill").select(articles.columns)


def with_abstracts(articles: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Articles with the abstracts landed for their article ids."""
    got = articles.drop("abstract").join(abstracts, "article_id", "left")
    return got.withColumn("abstract", F.coalesce("abstract", F.lit(""))).select(articles.columns)


def issue_year(articles: DataFrame, issue: list[str], as_of: datetime.date) -> DataFrame:
    """(issue, year): the first year that can be read from the dates, in order, else that of as_of."""
    year = F.get(F.split("date", "-", -1), F.lit(0)).try_cast("int")
    got = articles.withColumn("__y", year).groupBy(*issue).agg(F.expr("min_by(__y, pos) FILTER (WHERE __y IS NOT NULL)").alias("year"))
    return got.withColumn("year", F.coalesce("year", F.lit(as_of.year)))
