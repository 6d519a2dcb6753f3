"""The tracker: reports over landed payloads. Every method returns a frame; sinks are separate."""

from __future__ import annotations

import datetime
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import dates, text
from ..operators import discover, match, records, render, resolve
from ..sources import landed, sinks
from . import incremental

logger = logging.getLogger(__name__)
RECORD = ["doi", "title", "authors", "abstract", "pages", "date", "toc_image_url"]


class Tracker:
    """Reports on what is landed under ``landing``, written below ``out``.

    ``as_of`` stands for today, so that runs can be repeated. State keeps (slug, volume, issue) of
    issues that have a report, so an issue whose sources were empty is tried again later.
    """

    def __init__(self, spark: SparkSession, landing: str, out: str, as_of: datetime.date, config_path: str | None = None):
        self.spark, self.landing, self.out, self.as_of = spark, landing, out, as_of
        self.categories, self.journals = config.categories(config_path), config.journals(config_path)

    def landed(self, name: str) -> DataFrame:
        return landed.read(self.spark, self.landing, name)

    def library(self) -> DataFrame:
        return match.library_keys(self.landed("raw_library"))

    # preprints

    def daily_report(self, categories: list[str], months: list[str], layout: str = "category/year/month/day", cap: int | None = None) -> DataFrame:
        """(path, md) of every (category, day) of the months that has preprints."""
        for c in categories:
            config.pick(self.categories, c, "Category")
        wanted = [(c, *dates.parse_month(m, self.as_of)) for m in dict.fromkeys(months) for c in dict.fromkeys(categories)]
        calendar = self.spark.createDataFrame(wanted, "category string, y int, m int").select("category", F.explode(dates.month_days(F.col("y"), F.col("m"))).alias("day"))
        rows = records.preprints(self.landed("raw_arxiv").join(F.broadcast(calendar), ["category", "day"]))  # a month has 31 days
        if cap:
            for r in rows.groupBy("category", "day").count().filter(F.col("count") > cap).collect():
                logger.warning("%s %s: %d preprints, the first %d are kept", r.category, r.day, r["count"], cap)
            rows = records.capped(rows, ["category", "day"], ["pos", "arxiv_id"], cap)
        rows = match.preprints_collected(rows, self.library())
        # in every layout a month's reports are below its category, year and month
        months_of = [f"{self.out}/arxiv/{c}/{y:04d}/{m:02d}" for c, y, m in wanted]
        old = match.report_ids(landed.day_keys(landed.reports(self.spark, *months_of))).filter("ok")
        news = match.new_since(rows, ["category", "day"], "arxiv_id", old)
        return render.day_reports(rows, news).select(render.day_path(self.out, layout).alias("path"), "md")

    def search_requests(self, categories: list[str], months: list[str]) -> DataFrame:
        """(category, day, url): the search of every day of the months, for whoever lands the pages."""
        wanted = [(c, *dates.parse_month(m, self.as_of)) for m in dict.fromkeys(months) for c in dict.fromkeys(categories)]
        days = self.spark.createDataFrame(wanted, "category string, y int, m int").select("category", F.explode(dates.month_days(F.col("y"), F.col("m"))).alias("day"))
        return searches(days, {c: config.pick(self.categories, c, "Category") for c in dict.fromkeys(categories)})

    # journals

    def _root(self, cfg: dict[str, str]) -> str:
        return f"{self.out}/{cfg.get('provider') or ('acs' if cfg.get('acs_code') else 'journals')}"

    def articles(self, journal: str, issues: DataFrame) -> DataFrame:
        """Article rows of issues (slug, volume, issue as strings, year or null): the publisher's page if
        it has any articles, else the registry's list for the issue's year (as_of's if unknown)."""
        cfg = config.pick(self.journals, journal, "Journal")
        key = ["volume", "issue"]
        wanted = issues.select("volume", "issue", F.coalesce("year", F.lit(self.as_of.year)).alias("wanted_year"), F.col("year").alias("known_year"))
        registry = records.registry_articles(self.landed("raw_crossref").filter(F.col("issn") == cfg["issn"]))
        sources = []
        if cfg.get("acs_code"):
            page = records.acs_articles(self.landed("raw_acs_toc").filter(F.col("acs_code") == cfg["acs_code"]))
            sources.append(page.join(wanted, key).select("volume", "issue", "pos", *RECORD))
        if cfg.get("provider") == "aip" and cfg.get("slug"):
            page = records.aip_articles(self.landed("raw_aip_toc").filter(F.col("journal_slug") == cfg["slug"])).join(wanted.select(key), key)
            page = resolve.with_abstracts(page, records.aip_abstracts(self.landed("raw_aip_abstract")))
            year = resolve.issue_year(page, key, self.as_of).join(wanted.select(*key, "known_year"), key).withColumn("year", F.coalesce("known_year", "year")).drop("known_year")
            page = resolve.fill_abstracts(page.join(year, key), registry.select("year", "doi", "abstract", "pos"), ["year", "doi"])
            sources.append(page.select("volume", "issue", "pos", *RECORD))
        listed = registry.join(wanted, key).filter("year = wanted_year")
        sources.append(listed.select("volume", "issue", "pos", *RECORD))
        rows = resolve.prefer(sources, key).join(wanted.select(*key, F.col("known_year").alias("year")), key)
        return rows.withColumns({"slug": F.lit(cfg["slug"]), "journal_name": F.lit(cfg["name"])})

    def _reports(self, journal: str, issues: DataFrame) -> DataFrame:
        cfg = config.pick(self.journals, journal, "Journal")
        rows = match.articles_collected(self.articles(journal, issues), self.library())
        old = match.report_ids(landed.issue_keys(landed.reports(self.spark, f"{self._root(cfg)}/{cfg['slug']}")), "doi").filter("ok")
        news = match.new_since(rows, incremental.KEY, "doi", old)
        return render.issue_reports(rows, news).withColumn("path", render.issue_path(self._root(cfg)))

    def issue_report(self, journal: str, volume: str, issue: str, year: int | None = None) -> DataFrame:
        """(path, md) of one issue; no row where no source has articles."""
        one = self.spark.createDataFrame([(str(volume), str(issue), year or None)], "volume string, issue string, year int")
        return self._reports(journal, one).select("path", "md")

    def state_path(self) -> str:
        return f"{self.out}/state"

    def plan(self, journal: str, backfill: bool = False, from_year: int = 0) -> DataFrame:
        """(slug, volume, issue, year): issues to rebuild, then issues to do, oldest first each."""
        cfg = config.pick(self.journals, journal, "Journal")
        slug = F.lit(cfg["slug"]).alias("slug")
        processed = landed.state(self.spark, self.state_path()).filter(F.col("slug") == cfg["slug"])
        found = match.report_ids(landed.issue_keys(landed.reports(self.spark, f"{self._root(cfg)}/{cfg['slug']}")), "doi").filter("ok")
        valid = found.select("slug", F.col("volume").try_cast("int").alias("volume"), F.col("issue").try_cast("int").alias("issue"))
        years = discover.registry_issues(records.registry_items(self.landed("raw_crossref")), cfg["issn"], self.as_of, 1)
        if cfg.get("acs_code"):
            lists = self.landed("raw_acs_loi")
            issues = discover.acs_issues(lists, cfg["acs_code"], self.as_of, from_year) if backfill else discover.acs_latest(lists, cfg["acs_code"])
            chosen = issues.select(slug, "volume", "issue")
        else:
            issues = discover.registry_issues(records.registry_items(self.landed("raw_crossref")), cfg["issn"], self.as_of, from_year).select(slug, "year", "volume", "issue")
            chosen = incremental.candidates(issues, backfill, ["year", "volume", "issue"]).drop("year")
        again = incremental.rebuild(processed, valid).withColumn("turn", F.lit(0))
        new = incremental.todo(chosen, processed).select(*incremental.KEY, F.lit(1).alias("turn"))
        return again.unionByName(new).join(years, ["volume", "issue"], "left").orderBy("turn", "year", "volume", "issue").select(*incremental.KEY, "year")

    def auto(self, journal: str, backfill: bool = False, from_year: int = 0) -> DataFrame:
        """(slug, volume, issue, path, md) of all issues that ``plan`` lists."""
        issues = self.plan(journal, backfill, from_year).select(F.col("volume").cast("string").alias("volume"), F.col("issue").cast("string").alias("issue"), "year")
        return self._reports(journal, issues)

    #: Issues between two writes of the state.
    BATCH = 20

    def run_auto(self, journal: str, backfill: bool = False, from_year: int = 0) -> int:
        """Write the reports of all issues that ``plan`` lists, in its order, and add them to the state every
        BATCH issues, so that a run that was stopped goes on where it was; returns their number."""
        issues = [(str(r.volume), str(r.issue), r.year) for r in self.plan(journal, backfill, from_year).collect()]  # numbers of one journal's issues
        n = 0
        for at in range(0, len(issues), self.BATCH):
            some = self.spark.createDataFrame(issues[at : at + self.BATCH], "volume string, issue string, year int")
            n += self._write_batch(self._reports(journal, some))
        logger.info("%s: %d issues planned, %d reports", journal, len(issues), n)
        return n

    def _write_batch(self, reports: DataFrame) -> int:
        """Write rendered reports and their issues' state. What is written is fixed first, in a table:
        computed again it would see its own reports as earlier ones."""
        path = f"{self.out}/.batch-{uuid.uuid4().hex}"
        reports.write.parquet(path)
        try:
            got = self.spark.read.schema(reports.schema).parquet(path)
            n = sinks.write_reports(got)
            done = got.select("slug", F.col("volume").cast("int").alias("volume"), F.col("issue").cast("int").alias("issue"))
            if n:
                sinks.write_state(incremental.next_state(landed.state(self.spark, self.state_path()), done), self.state_path())
        finally:
            sinks.delete(self.spark, path)
        return n


def searches(days: DataFrame, categories: dict[str, dict[str, str]]) -> DataFrame:
    """(category, day, url) of rows (category, day): each day's search, up to the day after."""
    url = None
    start, stop = F.date_format("day", "yyyy-MM-dd"), F.date_format(F.date_add("day", 1), "yyyy-MM-dd")
    for name, params in categories.items():
        asked = F.concat(F.lit(config.SEARCH_URL), text.query_string(config.search_parameters(params, start, stop)))
        url = F.when(F.col("category") == name, asked) if url is None else url.when(F.col("category") == name, asked)
    return days.select("category", "day", url.alias("url"))
