"""Command line: python -m perusal.cli --landing DIR --data_dir DIR ..."""

from __future__ import annotations

import argparse
import datetime
import logging

from pyspark.sql import SparkSession

from .functions import markup
from .plans.tracker import Tracker
from .sources import sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="perusal")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--source", choices=["arxiv", "journal"], default="arxiv")
    p.add_argument("--landing", required=True, help="folder of landed payload tables")
    p.add_argument("--data_dir", required=True, help="folder of reports and state")
    p.add_argument("--config", default=None, help="TOML file of categories and journals")
    p.add_argument("--as_of", type=datetime.date.fromisoformat, default=None, help="day that counts as today")
    p.add_argument("--time", default="1949.10", help="months YYYY.MM, comma-separated; 1949.10: this month")
    p.add_argument("--category", default="quant-ph", help="comma-separated, not trimmed")
    p.add_argument("--cap", type=int, default=None, help="preprints that are kept a day, in page order")
    p.add_argument("--requests", action="store_true", help="print the searches of the days, one URL a line, instead of reports")
    p.add_argument("--output_format", default="category/year/month/day")
    p.add_argument("--journal", default="")
    p.add_argument("--volume", default="")
    p.add_argument("--issue", default="")
    p.add_argument("--year", type=int, default=0)
    p.add_argument("--backfill", action="store_true")
    p.add_argument("--from_year", type=int, default=0)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO)
    spark = SparkSession.builder.appName("perusal").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    markup.register(spark)
    tracker = Tracker(spark, a.landing, a.data_dir, a.as_of or datetime.date.today(), a.config)
    if a.requests:
        urls = tracker.search_requests(a.category.split(","), a.time.split(",")).orderBy("category", "day").collect()
        print("\n".join(r.url for r in urls))
        return len(urls)
    if a.source == "arxiv":
        n = sinks.write_reports(tracker.daily_report(a.category.split(","), a.time.split(","), a.output_format, a.cap))
    elif not a.journal:
        raise RuntimeError("--journal required")
    elif a.volume and a.issue:
        n = sinks.write_reports(tracker.issue_report(a.journal, a.volume, a.issue, a.year or None))
    else:
        n = tracker.run_auto(a.journal, a.backfill, a.from_year)
    logging.info("%d reports", n)
    return n


if __name__ == "__main__":
    main()
