"""Markdown reports as column expressions, byte for byte in the established layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What the reports' first line names as their maker; fixed value of the format.
_MAKER = "arxiv_tools"
_HEAD = "Links:\n\n- [ ] ["


def _authors() -> Column:
    return F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")


def preprint_entry() -> Column:
    """Entry of a preprint row."""
    i = F.col("arxiv_id")
    return F.concat(
        F.lit("### "), i, F.lit(f"\n\n{_HEAD}"), i, F.lit("]("), text.preprint_url(i), F.lit(")\n\nTitle:  "), F.col("title"), F.lit("\n\nAuthors:  "), _authors(),
        F.lit("\n\nAbstract:\n> [!quote]- Abstract\n"), text.quoted("abstract"), F.lit("\n\n"),
    )


def article_entry() -> Column:
    """Entry of a journal article row; image and abstract only where there are any."""
    d, img = F.col("doi"), F.coalesce("toc_image_url", F.lit(""))
    image = F.when(img != "", F.concat(F.lit("\n![|700]("), img, F.lit(")\n"))).otherwise("")
    abstract = F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("\nAbstract:\n> [!quote]- Abstract\n"), text.quoted("abstract"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### "), d, F.lit(f"\n\n{_HEAD}"), d, F.lit("]("), text.doi_url(d), F.lit(")\n\nTitle:  "), F.col("title"), F.lit("\n\n"), image, F.lit("\nAuthors:  "), _authors(), F.lit("\n\n"), abstract)


def _sections(tag: Column, gap: str) -> Column:
    """Task query and the collected, other and new entries of a grouped row."""
    paper = lambda xs: F.array_join(F.transform(xs, lambda p: F.concat(F.lit("\n"), p["md"])), "")
    news = F.when(F.size("new_ids") > 0, F.concat(F.lit("\n## update\n\n"), F.array_join(F.transform("new_ids", lambda x: F.concat(F.lit("\n- [ ] [[#"), x["key"], F.lit("]]"))), ""), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit(f"---\ntags:\n  - #"), tag, F.lit(f"\n---\n\n{gap}```dataview\nTASK\nfrom #"), tag, F.lit("\n\nWHERE completed\n\n```\n\n"),
        F.lit("## collected\n\n"), paper(F.filter("papers", lambda p: p["collected"])), F.lit("\n## not collected\n\n"), paper(F.filter("papers", lambda p: ~p["collected"])), news,
    )


def grouped(rows: DataFrame, report: list[str], key: str, entry: Column, news: DataFrame | None, first: list[str] = ()) -> DataFrame:
    """One row per report with ``papers`` and ``new_ids`` in document order. A report holds one day
    of a category or one issue, which bounds what is gathered."""
    flagged = rows.withColumn("__new", F.lit(False))
    if news is not None:
        flagged = rows.join(news.select(*report, key).distinct().withColumn("__new", F.lit(True)), [*report, key], "left").withColumn("__new", F.coalesce("__new", F.lit(False)))
    papers = F.sort_array(F.collect_list(F.struct("pos", F.col(key).alias("key"), F.col("__new").alias("new"), "collected", entry.alias("md"))))
    got = flagged.groupBy(*report).agg(papers.alias("papers"), *[F.min_by(c, "pos").alias(c) for c in first])
    return got.withColumn("new_ids", F.filter("papers", lambda p: p["new"]))


def day_reports(rows: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """(category, day, md) of preprint rows (category, day, pos, record..., collected)."""
    day = F.date_format("day", "yyyy-MM-dd")
    tag = F.concat(F.col("category"), F.lit("-"), day)
    md = F.concat(F.lit("# "), day, F.lit(f" preprint by {_MAKER}\n\n\n"), _sections(tag, "\n"))
    return grouped(rows, ["category", "day"], "arxiv_id", preprint_entry(), news).select("category", "day", md.alias("md"))


def issue_reports(rows: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """(slug, volume, issue, md) of article rows (slug, journal_name, year, volume, issue, pos, record...,
    collected). The date is the first article's, else the year, else nothing."""
    got = grouped(rows, ["slug", "volume", "issue"], "doi", article_entry(), news, ["journal_name", "date", "year"])
    date = F.coalesce(F.nullif("date", F.lit("")), F.col("year").cast("string"), F.lit(""))
    tag = F.concat(F.col("slug"), F.lit("-v"), F.col("volume").cast("string"), F.lit("-i"), F.col("issue").cast("string"))
    md = F.concat(F.lit("# "), F.col("journal_name"), F.lit(" Vol. "), F.col("volume").cast("string"), F.lit(", Iss. "), F.col("issue").cast("string"), F.lit(" — "), date, F.lit("\n\n"), _sections(tag, ""))
    return got.select("slug", "volume", "issue", md.alias("md"))


#: Directories of a day's report under its category's root, by layout name; any other name means the first.
LAYOUTS = {
    "category/year/month/day": ("y", "m"),
    "year/month/day/category": ("y", "m", "d", "category"),
    "year/month/category/day": ("y", "m", "category", "d"),
}


def day_path(root: str, layout: str = "category/year/month/day") -> Column:
    part = {"y": F.date_format("day", "yyyy"), "m": F.date_format("day", "MM"), "d": F.date_format("day", "dd"), "category": F.col("category")}
    dirs = LAYOUTS.get(layout, LAYOUTS["category/year/month/day"])
    return F.concat_ws("/", F.lit(root), F.lit("arxiv"), F.col("category"), *[part[d] for d in dirs], F.concat(part["d"], F.lit(".md")))


def issue_path(root: str) -> Column:
    return F.concat_ws("/", F.lit(root), F.col("slug"), F.col("volume").cast("string"), F.concat(F.col("issue").cast("string"), F.lit(".md")))

