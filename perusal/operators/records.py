"""Parsed records (silver) from landed payloads (bronze).

Row order is data here: every frame carries ``pos``, the place within its page or issue. Equal
keys collapse to the place of the first and the values of the last (``collapse``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, markup, text
from ..schemas import REGISTRY_PAGE


def collapse(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key: the first row's place, the last row's values."""
    others = [c for c in df.columns if c not in keys and c != pos]
    got = df.groupBy(*keys).agg(F.min(pos).alias(pos), F.max_by(F.struct(*others), F.col(pos)).alias("__r"))
    return got.select(*keys, pos, *[F.col("__r")[c].alias(c) for c in others]).select(df.columns)


def first_wins(df: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, pos).alias(value))


def preprints(raw: DataFrame) -> DataFrame:
    """(category, day, pos, record...) of landed search results, one row per preprint and day."""
    rows = raw.select("category", "day", F.posexplode(markup.call("parse_arxiv_html", "html")).alias("pos", "r"))
    return collapse(rows.select("category", "day", "pos", "r.*"), ["category", "day", "arxiv_id"])


def capped(df: DataFrame, keys: list[str], order: list[str | Column], most: int = 200) -> DataFrame:
    """The first ``most`` rows per key: the sources' page limit, where a caller wants it kept."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def names(authors: Column) -> Column:
    """``given family`` of each author; those with neither part vanish."""
    full = F.transform(authors, lambda a: text.strip(F.concat_ws(" ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit("")))))
    return F.coalesce(F.filter(full, lambda n: n != ""), F.array().cast("array<string>"))


def registry_items(raw: DataFrame) -> DataFrame:
    """(issn, year, pos, item) of landed registry pages, non-articles left out. Pages of a year are
    read up to the first empty one or the first repeated cursor, as a client would fetch them."""
    from pyspark.sql import Window

    page = raw.select("issn", "year", "page_no", F.from_json("json", REGISTRY_PAGE)["message"].alias("m"))
    order = Window.partitionBy("issn", "year").orderBy("page_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    page = page.withColumns({"cursor": F.coalesce(F.col("m.next-cursor"), F.lit("")), "size": F.coalesce(F.size("m.items"), F.lit(0))})
    asked = F.coalesce(F.lag("cursor").over(order), F.lit("*"))  # the cursor that this page was asked for with
    page = page.withColumn("asked", asked)
    page = page.withColumn("seen", F.array_contains(F.collect_list("asked").over(before), F.col("asked")))
    page = page.withColumn("over", F.max(((F.col("size") <= 0) | F.col("seen") | (F.col("asked") == "")).cast("int")).over(order))
    rows = page.filter("over = 0").select("issn", "year", "page_no", F.posexplode("m.items").alias("i", "item"))
    rows = rows.withColumn("pos", F.col("page_no").cast("long") * 1_000_000 + F.col("i"))
    title = F.coalesce(F.get("item.title", F.lit(0)), F.lit(""))
    return rows.filter(~text.non_article(F.col("item.DOI"), title)).select("issn", "year", "pos", "item")


def article(item: str = "item") -> dict[str, Column]:
    """Columns of a registry item as an article."""
    c, some = F.col, lambda x: F.coalesce(x, F.lit(""))
    parts = F.coalesce(c(f"{item}.published-print.date-parts"), c(f"{item}.published-online.date-parts"))
    return {
        "doi": some(c(f"{item}.DOI")), "title": some(F.get(c(f"{item}.title"), F.lit(0))), "authors": names(c(f"{item}.author")), "abstract": markup.call("clean_jats", c(f"{item}.abstract")),
        "volume": some(c(f"{item}.volume")), "issue": some(c(f"{item}.issue")), "pages": some(c(f"{item}.page")), "date": dates.from_parts(F.get(parts, F.lit(0))), "toc_image_url": F.lit(""),
    }


def start_page(pages: Column) -> Column:
    """Integer before the first hyphen; 0 where there is none to read."""
    return F.coalesce(F.get(F.split(pages, "-", -1), F.lit(0)).try_cast("bigint"), F.lit(0).cast("bigint"))


def registry_articles(raw: DataFrame) -> DataFrame:
    """Articles of all landed registry years: (issn, year, pos, record...), pos in order of start page
    within an issue, ties in landed order."""
    from pyspark.sql import Window

    rows = registry_items(raw).select("issn", "year", "pos", *[v.alias(k) for k, v in article().items()])
    order = Window.partitionBy("issn", "year", "volume", "issue").orderBy(start_page(F.col("pages")), "pos")
    return collapse(rows.withColumn("pos", F.row_number().over(order).cast("long")), ["issn", "year", "volume", "issue", "doi"])


def acs_articles(raw: DataFrame, drop_errata: bool = False) -> DataFrame:
    """Articles of landed ACS contents pages: (acs_code, volume, issue, pos, record...). The record's own
    volume and issue are read from the item (item_volume, item_issue)."""
    rows = raw.filter(~text.waiting("html")).select("acs_code", F.col("volume").alias("v"), F.col("issue").alias("i"), F.posexplode(markup.call("parse_acs_toc", "html")).alias("pos", "r")).select("acs_code", "v", "i", "pos", "r.*")
    rows = rows.filter(~F.col("shown").rlike("Issue Publication Information|Editorial Masthead|Issue Editorial"))
    doi, info = text.found("href", r"(10\.1021/\S+)"), F.col("info")
    # the volume is taken literally; without one, the first number is the issue
    after = F.concat(F.regexp_replace("volume", r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\s*,?\s*(\d+)"))
    raw_date = F.coalesce(*[text.found(info, p) for p in (r"(?m)Publication Date[^:]*:\s*(.+?)$", r"(?m)Publication Date\s*(.+?)$", r"(?m)(?:Web|Print)[^:]*:\s*(.+?)$")])
    rows = rows.select(
        "acs_code", "v", "i", "pos", doi.alias("doi"), "title", "authors", "abstract", F.col("volume").alias("item_volume"), F.call_function("regexp_extract", info, after, F.lit(1)).alias("item_issue"),
        F.regexp_extract(info, r"(\d+[-–]\d+)", 1).alias("pages"), F.coalesce(dates.normal_date(text.strip(raw_date)), F.lit("")).alias("date"), text.absolute("image", "https://pubs.acs.org").alias("toc_image_url"),
    ).filter("doi IS NOT NULL AND title <> ''")
    if drop_errata:
        rows = rows.filter(~text.non_article("doi", "title"))
    return collapse(rows.withColumnsRenamed({"v": "volume", "i": "issue"}), ["acs_code", "volume", "issue", "doi"])


def aip_articles(raw: DataFrame) -> DataFrame:
    """Articles of landed AIP issue pages with the id of their abstract: (journal_slug, volume, issue,
    pos, record..., article_id). Of several landed URL shapes the first with items counts."""
    from pyspark.sql import Window

    rows = raw.filter(~text.challenged("html")).withColumn("items", markup.call("parse_aip_toc", "html")).filter(F.size("items") > 0)
    shape = Window.partitionBy("journal_slug", "volume", "issue").orderBy((~F.col("url").contains("/aip/")).cast("int"), "url")
    rows = rows.withColumn("__n", F.row_number().over(shape)).filter("__n = 1")
    rows = rows.select("journal_slug", F.col("volume").alias("v"), F.col("issue").alias("i"), F.posexplode("items").alias("pos", "r")).select("journal_slug", "v", "i", "pos", "r.*")
    cited = F.col("citation")
    citation, link = r"\b(\d+)\s*,\s*([\w.-]+)\s*\((\d{4})\)", r"/article/(\d+)/(\d+)/([^/]+)/"
    doi = F.coalesce(F.nullif(text.strip(text.without_resolver("cited")), F.lit("")), F.nullif(text.strip("marked"), F.lit("")))
    rows = rows.select(
        "journal_slug", "v", "i", "pos", doi.alias("doi"), "title", "authors", F.lit("").alias("abstract"),
        F.coalesce(text.found(cited, citation, 1), F.regexp_extract("href", link, 1)).alias("item_volume"), F.regexp_extract("href", link, 2).alias("item_issue"),
        F.coalesce(text.found(cited, citation, 2), F.regexp_extract("href", link, 3)).alias("pages"), F.regexp_extract(cited, citation, 3).alias("date"),
        F.coalesce(F.nullif("src", F.lit("")), F.col("data_src")).alias("toc_image_url"), "article_id",
    )
    rows = rows.filter(F.col("doi").isNotNull() & ~text.non_article("doi", "title"))
    return collapse(rows.withColumnsRenamed({"v": "volume", "i": "issue"}), ["journal_slug", "volume", "issue", "doi"])


def aip_abstracts(raw: DataFrame) -> DataFrame:
    """(article_id, abstract): of the landed attempts the first good one with text."""
    body = F.from_json("body", "Success BOOLEAN, Html STRING")
    rows = raw.filter("status = 200").filter(~text.challenged("body")).select("article_id", "attempt", body.alias("b")).filter("b.Success")
    rows = rows.withColumn("abstract", markup.call("clean_aip_abstract", "b.Html")).filter("abstract <> ''")
    return rows.groupBy("article_id").agg(F.min_by("abstract", "attempt").alias("abstract"))
