"""Registered queries that render tables into landed payloads and read them back.

Each parser of the engine meets payloads whose every field comes from a table's columns, with the
items that sources mix in: items without a title, repeated items, errata, mastheads, waiting pages.
The SQL gives the same rows from the columns alone. Pages hold a fixed number of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import markup
from ..operators import discover, match, records, render, resolve
from ..sources import landed, sinks
from . import incremental
from .catalogue import _AS_OF, _FEED_SQL, _PLAN_SQL, _WS, _feed, _label_library, _line_sql, _news, _plan_inputs, _t, query, shared
from .tracker import searches

#: Rows of a page.
_PER = 50
_TRIM = rf"regexp_replace(coalesce(text, ''), '^{_WS}|{_WS}$', '', 'g')"


def _html(x: Column | str) -> Column:
    out = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _cat(*parts: Column | str) -> Column:
    """Strings as they are, columns by value; null counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").withColumn("page", F.expr(f"doc_id div {_PER}"))


def _pages(rows: DataFrame, item: Column, *keys: str) -> DataFrame:
    """Pages of the rows' items in order of doc_id."""
    items = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i"))))
    return rows.groupBy("page", *keys).agg(F.array_join(F.transform(items, lambda x: x["i"]), "\n").alias("items"))


_BOOK = "'10.1000/' || doc_id"


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '</?jats:p[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '{_WS}', ' ', 'g'))
 || ' ' || chr(900 + (page_id % 60)::INT) || 'α≤ é° H₂ –“ &lt;' AS plain FROM pages""")
def clean_markup(spark, d):
    """Plain text of markup, entities of any kind decoded."""
    numbered = _cat(F.col("html"), " <jats:p>&#", 900 + F.col("page_id") % 60, ";&alpha;&le; &eacute;&deg; H&#8322; &#x2013;&ldquo; &amp;lt;</jats:p>\n")
    return _t(spark, d, "pages").select("page_id", markup.call("clean_jats", numbered).alias("plain"))


@query(rf"""SELECT 'c' || (doc_id // {_PER} % 3) AS category, (DATE '2026-01-01' + (doc_id // {_PER})::INT)::VARCHAR AS day, (row_number() OVER (PARTITION BY doc_id // {_PER} ORDER BY doc_id) - 1)::INT AS pos, 'arXiv:' || doc_id AS arxiv_id,
 CASE WHEN again THEN 'Again' ELSE 'Doc ' || doc_id END AS title, CASE WHEN again THEN '' ELSE lang || ' A|' || source END AS authors, md5(CASE WHEN again THEN '' ELSE {_TRIM} END) AS abstract,
 CASE WHEN lang = 'en' AND NOT again THEN '10.9/' || doc_id ELSE '' END AS external_doi, CASE WHEN lang = 'en' AND NOT again THEN 'https://doi.org/10.9/' || doc_id ELSE '' END AS external_doi_url,
 CASE WHEN lang = 'de' AND NOT again THEN 'J ' || source ELSE '' END AS journal_ref, CASE WHEN again THEN '' ELSE n_chars || ' pages' END AS comments, CASE WHEN again THEN '' ELSE lang || ',' || source END AS subjects FROM (SELECT *, doc_id % 7 = 0 AS again FROM documents)""")
def parse_preprint_pages(spark, d):
    """Search pages to records; a repeated item keeps its first place and its last values."""
    c = F.col
    item = _cat(
        '<li class="arxiv-result"><p class="list-title"><a href="x">arXiv:', c("doc_id"), '</a></p><span class="tag is-link">', c("lang"), '</span><span class="tag is-grey"> ', c("source"), ' </span><p class="title"> Doc <i>', c("doc_id"),
        '</i> </p><p class="authors"><a>', c("lang"), " A</a>, <a> ", c("source"), '</a></p><span class="abstract-full">', _html("text"), "</span>",
        F.when(c("lang") == "en", _cat('<span class="tag is-light is-size-7"><a href="https://doi.org/10.9/', c("doc_id"), '"> 10.9/', c("doc_id"), "</a></span>")),
        F.when(c("lang") == "de", _cat('<p class="comments">Journal ref: J <i>', c("source"), "</i></p>")), '<p class="comments"><span>Comments:</span> ', c("n_chars"), " pages</p>",
    )
    again = _cat('<li class="arxiv-result"><p class="list-title"><a>arXiv:', c("doc_id"), '</a></p><p class="title">Again</p>')
    rows = _docs(spark, d)
    pages = _pages(rows, item).join(_pages(rows.filter("doc_id % 7 = 0"), again).withColumnRenamed("items", "more"), "page", "left")
    html = _cat('<h1>Just a moment</h1><ol><li class="arxiv-result"><p class="title">none</p>', c("items"), c("more"), "</ol>")
    raw = pages.select(_cat("c", c("page") % 3).alias("category"), F.date_add(F.lit("2026-01-01").cast("date"), c("page").cast("int")).alias("day"), html.alias("html"))
    got = records.preprints(raw)
    return got.withColumns({"day": c("day").cast("string"), "authors": F.array_join("authors", "|"), "subjects": F.array_join("subjects", ","), "abstract": F.md5("abstract")})


@query(rf"""SELECT issn, '10.1/' || doc_id AS doi, row_number() OVER (PARTITION BY issn, source, lang ORDER BY n_chars, doc_id) AS pos, 'T ' || doc_id AS title, lang || ' F|' || source AS authors, md5(trim(regexp_replace(coalesce(text, '') || ' α₂', '{_WS}', ' ', 'g'))) AS abstract,
 source AS volume, lang AS issue, n_chars || '-x' AS pages, CASE WHEN lang = 'en' THEN '2001-2' ELSE '2001-03-04' END AS date FROM (SELECT *, 'i' || (doc_id // {2 * _PER}) AS issn FROM documents) WHERE doc_id % 9 <> 0 AND doc_id % 17 <> 0""")
def parse_registry_pages(spark, d):
    """Registry pages to articles in order of their start page; metadata and errata left out."""
    c, none = F.col, F.lit(None).cast("string")
    person = lambda given, family: F.struct(given.alias("given"), family.alias("family"))
    dates = lambda *x: F.struct(F.array(F.array(*map(F.lit, x))).alias("date-parts"))
    item = F.struct(
        _cat("10.1", F.when(c("doc_id") % 17 == 0, "021/ctv001i001"), "/", c("doc_id")).alias("DOI"), F.array(_cat(F.when(c("doc_id") % 9 == 0, " Erratum: "), "T ", c("doc_id"))).alias("title"), c("source").alias("volume"), c("lang").alias("issue"), _cat(c("n_chars"), "-x").alias("page"),
        F.array(person(c("lang"), F.lit("F")), person(none, c("source")), person(none, none)).alias("author"), _cat("<jats:p>", _html("text"), "\n&alpha;&#8322;</jats:p>").alias("abstract"),
        F.when(c("lang") == "en", dates(2001, 2)).alias("published-print"), dates(2001, 3, 4).alias("published-online"),
    )
    pages = _docs(spark, d).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"]).alias("items"))
    message = F.struct(F.struct(F.when(c("page") % 2 == 0, "next").otherwise("").alias("next-cursor"), "items").alias("message"))
    raw = pages.select(_cat("i", F.expr("page div 2")).alias("issn"), F.lit(2001).alias("year"), (c("page") % 2).cast("int").alias("page_no"), F.to_json(message).alias("json"))
    got = records.registry_articles(raw)
    return got.select("issn", "doi", "pos", "title", F.array_join("authors", "|").alias("authors"), F.md5("abstract").alias("abstract"), "volume", "issue", "pages", "date")


@query(rf"""SELECT (doc_id // {_PER})::VARCHAR AS volume, '1' AS issue, pos, '10.1021/acs.' || doc_id AS doi, 'Doc ' || doc_id AS title, lang || ' ' || source AS authors, md5({_TRIM}) AS abstract, '22' AS item_volume, '7' AS item_issue, n_chars || '–' || (n_chars + 9) AS pages,
 CASE WHEN lang = 'en' THEN '2026-03-26' ELSE 'soon' END AS date, CASE WHEN lang = 'de' THEN 'https://pubs.acs.org/i/' || doc_id || '.gif' ELSE '' END AS image
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id // {_PER} ORDER BY doc_id) - 1)::INT AS pos FROM documents) WHERE doc_id % 11 <> 0 AND doc_id // {_PER} % 13 <> 5""")
def parse_acs_contents(spark, d):
    """ACS contents pages to articles; pages that name the service behind the waiting page are read, waiting pages aren't."""
    c = F.col
    item = _cat(
        '<div class="issue-item clearfix"><h3 class="issue-item_title"><a href="/doi/10.1021/acs.', c("doc_id"), '">Doc <i>', c("doc_id"), '</i></a></h3><span class="hlFld-ContribAuthor"><given-names> ', c("lang"), "</given-names><surname>", c("source"),
        ' </surname></span><span class="hlFld-ContribAuthor"></span><span class="hlFld-Abstract">', _html("text"), "</span>", F.when(c("lang") == "de", _cat('<div class="issue-item_img"><img class="lazy" data-src="/i/', c("doc_id"), '.gif"></div>')),
        F.when(c("doc_id") % 11 == 0, "<p>Editorial Masthead</p>"), '<div class="issue-item_info"><span class="issue-item_vol-num">22</span>, 7, ', c("n_chars"), "–", c("n_chars") + 9, " (Article) ",
        F.when(c("lang") == "en", "Publication Date (Web): March 26, 2026").otherwise("Print: soon"), "</div></div>",
    )
    html = _cat("<p>Served by Cloudflare</p>", F.when(c("page") % 13 == 5, "<title>Just a moment</title>"), c("items"))
    raw = _pages(_docs(spark, d), item).select(F.lit("j").alias("acs_code"), c("page").cast("string").alias("volume"), F.lit("1").alias("issue"), html.alias("html"))
    got = records.acs_articles(raw)
    return got.select("volume", "issue", "pos", "doi", "title", F.array_join("authors", "|").alias("authors"), F.md5("abstract").alias("abstract"), "item_volume", "item_issue", "pages", "date", F.col("toc_image_url").alias("image"))


@query(rf"""SELECT (doc_id // {_PER})::VARCHAR AS volume, '16' AS issue, (row_number() OVER (PARTITION BY doc_id // {_PER} ORDER BY doc_id) - 1)::INT AS pos, CASE WHEN lang = 'en' THEN '10.1063/c.' ELSE '10.1063/m.' END || doc_id AS doi, CASE WHEN doc_id // {_PER} % 2 = 0 THEN 'First ' ELSE 'Second ' END || doc_id AS title,
 lang || ' X|' || source AS authors, CASE WHEN lang IN ('en', 'de') THEN 'On ' || source || ' & ' || lang ELSE '' END AS abstract, '164' AS item_volume, (doc_id % 12)::VARCHAR AS item_issue, CASE WHEN lang = 'en' THEN n_chars::VARCHAR ELSE doc_id::VARCHAR END AS pages, CASE WHEN lang = 'en' THEN '2026' ELSE '' END AS date,
 CASE WHEN lang = 'fr' THEN '/i.png' ELSE '' END AS image FROM documents WHERE doc_id // {_PER} % 13 <> 5 QUALIFY true""")
def parse_aip_contents(spark, d):
    """AIP issue pages to articles, with the abstracts landed for them; of two URL shapes the first with items counts."""
    c, rows = F.col, _docs(spark, d)
    item = lambda name: _cat(
        '<div class="al-article-items"><h5 class="item-title"><a href="/aip/jcp/article/164/', c("doc_id") % 12, "/", c("doc_id"), f'/1/x">{name} <i>', c("doc_id"), '</i></a></h5><div class="al-authors-list"><span class="wi-fullname"><a>', c("lang"), "</a> X</span>",
        '<span class="wi-fullname"> </span><span class="wi-fullname">', c("source"), "</span></div>", F.when(c("lang") == "en", _cat('<span class="ww-citation-primary"><em>J.</em> 164, ', c("n_chars"), " (2026)</span>")),
        F.when(c("lang") == "en", _cat('<div class="citation-label"><a href="https://dx.doi.org/10.1063/c.', c("doc_id"), '">x</a></div>')), '<a data-doi=" 10.1063/m.', c("doc_id"), ' ">pdf</a>',
        F.when(c("lang") == "fr", '<div class="issue-featured-image"><img src="" data-src="/i.png"></div>'), F.when(c("lang").isin("en", "de"), _cat('<a class="js-show-abstract" data-articleid="', c("doc_id"), '">Abstract</a>')), "</div>",
    )
    head = F.when(c("page") % 13 == 5, "<title>Just a moment</title>").otherwise('<div class="al-article-items"><h5 class="item-title"><a href="/x">Erratum: y</a></h5><a data-doi="10.1063/e"></a></div>')
    tail = '<div class="al-article-items"><h5 class="item-title"><a href="/x">No doi</a></h5></div>'
    shape = lambda name, where, keep: _pages(rows, item(name)).select(F.lit("jcp").alias("journal_slug"), c("page").cast("string").alias("volume"), F.lit("16").alias("issue"), _cat(f"https://pubs.aip.org{where}/", c("page")).alias("url"), F.when(keep, _cat(head, c("items"), tail)).otherwise("").alias("html"))
    raw = shape("First", "/aip/jcp/issue", c("page") % 2 == 0).unionByName(shape("Second", "/jcp/issue", F.lit(True)))
    tries = rows.filter("lang IN ('en', 'de')").select(c("doc_id").cast("string").alias("article_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt"), "source", "lang")
    answer = F.struct((c("attempt") > 0).alias("Success"), F.when(c("attempt") == 1, _cat("<h2>Abstract</h2><p>On  ", c("source"), "</p> &amp; ", c("lang"))).otherwise("<p>later</p>").alias("Html"))
    body = tries.select("article_id", "attempt", F.lit(200).alias("status"), F.to_json(answer).alias("body"))
    got = resolve.with_abstracts(records.aip_articles(raw), records.aip_abstracts(body))
    return got.select("volume", "issue", (c("pos") - 1).alias("pos"), "doi", "title", F.array_join("authors", "|").alias("authors"), "abstract", "item_volume", "item_issue", "pages", "date", c("toc_image_url").alias("image"))


@query(f"""SELECT source AS slug, n_chars::VARCHAR AS volume, lang AS issue, string_agg({_BOOK}, ' ' ORDER BY doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0), doc_id) AS ids, true AS ok FROM documents GROUP BY ALL""")
def doi_report_ids(spark, d):
    """Article ids read back from rendered issue reports."""
    c = F.col
    docs = _t(spark, d, "documents").select(
        c("source").alias("slug"), c("source").alias("journal_name"), F.lit(2001).alias("year"), c("n_chars").cast("string").alias("volume"), c("lang").alias("issue"), c("doc_id").alias("pos"), _cat("10.1000/", c("doc_id")).alias("doi"),
        _cat("Document ", c("doc_id")).alias("title"), F.array("lang").alias("authors"), F.lit("").alias("abstract"), F.lit("").alias("date"), F.lit("").alias("toc_image_url"),
    )
    md = render.issue_reports(match.articles_collected(docs, match.library_keys(_label_library(spark, d))))
    return match.report_ids(md, "doi").select("slug", "volume", "issue", F.array_join("ids", " ").alias("ids"), "ok")


@query(f"""WITH {_FEED_SQL} SELECT category, day::VARCHAR AS day, string_agg('arXiv:' || pos, ' ' ORDER BY NOT collected, pos) || coalesce(' ' || string_agg('arXiv:' || pos, ' ' ORDER BY pos) FILTER (WHERE fresh AND pos % 2 = 0), '') AS ids FROM flagged GROUP BY category, flagged.day""")
def ticked_links(spark, d):
    """Ids of reports whose even update links are ticked: headings first, then the ticked ones."""
    rows = _feed(spark, d)
    md = render.day_reports(rows, _news(spark, d, rows))
    ticked = md.withColumn("md", F.regexp_replace("md", r"- \[ \] (\[\[#arXiv:\d*[02468]\]\])", "- [x] $1"))
    return match.report_ids(ticked).select("category", F.col("day").cast("string").alias("day"), F.array_join("ids", " ").alias("ids"))


@query(rf"""WITH {_FEED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY category, day ORDER BY NOT collected, pos) - 1 AS i, count(*) OVER (PARTITION BY category, day) AS many, count(*) FILTER (WHERE collected) OVER (PARTITION BY category, day) AS have,
 bool_or(fresh) OVER (PARTITION BY category, day) AS more FROM flagged)
SELECT category, day::VARCHAR AS day, i::INT AS pos, 'arXiv:' || n.pos AS arxiv_id, 'Event ' || n.pos AS title, 'user ' || n.user_id || '|x' AS authors,
 replace(substr({_line_sql("concat_ws(chr(10), e.props, '[[it''s]] <b> & c')")}, 3), chr(10) || '> ', chr(10) || ' ') || CASE WHEN collected AND i = have - 1 THEN E'\n\n\n## not collected' ELSE '' END AS abstract
FROM n JOIN events e ON e.event_id = n.pos WHERE more OR i < many - 1""")
def roundtrip_entries(spark, d):
    """Entries read back from rendered reports; the last one of a report without an update section is lost."""
    rows = _feed(spark, d)
    got = match.report_entries(render.day_reports(rows, _news(spark, d, rows)))
    return got.withColumns({"day": F.col("day").cast("string"), "authors": F.array_join("authors", "|")})


@query("""SELECT o_custkey::VARCHAR AS volume, coalesce(arg_min(year(o_orderdate), o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 2001)::INT AS year FROM orders GROUP BY o_custkey""")
def issue_year(spark, d):
    """Year of an issue: the first that a date gives, else this year."""
    date = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderstatus") == "O", "soon")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("volume"), F.col("o_orderkey").alias("pos"), date.alias("date"))
    return resolve.issue_year(rows, ["volume"], _AS_OF)


_ACS_SQL = "SELECT DISTINCT (o_custkey % 200)::INT AS volume, month(o_orderdate)::INT AS issue, year(o_orderdate) AS y FROM orders"


@query(f"""SELECT volume, issue, '/toc/jctcce/' || volume || '/' || issue AS url FROM (SELECT volume, issue FROM ({_ACS_SQL}) WHERE y >= 1995 AND NOT (volume = 0 AND issue = 0) UNION SELECT 999, 1)""")
def acs_issue_lists(spark, d):
    """Issues from the landing page's year groups, from a year on; links elsewhere and placeholders are none."""
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 200).alias("v"), F.month("o_orderdate").alias("i"), F.year("o_orderdate").alias("y")).distinct()
    links = o.groupBy("y").agg(F.array_join(F.array_sort(F.collect_list(_cat('<a href="/toc/jctcce/', F.col("v"), "/", F.col("i"), '">i</a>'))), "").alias("a"))  # at most 200 * 12 links
    url = _cat("/loi/jctcce/group/d1990.y", F.col("y"))
    groups = links.select(F.lit("jctcce").alias("acs_code"), url.alias("group_url"), F.lit(False).alias("is_landing"), _cat('<a href="https://pubs.acs.org/toc/jctcce/1/99">x</a>', F.col("a")).alias("html"))
    landing = links.groupBy().agg(F.array_join(F.array_sort(F.collect_list(_cat('<a href="', url, '">y</a>'))), "").alias("g"))
    landing = landing.select(F.lit("jctcce").alias("acs_code"), F.lit("/loi/jctcce").alias("group_url"), F.lit(True).alias("is_landing"), _cat('<a href="/toc/jctcce/0/0">asap</a><a href="/toc/jctcce/999/1">n</a>', F.col("g")).alias("html"))
    return discover.acs_issues(landing.unionByName(groups), "jctcce", _AS_OF, 1995)


@query("""SELECT DISTINCT category, day::VARCHAR AS day, 'https://arxiv.org/search/advanced?advanced=&terms-0-term=&terms-0-operator=AND&terms-0-field=title&classification-physics=y&classification-physics_archives=' || CASE category WHEN 'chem-ph' THEN 'physics' ELSE category END
 || '&classification-include_cross_list=include&date-filter_by=date_range&date-year=&date-from_date=' || day || '&date-to_date=' || (day + 1) || '&date-date_type=submitted_date_first&abstracts=show&size=200&order=submitted_date'
 || CASE category WHEN 'chem-ph' THEN '&terms-1-operator=AND&terms-1-term=physics.chem-ph&terms-1-field=all' ELSE '' END AS url
FROM (SELECT ts::DATE AS day, CASE user_id % 3 WHEN 0 THEN 'quant-ph' WHEN 1 THEN 'hep-th' ELSE 'chem-ph' END AS category FROM events)""")
def search_requests(spark, d):
    """The searches of days and categories as URLs."""
    kind = F.when(F.col("user_id") % 3 == 0, "quant-ph").when(F.col("user_id") % 3 == 1, "hep-th").otherwise("chem-ph")
    days = _t(spark, d, "events").select(kind.alias("category"), F.to_date("ts").alias("day")).distinct()
    return searches(days, config.CATEGORIES).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_PLAN_SQL} SELECT * FROM processed UNION SELECT * FROM disc")
def state_table(spark, d):
    """State written in two versions and read back: the newest counts."""
    processed, _, found = _plan_inputs(spark, d)
    path = f"{shared(spark)}/state-{uuid.uuid4().hex}"
    sinks.write_state(processed, path)
    sinks.write_state(incremental.next_state(landed.state(spark, path), found), path)
    return landed.state(spark, path)
