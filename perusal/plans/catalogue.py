"""Registered queries of the core engine and their DuckDB counterparts.

The driver's tables hold no article metadata, so each operator runs on the nearest table:
pages for landed HTML, documents for articles, labels for the library, events for a daily
feed, orders for issue catalogues, conversations for ordered groups. Whole tables each time.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, markup, text
from ..operators import discover, match, records, render, resolve
from ..streaming import feed
from . import incremental

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_AS_OF = datetime.date(2001, 12, 31)
#: White space as text functions see it, for DuckDB.
_WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. A run on one
    machine that names none gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='perusal-')}"
    return found.rstrip("/")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""SELECT page_id, len(l)::INT AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def parse_page_links(spark, d):
    """Links of each page, through the element tree."""
    got = _t(spark, d, "pages").withColumn("l", markup.call("extract_links", "html"))
    return got.select("page_id", F.size("l").alias("n_links"), F.array_join(F.transform("l", lambda a: a["href"]), " ").alias("links"))


@query("""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, try_cast(nullif(regexp_extract(url, '(\\d+)', 1), '') AS INT) AS number,
 coalesce(try_cast(nullif(regexp_extract(url, '\\.y(\\d{4})', 1), '') AS INT), 2001) AS year, nullif(regexp_extract(url, 'arxiv\\.org/abs/(\\d+\\.\\d+)', 1), '') AS preprint FROM pages""")
def url_issue_key(spark, d):
    """Keys in URLs: host, first number, year group, preprint number."""
    return _t(spark, d, "pages").select("page_id", text.found("url", "^https?://([^/]+)").alias("host"), F.regexp_extract("url", r"(\d+)", 1).try_cast("int").alias("number"), dates.group_year(F.col("url"), _AS_OF).alias("year"), text.bare_id_in_url("url").alias("preprint"))


@query("""SELECT doc_id FROM documents WHERE NOT (lang = 'de' AND regexp_matches('10.1021/' || source || 'ctv' || lpad((n_chars % 1000)::VARCHAR, 3, '0') || 'i001', 'ctv\\d{3}i\\d{3}')) AND NOT regexp_matches(coalesce(text, ''), '(?i)^\\s*erratum\\b')""")
def non_article_filter(spark, d):
    """Issue metadata and corrections left out; German documents play issue metadata."""
    doi = F.concat(F.lit("10.1021/"), "source", F.when(F.col("lang") == "de", F.concat(F.lit("ctv"), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"), F.lit("i001"))).otherwise(""))
    return _t(spark, d, "documents").filter(~text.non_article(doi, "text")).select("doc_id")


@query("""SELECT md5(text) AS key, min(doc_id) AS pos, arg_max({'l': lang, 's': source}, doc_id).l AS lang, arg_max({'l': lang, 's': source}, doc_id).s AS source FROM documents GROUP BY text""")
def last_value_first_pos(spark, d):
    """Equal keys keep the first place and the last values."""
    rows = _t(spark, d, "documents").select(F.md5("text").alias("key"), F.col("doc_id").alias("pos"), "lang", "source")
    return records.collapse(rows, ["key"])


_ISSUES = "SELECT min(year(o_orderdate))::INT AS year, o_custkey::INT AS volume, month(o_orderdate)::INT AS issue FROM orders GROUP BY o_custkey, month(o_orderdate)"


def _order_issues(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    item = F.struct(F.col("o_custkey").cast("string").alias("volume"), F.month("o_orderdate").cast("string").alias("issue"))
    return discover.registry_issues(o.select(F.lit("orders").alias("issn"), F.year("o_orderdate").alias("year"), item.alias("item")), "orders", _AS_OF, 1990)


@query(_ISSUES)
def earliest_year(spark, d):
    """Issues in their earliest year."""
    return _order_issues(spark, d)


@query(f"{_ISSUES} ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 1")
def latest_issue(spark, d):
    """The newest issue."""
    return discover.newest(_order_issues(spark, d), "year", "volume", "issue")


@query(f"SELECT *, row_number() OVER (PARTITION BY volume ORDER BY year, issue)::INT AS turn FROM ({_ISSUES})")
def backfill_order(spark, d):
    """Issues oldest first, with their turn within the volume."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("volume").orderBy("year", "issue"))
    return discover.oldest_first(_order_issues(spark, d).withColumn("turn", turn), "year", "volume", "issue")


@query("""SELECT page_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS href FROM pages WHERE regexp_matches(html, '<a href="')""")
def first_link_in_page(spark, d):
    """First link in page order."""
    rows = _t(spark, d, "pages").select("page_id", F.posexplode(markup.call("extract_links", "html")).alias("pos", "a"))
    return records.first_wins(rows.select("page_id", "pos", F.col("a.href").alias("href")), ["page_id"], "href")


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def calendar_days(spark, d):
    """Days of the months that the feed touches, joined to their half-open windows; empty ones drop out."""
    e = _t(spark, d, "events")
    months = e.select(F.year("ts").alias("y"), F.month("ts").alias("m")).distinct()
    days = months.select(F.explode(dates.month_days(F.col("y"), F.col("m"))).alias("day"))
    return e.select(F.to_date("ts").alias("day")).join(days, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts::DATE::VARCHAR AS day FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 200")
def daily_cap_200(spark, d):
    """The search page's limit of 200 a day."""
    e = _t(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "ts")
    return records.capped(e, ["day"], ["ts", "event_id"]).select("event_id", F.col("day").cast("string").alias("day"))


@query("SELECT m.month, c.category FROM (SELECT DISTINCT strftime(ts, '%Y.%m') AS month FROM events) m, (SELECT DISTINCT event_type AS category FROM events) c")
def months_x_categories(spark, d):
    """Every month with every category: two short lists of distinct values."""
    e = _t(spark, d, "events")
    months, kinds = e.select(F.date_format("ts", "yyyy.MM").alias("month")).distinct(), e.select(F.col("event_type").alias("category")).distinct()
    return months.crossJoin(kinds)


_LIBRARY_SQL = """lib AS (SELECT doc_id::VARCHAR AS key, CASE WHEN quality = 1 THEN '10.48550/arXiv.' || doc_id || '.' || doc_id ELSE '10.1000/' || doc_id END AS doi,
 CASE WHEN toxic = 1 THEN 'https://arxiv.org/abs/' || doc_id || '.' || doc_id || 'v2' ELSE '' END AS url FROM labels)"""


def _label_library(spark, d) -> DataFrame:
    number = F.concat_ws(".", "doc_id", "doc_id")
    doi = F.when(F.col("quality") == 1, F.concat(F.lit("10.48550/arXiv."), number)).otherwise(F.concat(F.lit("10.1000/"), "doc_id"))
    url = F.when(F.col("toxic") == 1, F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v2"))).otherwise("")
    return _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.lit("").alias("parent"), F.struct(doi.alias("DOI"), url.alias("url")).alias("data"))


@query(f"""WITH {_LIBRARY_SQL} SELECT 'doi' AS kind, doi AS value, max(key) AS item_key FROM lib WHERE doi <> '' GROUP BY doi
UNION ALL SELECT 'arxiv', regexp_extract(url, 'arxiv\\.org/abs/(\\d+\\.\\d+)', 1), max(key) FROM lib WHERE url <> '' GROUP BY 2""")
def library_keys(spark, d):
    """Library index: DOIs and preprint numbers to item keys."""
    return match.library_keys(_label_library(spark, d))


@query(f"""WITH {_LIBRARY_SQL} SELECT doc_id, (EXISTS (SELECT 1 FROM lib WHERE lib.doi = '10.48550/arXiv.' || doc_id || '.' || doc_id) OR EXISTS (SELECT 1 FROM lib WHERE lib.doi = '10.1000/' || doc_id)
 OR EXISTS (SELECT 1 FROM lib WHERE regexp_extract(lib.url, 'arxiv\\.org/abs/(\\d+\\.\\d+)', 1) = doc_id || '.' || doc_id)) AS collected FROM documents""")
def layered_match(spark, d):
    """Preprints in the library by any of three keys."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("arXiv:"), F.concat_ws(".", "doc_id", "doc_id")).alias("arxiv_id"), F.concat(F.lit("10.1000/"), "doc_id").alias("external_doi"))
    return match.preprints_collected(docs, match.library_keys(_label_library(spark, d))).select("doc_id", "collected")


@query(f"""WITH {_LIBRARY_SQL} SELECT lang, count(*) FILTER (WHERE hit) AS collected, count(*) FILTER (WHERE NOT hit) AS others
FROM (SELECT lang, '10.1000/' || doc_id IN (SELECT doi FROM lib) AS hit FROM documents) GROUP BY lang""")
def collected_split(spark, d):
    """Articles in and not in the library, by DOI."""
    docs = _t(spark, d, "documents").select("lang", F.concat(F.lit("10.1000/"), "doc_id").alias("doi"))
    got = match.articles_collected(docs, match.library_keys(_label_library(spark, d)))
    return got.groupBy("lang").agg(F.count_if("collected").alias("collected"), F.count_if(~F.col("collected")).alias("others"))


@query("SELECT source, doc_id FROM documents d WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id)) AND doc_id NOT IN (SELECT doc_id FROM labels)")
def new_since_last(spark, d):
    """Documents that the last report of their source, which had the labelled ones, lacks."""
    docs = _t(spark, d, "documents").select("source", "doc_id")
    old = docs.join(_t(spark, d, "labels"), "doc_id").select("source", F.array("doc_id").alias("ids"))
    return match.new_since(docs, ["source"], "doc_id", old)


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name ELSE coalesce(f.v, '') END AS abstract FROM customer
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey) f ON f.o_custkey = c_custkey""")
def fill_missing(spark, d):
    """Empty values filled from the first of another source."""
    a = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("doi"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name")).alias("abstract"))
    r = _t(spark, d, "orders").select(F.col("o_custkey").alias("doi"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("abstract"))
    return resolve.fill_abstracts(a, r).select("c_custkey", "abstract")


@query("""SELECT doc_id, n_chars, lang FROM (SELECT *, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS prio FROM documents) QUALIFY prio = min(prio) OVER (PARTITION BY n_chars)""")
def source_preference(spark, d):
    """Per group, all rows of the best source that has any: French, else English, else the rest."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return resolve.prefer([docs.filter("lang = 'fr'"), docs.filter("lang = 'en'"), docs.filter("lang IS NULL OR lang NOT IN ('fr', 'en')")], ["n_chars"])


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(try_cast(split_part(pages, '-', 1) AS BIGINT), 0), p_partkey)::INT AS place
FROM (SELECT *, CASE WHEN p_size > 25 THEN 'A' ELSE '' END || p_size || '-' || p_partkey AS pages FROM part)""")
def page_sort(spark, d):
    """Stable order by start page; unreadable pages first."""
    from pyspark.sql import Window

    p = _t(spark, d, "part").withColumn("pages", F.concat(F.when(F.col("p_size") > 25, "A").otherwise(""), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(records.start_page(F.col("pages")), "p_partkey")).alias("place"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(try_strptime(strftime(o_orderdate, '%B %-d, %Y'), '%B %d, %Y'), '%Y-%m-%d')
 WHEN 'O' THEN strftime(try_strptime(strftime(o_orderdate, '%b %-d,%Y'), '%b %d,%Y'), '%Y-%m-%d') ELSE 'undated ' || o_orderkey END AS date,
 CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN year(o_orderdate) || '-' || month(o_orderdate) ELSE '' END AS parts FROM orders""")
def normalize_date(spark, d):
    """Dates as text in several formats, and as lists of parts, made uniform."""
    t, s = F.col("o_orderdate"), F.col("o_orderstatus")
    raw = F.when(s == "F", F.date_format(t, "MMMM d, yyyy")).when(s == "O", F.concat(F.lit("(Web) : "), F.date_format(t, "MMM d,yyyy"))).otherwise(F.concat(F.lit("undated "), "o_orderkey"))
    parts = F.when(s == "F", F.array(F.year(t), F.month(t), F.dayofmonth(t))).when(s == "O", F.array(F.year(t), F.month(t))).otherwise(F.array().cast("array<int>"))
    return _t(spark, d, "orders").select("o_orderkey", dates.normal_date(raw).alias("date"), dates.from_parts(parts).alias("parts"))


@query("SELECT conv_id, string_agg(role || ' ' || turn, ', ' ORDER BY turn, role) AS authors FROM conversations WHERE role <> '' GROUP BY conv_id")
def author_join(spark, d):
    """Names of a group in order, blanks dropped."""
    people = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["role"] != "", F.concat_ws(" ", x["role"], x["turn"])))
    return _t(spark, d, "conversations").filter("role <> ''").groupBy("conv_id").agg(F.array_join(people, ", ").alias("authors"))


def _feed(spark, d) -> DataFrame:
    """Events as preprints; those of great value are in the library."""
    e = _t(spark, d, "events")
    rows = e.select(
        F.col("event_type").alias("category"), F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), F.concat(F.lit("arXiv:"), "event_id").alias("arxiv_id"), F.lit("").alias("external_doi"),
        F.concat(F.lit("Event "), "event_id").alias("title"), F.array(F.concat(F.lit("user "), "user_id"), F.lit("x")).alias("authors"), F.concat_ws("\n", "props", F.lit("[[it's]] <b> & c")).alias("abstract"),
    )
    lib = e.filter("value >= 50").select(F.col("event_id").cast("string").alias("key"), F.lit("").alias("parent"), F.struct(text.preprint_doi(F.concat(F.lit("arXiv:"), "event_id")).alias("DOI"), F.lit("").alias("url")).alias("data"))
    return match.preprints_collected(rows, match.library_keys(lib))


def _news(spark, d, rows: DataFrame) -> DataFrame:
    """What reports of events by users of number 100 and less lack."""
    old = _t(spark, d, "events").filter("user_id <= 100").select(F.col("event_type").alias("category"), F.to_date("ts").alias("day"), F.array(F.concat(F.lit("arXiv:"), "event_id")).alias("ids"))
    return match.new_since(rows, ["category", "day"], "arxiv_id", old)


def _line_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&#39;"), ('"', "&#34;"), ("[[", "$[["), ("]]", "]]$")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"'> ' || replace({x}, chr(10), chr(10) || '> ')"


_FEED_SQL = rf"""rows AS (
 SELECT event_type AS category, ts::DATE AS day, event_id AS pos, coalesce(value >= 50, false) AS collected, user_id,
 '### arXiv:' || event_id || E'\n\nLinks:\n\n- [ ] [arXiv:' || event_id || '](https://arxiv.org/abs/' || event_id || E')\n\nTitle:  Event ' || event_id || E'\n\nAuthors:  user ' || user_id || E', x\n\nAbstract:\n> [!quote]- Abstract\n\n'
  || {_line_sql("concat_ws(chr(10), props, '[[it''s]] <b> & c')")} || E'\n\n' AS md FROM events),
old AS (SELECT DISTINCT category, day FROM rows WHERE user_id <= 100),
flagged AS (SELECT rows.*, (old.day IS NOT NULL AND NOT coalesce(user_id <= 100, false)) AS fresh FROM rows LEFT JOIN old ON old.category = rows.category AND old.day = rows.day)"""


@query(rf"""WITH {_FEED_SQL} SELECT category, day::VARCHAR AS day, '# ' || day || E' preprint by arxiv_tools\n\n\n---\ntags:\n  - #' || category || '-' || day || E'\n---\n\n\n```dataview\nTASK\nfrom #' || category || '-' || day || E'\n\nWHERE completed\n\n```\n\n## collected\n\n'
 || coalesce(string_agg(E'\n' || md, '' ORDER BY pos) FILTER (WHERE collected), '') || E'\n## not collected\n\n' || coalesce(string_agg(E'\n' || md, '' ORDER BY pos) FILTER (WHERE NOT collected), '')
 || coalesce(E'\n## update\n\n' || string_agg(E'\n- [ ] [[#arXiv:' || pos || ']]', '' ORDER BY pos) FILTER (WHERE fresh) || E'\n', '') AS md FROM flagged GROUP BY category, flagged.day""")
def render_day_report(spark, d):
    """Daily reports in full: library match, news, entries, sections."""
    rows = _feed(spark, d)
    return render.day_reports(rows, _news(spark, d, rows)).withColumn("day", F.col("day").cast("string"))


@query(rf"""SELECT slug, volume, issue, '# ' || slug || ' Vol. ' || volume || ', Iss. ' || issue || E' — 2001\n\n---\ntags:\n  - #' || slug || '-v' || volume || '-i' || issue || E'\n---\n\n```dataview\nTASK\nfrom #' || slug || '-v' || volume || '-i' || issue
 || E'\n\nWHERE completed\n\n```\n\n## collected\n\n' || coalesce(string_agg(E'\n' || md, '' ORDER BY doc_id) FILTER (WHERE collected), '') || E'\n## not collected\n\n' || coalesce(string_agg(E'\n' || md, '' ORDER BY doc_id) FILTER (WHERE NOT collected), '') AS md
FROM (SELECT doc_id, source AS slug, n_chars::VARCHAR AS volume, lang AS issue, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS collected,
 '### 10.1000/' || doc_id || E'\n\nLinks:\n\n- [ ] [10.1000/' || doc_id || '](https://doi.org/10.1000/' || doc_id || E')\n\nTitle:  Document ' || doc_id || E'\n\n' || CASE WHEN lang = 'en' THEN E'\n![|700](https://x.example/' || doc_id || E'.png)\n' ELSE '' END
 || E'\nAuthors:  ' || lang || ', ' || source || E'\n\n' || CASE WHEN coalesce(text, '') <> '' THEN E'\nAbstract:\n> [!quote]- Abstract\n\n' || {_line_sql("text")} || E'\n\n' ELSE '' END AS md FROM documents) GROUP BY slug, volume, issue""")
def render_issue_report(spark, d):
    """Issue reports in full; documents of a source that agree in length and language share an issue."""
    docs = _t(spark, d, "documents").select(
        F.col("source").alias("slug"), F.col("source").alias("journal_name"), F.lit(2001).alias("year"), F.col("n_chars").cast("string").alias("volume"), F.col("lang").alias("issue"), F.col("doc_id").alias("pos"), F.concat(F.lit("10.1000/"), "doc_id").alias("doi"),
        F.concat(F.lit("Document "), "doc_id").alias("title"), F.array("lang", "source").alias("authors"), F.col("text").alias("abstract"), F.lit("").alias("date"), F.when(F.col("lang") == "en", F.concat(F.lit("https://x.example/"), "doc_id", F.lit(".png"))).otherwise("").alias("toc_image_url"),
    )
    return render.issue_reports(match.articles_collected(docs, match.library_keys(_label_library(spark, d)))).select("slug", "volume", "issue", "md")


_PLAN_SQL = """k AS (SELECT DISTINCT o_orderstatus AS s, 'j' AS slug, o_custkey::INT AS volume, month(o_orderdate)::INT AS issue FROM orders),
processed AS (SELECT DISTINCT slug, volume, issue FROM k WHERE s = 'F'), valid AS (SELECT DISTINCT slug, volume, issue FROM k WHERE s = 'O'), disc AS (SELECT DISTINCT slug, volume, issue FROM k)"""


def _plan_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed, validly reported and discovered issues: finished, open and all orders'."""
    keys = _t(spark, d, "orders").select("o_orderstatus", F.lit("j").alias("slug"), F.col("o_custkey").cast("int").alias("volume"), F.month("o_orderdate").alias("issue"))
    pick = lambda c: keys.filter(c).drop("o_orderstatus").distinct()
    return pick("o_orderstatus = 'F'"), pick("o_orderstatus = 'O'"), pick("true")


@query(f"""WITH {_PLAN_SQL} SELECT 'rebuild' AS what, * FROM (SELECT * FROM processed EXCEPT SELECT * FROM valid) UNION ALL SELECT 'todo', * FROM (SELECT * FROM disc EXCEPT SELECT * FROM processed)""")
def todo_issues(spark, d):
    """Issues to rebuild and to do."""
    processed, valid, found = _plan_inputs(spark, d)
    again, new = incremental.rebuild(processed, valid), incremental.todo(incremental.candidates(found, True, []), processed)
    return again.select(F.lit("rebuild").alias("what"), *incremental.KEY).unionByName(new.select(F.lit("todo").alias("what"), *incremental.KEY))


@query(f"WITH {_PLAN_SQL} SELECT * FROM processed UNION SELECT * FROM disc")
def next_state(spark, d):
    """State after all that was to do is done."""
    processed, _, found = _plan_inputs(spark, d)
    return incremental.next_state(processed, incremental.todo(found, processed))


@query(f"WITH {_FEED_SQL} SELECT category, day::VARCHAR AS day, string_agg('arXiv:' || pos, ' ' ORDER BY NOT collected, pos) AS ids, true AS ok FROM rows GROUP BY category, rows.day")
def report_ids(spark, d):
    """Ids read back from rendered reports."""
    got = match.report_ids(render.day_reports(_feed(spark, d)))
    return got.select("category", F.col("day").cast("string").alias("day"), F.array_join("ids", " ").alias("ids"), "ok")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    """Each key of a file stream once, through the streaming engine, to a file sink."""
    events = _t(spark, d, "events")
    root = f"{shared(spark)}/first-seen-{uuid.uuid4().hex}"
    rows = feed.first_seen(feed.stream(spark, f"{d}/events.parquet", events.schema).select("user_id", "event_type"), ["user_id", "event_type"])
    feed.run_available(rows, f"{root}/checkpoint", lambda df, n: df.write.parquet(f"{root}/out/batch={n}"))
    events.select("user_id", "event_type").limit(0).write.parquet(f"{root}/out/batch=none")  # an empty stream has no batch
    return spark.read.schema("user_id long, event_type string").parquet(f"{root}/out/batch=*")
