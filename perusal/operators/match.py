"""Matching against a reference library, and differences to earlier reports.

Disjunctive matches are exploded into (kind, value) keys and equi-joined: an OR of equalities
would plan as a nested-loop join. The library side is broadcast only by Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def library_keys(items: DataFrame) -> DataFrame:
    """(kind, value, item_key) of top-level items: DOIs and preprint numbers in URLs; of equal values
    the last key (in key order) counts, empty values not at all."""
    top = items.filter("parent IS NULL OR parent = ''")
    pairs = F.array(F.struct(F.lit("doi").alias("kind"), F.col("data.DOI").alias("value")), F.struct(F.lit("arxiv").alias("kind"), text.bare_id_in_url("data.url").alias("value")))
    rows = top.select("key", F.inline(pairs)).filter("value IS NOT NULL AND value <> ''")
    return rows.groupBy("kind", "value").agg(F.max("key").alias("item_key"))


def with_flag(df: DataFrame, keys: list[str], probes: DataFrame, library: DataFrame, flag: str = "collected") -> DataFrame:
    """df with a flag: whether any probe (keys, kind, value) of its key is in the library."""
    hit = probes.filter("value IS NOT NULL AND value <> ''").join(library.select("kind", "value"), ["kind", "value"], "left_semi").select(*keys).distinct()
    return df.join(hit.withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def preprints_collected(df: DataFrame, library: DataFrame, flag: str = "collected") -> DataFrame:
    """Preprints by their preprint DOI, their publisher's DOI or their number in a library URL."""
    probes = F.array(
        F.struct(F.lit("doi").alias("kind"), text.preprint_doi("arxiv_id").alias("value")), F.struct(F.lit("doi").alias("kind"), F.col("external_doi").alias("value")), F.struct(F.lit("arxiv").alias("kind"), text.bare_id("arxiv_id").alias("value"))
    )
    return with_flag(df, ["arxiv_id"], df.select("arxiv_id", F.inline(probes)), library, flag)


def articles_collected(df: DataFrame, library: DataFrame, flag: str = "collected", ignore_case: bool = False) -> DataFrame:
    norm = F.lower if ignore_case else (lambda x: x)
    lib = library.filter("kind = 'doi'").select("kind", norm(F.col("value")).alias("value"))
    return with_flag(df, ["doi"], df.select("doi", F.lit("doi").alias("kind"), norm(F.col("doi")).alias("value")), lib, flag)


def new_since(df: DataFrame, report: list[str], key: str, old: DataFrame) -> DataFrame:
    """Rows of df whose key an earlier valid report lacks. ``old``: (report columns, ids). Reports that
    are not in ``old`` are first runs and have no news."""
    known = old.select(*report, F.explode_outer("ids").alias(key))
    return df.join(old.select(*report).distinct(), report, "left_semi").join(known, [*report, key], "left_anti")


def report_ids(reports: DataFrame, kind: str = "arxiv") -> DataFrame:
    """(other columns, ids, ok) of report texts: ids of headings, then of ticked update links,
    repeats kept; ids is null where the skeleton is broken."""
    mark = r"arXiv:\S+" if kind == "arxiv" else r"10\.\S+"
    head = F.regexp_extract_all("md", F.lit(rf"(?m)^###\s*({mark})"), F.lit(1))
    ticked = F.regexp_extract_all("md", F.lit(rf"-\s*\[x\]\s*\[\[#({mark})\]\]"), F.lit(1))
    ok = skeleton_ok("md")
    return reports.withColumns({"ids": F.when(ok, F.concat(head, ticked)), "ok": F.coalesce(ok, F.lit(False))}).drop("md")


def skeleton_ok(md: str):
    c = F.col(md)
    return c.contains("## collected") & c.contains("## not collected") & c.contains("### ")


def report_entries(reports: DataFrame) -> DataFrame:
    """Entries of preprint reports, (other columns, pos, arxiv_id, title, authors, abstract). The last
    entry of a report without an update section has no end mark and is lost, as it always was."""
    rest = [c for c in reports.columns if c != "md"]
    entry = F.regexp_extract_all("md", F.lit(r"(?s)###\s*(arXiv:\S+.*?)(?=###\s*arXiv:|## update)"), F.lit(0))
    rows = reports.select(*rest, F.posexplode(entry).alias("pos", "e"))
    body = F.regexp_extract("e", r"(?s)Abstract:\s*> \[!quote\]- Abstract\s*>\s*(.+?)(?=###\s*arXiv:|## update|\z)", 1)
    people = F.filter(F.transform(F.split(F.regexp_extract("e", r"Authors:\s*(.+)", 1), ",", -1), text.strip), lambda a: a != "")
    rows = rows.select(*rest, "pos", F.regexp_extract("e", r"^###\s*(arXiv:\S+)", 1).alias("arxiv_id"), text.strip(F.regexp_extract("e", r"Title:\s*(.+)", 1)).alias("title"), people.alias("authors"), text.strip(F.regexp_replace(text.strip(body), r">\s*", " ")).alias("abstract"))
    from .records import collapse

    return collapse(rows, [*rest, "arxiv_id"])
