"""HTML payloads to arrays of records: Arrow-batched functions over a small element tree.

Pages are not well-formed XML, so Spark's xpath functions cannot read them. One pass per page
returns every field of every record as strings; anything that regular expressions can derive
from them is left to column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NESTS_NOT = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = {"ul", "ol", "table"}


class Element:
    """A tag with attributes, children and, among them, its text."""

    def __init__(self, name: str = "", attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []
        self.classes = set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Element):
                yield x
                todo.extend(reversed(x.children))

    def pieces(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in ("script", "style"):
                todo.extend(reversed(x.children))

    def text(self, between: str | None = None) -> str:
        """All text; with ``between``, stripped pieces joined by it."""
        if between is None:
            return "".join(self.pieces()).strip()
        return between.join(p for p in (s.strip() for s in self.pieces()) if p)

    def all(self, *classes: str, name: str | None = None, has: str | None = None) -> Iterator[Element]:
        for x in self.walk():
            if x.classes.issuperset(classes) and (name is None or x.name == name) and (has is None or has in x.attrs):
                yield x

    def first(self, *classes: str, name: str | None = None, has: str | None = None) -> Element | None:
        return next(self.all(*classes, name=name, has=has), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element()
        self.stack = [self.root]

    def handle_starttag(self, name, attrs):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in _NESTS_NOT.get(name, ()):
                del self.stack[i:]
                break
            if self.stack[i].name in _LISTS or name == "p":
                break
        x = Element(name, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(x)
        if name not in _VOID:
            self.stack.append(x)

    def handle_startendtag(self, name, attrs):
        self.stack[-1].children.append(Element(name, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, name):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def preprints(html: str | None) -> list[dict]:
    """Records of a preprint search result; an item without its title block is none."""
    out = []
    for item in tree(html).all("arxiv-result"):
        anchor = (item.first("list-title") or Element()).first(name="a")
        if anchor is None:
            continue
        part = lambda c: x.text() if (x := item.first(c)) else ""  # noqa: B023, E731
        row = {"arxiv_id": anchor.text(), "title": part("title"), "abstract": part("abstract-full"), "external_doi": "", "external_doi_url": "", "journal_ref": "", "comments": ""}
        row["authors"] = [a.text() for a in (item.first("authors") or Element()).all(name="a")]
        row["subjects"] = [t.text() for t in item.all("tag") if t.classes & {"is-link", "is-grey"}]
        for t in item.all("tag", "is-light", "is-size-7"):
            if (link := t.first(name="a")) is not None:
                row["external_doi"], row["external_doi_url"] = t.text(), link.attrs.get("href", "")
        for note in item.all("comments"):
            said = note.text(" ")
            for key, label in (("journal_ref", "Journal ref:"), ("comments", "Comments:")):
                if said.startswith(label):
                    row[key] = said[len(label) :].strip()
        out.append(row)
    return out


def acs_items(html: str | None) -> list[dict]:
    """Raw fields of each item of an ACS table of contents."""
    out = []
    for item in tree(html).all("issue-item", "clearfix", name="div"):
        title = next((a for h in item.all("issue-item_title") if h.name in ("h3", "h4") for a in h.all(name="a")), None)
        if title is None:
            continue
        names = []
        for a in item.all("hlFld-ContribAuthor", name="span"):
            parts = [x.text("") if (x := a.first(name=n)) else "" for n in ("given-names", "surname")]
            names.append(" ".join(parts).strip())
        img = next((i for d in item.all("issue-item_img", name="div") for i in d.all("lazy", name="img")), None)
        info, abstract = item.first("issue-item_info"), item.first("hlFld-Abstract", name="span")
        volume = info.first("issue-item_vol-num") if info else None
        out.append(
            {
                "shown": item.text(" "), "href": title.attrs.get("href", ""), "title": title.text(" "), "authors": [n for n in names if n],
                "abstract": abstract.text(" ") if abstract else "", "image": img.attrs.get("data-src", "") if img else "",
                "volume": volume.text("") if volume else "", "info": info.text(" ") if info else "",
            }
        )
    return out


def aip_items(html: str | None) -> list[dict]:
    """Raw fields of each item of an AIP issue page."""
    out = []
    for item in tree(html).all("al-article-items"):
        title = next((a for h in item.all("item-title") for a in h.all(name="a")), None)
        if title is None:
            continue
        cited = next((a.attrs["href"] for c in item.all("citation-label") for a in c.all(name="a", has="href") if "doi.org/10." in a.attrs["href"]), "")
        marked, img = item.first(has="data-doi"), next((i for d in item.all("issue-featured-image") for i in d.all(name="img")), None)
        citation, link = item.first("ww-citation-primary"), item.first("js-show-abstract", has="data-articleid")
        names = [n.text(" ") for a in item.all("al-authors-list") for n in a.all("wi-fullname")]
        out.append(
            {
                "title": title.text(" "), "href": title.attrs.get("href", ""), "cited": cited, "marked": marked.attrs["data-doi"].strip() if marked else "",
                "authors": [n for n in names if n], "src": img.attrs.get("src", "") if img else "", "data_src": img.attrs.get("data-src", "") if img else "",
                "citation": citation.text(" ") if citation else "", "article_id": link.attrs["data-articleid"].strip() if link else "",
            }
        )
    return out


def links(html: str | None) -> list[dict]:
    return [{"href": a.attrs.get("href", ""), "text": a.text(" ")} for a in tree(html).all(name="a")]


def aip_abstract(html: str | None) -> str:
    """Text of an abstract fragment without headings that say just "abstract"."""
    root = tree(html)
    todo = [root]
    while todo:
        x = todo.pop()
        heading = lambda c: isinstance(c, Element) and (c.name in ("h1", "h2", "h3") or "title" in c.classes) and c.text(" ").lower() == "abstract"
        x.children = [c for c in x.children if not heading(c)]
        todo.extend(c for c in x.children if isinstance(c, Element))
    return re.sub(r"\s+", " ", unescape(root.text(" "))).strip()


def _udf(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([f(x) for x in b], dtype=object)

    return run


_STR = "array<struct<{}>>"
KINDS: dict[str, tuple[Callable, str]] = {
    "parse_arxiv_html": (preprints, _STR.format("arxiv_id string, title string, authors array<string>, abstract string, external_doi string, external_doi_url string, journal_ref string, comments string, subjects array<string>")),
    "parse_acs_toc": (acs_items, _STR.format("shown string, href string, title string, authors array<string>, abstract string, image string, volume string, info string")),
    "parse_aip_toc": (aip_items, _STR.format("title string, href string, cited string, marked string, authors array<string>, src string, data_src string, citation string, article_id string")),
    "extract_links": (links, _STR.format("href string, text string")),
    "html_unescape": (lambda x: unescape(x or ""), "string"),
    "clean_aip_abstract": (aip_abstract, "string"),
    "clean_jats": (lambda x: re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?jats:p[^>]*>", " ", x or "")))).strip(), "string"),
}


def call(name: str, x: Column | str) -> Column:
    return _udf(*KINDS[name])(x)


def register(spark: SparkSession) -> None:
    """Make the parsers callable from SQL by their names."""
    for name, (f, kind) in KINDS.items():
        spark.udf.register(name, _udf(f, kind))
