"""String columns: identifiers, markup cleaning, quoting. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as the sources' own tools see them, non-breaking ones included.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without blanks of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), BLANKS, " "))


def found(x: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, null where there is none."""
    return F.nullif(F.regexp_extract(_c(x), pattern, group), F.lit(""))


def bare_id(arxiv_id: Column | str) -> Column:
    return strip(F.replace(_c(arxiv_id), F.lit("arXiv:"), F.lit("")))


def preprint_doi(arxiv_id: Column | str) -> Column:
    return F.concat(F.lit("10.48550/arXiv."), bare_id(arxiv_id))


def preprint_url(arxiv_id: Column | str) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), bare_id(arxiv_id))


def doi_url(doi: Column | str) -> Column:
    return F.concat(F.lit("https://doi.org/"), _c(doi))


def bare_id_in_url(url: Column | str) -> Column:
    """Preprint number in a URL without its version; null if it has none."""
    return found(url, r"arxiv\.org/abs/(\d+\.\d+)")


def without_resolver(doi: Column | str) -> Column:
    return F.regexp_replace(_c(doi), r"^https?://(?:dx\.)?doi\.org/", "")


def non_article(doi: Column | str, title: Column | str) -> Column:
    """Issue metadata by its DOI, corrections by their title."""
    return F.coalesce(_c(doi), F.lit("")).rlike(r"ctv\d{3}i\d{3}") | F.coalesce(_c(title), F.lit("")).rlike(r"(?iU)^\s*erratum\b")


def challenged(html: Column | str, head: int = 5000) -> Column:
    """Whether the head of a landed page is that of a bot challenge."""
    return F.left(F.coalesce(_c(html), F.lit("")), F.lit(head)).rlike("Just a moment|cf-chl|Cloudflare")


def waiting(html: Column | str) -> Column:
    """Whether a landed page is the waiting page that the ACS site serves; a page that only names the
    service behind it is none."""
    return F.coalesce(_c(html), F.lit("")).contains("Just a moment")


def absolute(href: Column | str, base: str) -> Column:
    return F.when(_c(href).startswith("http") | (_c(href) == ""), _c(href)).otherwise(F.concat(F.lit(base), _c(href)))


def query_string(params: dict[str, Column | str]) -> Column:
    """Form-encoded parameters in the given order, with an encoded plus put back."""
    parts = [F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()]
    return F.replace(F.concat_ws("&", *parts), F.lit("%2B"), F.lit("+"))


def escaped(line: Column) -> Column:
    """HTML-escaped, then wiki-link brackets made harmless."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"), ("[[", "$[["), ("]]", "]]$")):
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def quoted(abstract: Column | str) -> Column:
    """Every line of an abstract as a quoted one, each after a line break."""
    lines = F.split(F.coalesce(_c(abstract), F.lit("")), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\n> "), escaped(x))), "")
