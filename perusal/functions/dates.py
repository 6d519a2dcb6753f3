"""Date columns: free-text dates, date parts, calendars."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Formats of dates on issue pages, tried in order; fixed values.
FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d,yyyy", "MMM d,yyyy", "yyyy-M-d")


def normal_date(x: Column) -> Column:
    """``yyyy-MM-dd`` after a label such as ``(Web) :`` is taken off; unreadable text stays as it is."""
    s = strip(F.regexp_replace(x, r"(?U)^\(?\w*\)?\s*:\s*", ""))
    parsed = F.coalesce(*[F.call_function("try_to_date", s, F.lit(f)) for f in FORMATS])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), s)


def from_parts(parts: Column) -> Column:
    """Three parts zero-padded, fewer as they are, none as ''."""
    whole = F.format_string("%d-%02d-%02d", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    return F.coalesce(F.when(F.size(parts) == 3, whole).otherwise(F.array_join(F.transform(parts, lambda p: p.cast("string")), "-")), F.lit(""))


def leading_int(x: Column) -> Column:
    """The integer before the first hyphen, null where there is none."""
    return F.expr(f"try_cast(trim(split({_name(x)}, '-', -1)[0]) AS INT)") if isinstance(x, str) else F.get(F.split(x, "-", -1), F.lit(0)).try_cast("int")


def _name(x: str) -> str:
    return f"`{x}`"


def month_days(year: Column, month: Column) -> Column:
    """Array of the days of a month."""
    first = F.make_date(year, month, F.lit(1))
    return F.sequence(first, F.last_day(first))


def group_year(url: Column, as_of: datetime.date) -> Column:
    """Year of an issue-list group URL (``.y2025``), else that of ``as_of``."""
    return F.coalesce(F.regexp_extract(url, r"\.y(\d{4})", 1).try_cast("int"), F.lit(as_of.year))


def parse_month(text: str, as_of: datetime.date) -> tuple[int, int]:
    """``YYYY.MM``; 1949.10 stands for the month of ``as_of``."""
    if text == "1949.10":
        return as_of.year, as_of.month
    year, month = text.split(".")[:2]
    return int(year), int(month)
