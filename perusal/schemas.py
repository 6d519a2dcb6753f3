"""Schemas of landed payloads (bronze), parsed records (silver) and state, as DDL."""

RAW_PREPRINT = "category string, day date, html string"
RAW_REGISTRY = "issn string, year int, page_no int, json string"
RAW_ACS_TOC = "acs_code string, volume string, issue string, html string"
RAW_ACS_LIST = "acs_code string, group_url string, is_landing boolean, html string"
RAW_AIP_TOC = "journal_slug string, volume string, issue string, url string, html string"
RAW_AIP_ABSTRACT = "article_id string, attempt int, status int, body string"
RAW_LIBRARY = "key string, parent string, data struct<DOI: string, url: string>"
REPORTS = "path string, md string"
PROCESSED = "slug string, volume int, issue int"

#: One registry page; cursor pages of a year are landed in page_no order.
REGISTRY_PAGE = (
    "message struct<`next-cursor`: string, items: array<struct<DOI: string, title: array<string>, volume: string, issue: string, "
    "page: string, author: array<struct<given: string, family: string>>, abstract: string, "
    "`published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>>>>"
)
