"""Categories and journals: TOML where a file is given and readable, built-in defaults else."""

from __future__ import annotations

import tomllib
from copy import deepcopy

#: Search parameters that all preprint categories share; fixed values.
SEARCH = {
    "advanced": "", "terms-0-term": "", "terms-0-operator": "AND", "terms-0-field": "title", "classification-physics": "y", "classification-physics_archives": "quant-ph",
    "classification-include_cross_list": "include", "date-filter_by": "date_range", "date-year": "", "date-from_date": "2025-02-01", "date-to_date": "2025-02-02",
    "date-date_type": "submitted_date_first", "abstracts": "show", "size": "200", "order": "submitted_date",
}
#: Categories and journals that are built in; fixed values.
CATEGORIES = {c: SEARCH | {"classification-physics_archives": c} for c in ("quant-ph", "hep-ex", "hep-lat", "hep-ph", "hep-th")}
CATEGORIES["chem-ph"] = SEARCH | {"classification-physics_archives": "physics", "terms-1-operator": "AND", "terms-1-term": "physics.chem-ph", "terms-1-field": "all"}
JOURNALS = {
    "jctc": {"name": "Journal of Chemical Theory and Computation", "issn": "1549-9618", "slug": "jctc", "acs_code": "jctcce"},
    "jcp": {"name": "Journal of Chemical Physics", "issn": "0021-9606", "slug": "jcp", "provider": "aip"},
}


def _section(path: str | None, name: str) -> dict[str, dict[str, str]]:
    try:
        with open(path, "rb") as f:
            return {k: {a: str(b) for a, b in v.items()} for k, v in tomllib.load(f).get(name, {}).items()}
    except (TypeError, OSError, ValueError, AttributeError):
        return {}


def categories(path: str | None = None) -> dict[str, dict[str, str]]:
    return _section(path, "arxiv") or deepcopy(CATEGORIES)


def journals(path: str | None = None) -> dict[str, dict[str, str]]:
    """Journals of a file; without a readable one the built-in two."""
    return _section(path, "journals") or deepcopy(JOURNALS)


def pick(table: dict[str, dict], key: str, what: str) -> dict[str, str]:
    if key not in table:
        raise RuntimeError(f"{what} '{key}' not supported. Available: {sorted(table)}")
    return table[key]


#: Where a day's search is asked for; fixed value.
SEARCH_URL = "https://arxiv.org/search/advanced?"


def search_parameters(params: dict[str, str], start: str, stop: str) -> dict[str, str]:
    """Parameters of one day's search, [start, stop)."""
    return params | {"date-from_date": start, "date-to_date": stop}
