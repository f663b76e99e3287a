"""Named queries built from the operators, with their SQL counterparts."""

from importlib import import_module

MODULES = ("skew_and_nested", "crawl", "site")
FLAGSHIP = "page_overview"


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict:
    return _all("SQL")
