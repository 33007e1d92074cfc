"""The query catalogue."""

from __future__ import annotations

import importlib

MODULES = ("upkeep", "text_queries", "retrieval_queries", "graph_queries", "locate_queries", "change_queries")


def _catalog():
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.catalog")


def all_queries() -> dict:
    return dict(_catalog().QUERIES)


def all_sql() -> dict:
    return dict(_catalog().SQL)
