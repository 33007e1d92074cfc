"""Choosing how a request is answered: locators, plans and the ask router."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidRequest(ValueError):
    """A request that no plan can answer."""


@dataclass(frozen=True)
class Locator:
    """kind is any, heading, file or name."""

    kind: str
    path: tuple[str, ...] = ()
    file: str | None = None
    name: str | None = None
    raw: str = field(default="", compare=False)


def parse_locator(raw: str) -> Locator:
    """* or any; /a/b or #a; file://dir/name.ext/a/b (the file ends at the last part with a dot); else a name."""
    text = raw.strip()
    if text in ("*", "any"):
        return Locator("any", raw=raw)
    if text[:1] in ("/", "#"):
        body = text[1:]
        return Locator("heading", tuple(body.split("/")) if body else (), raw=raw)
    if text.startswith("file://"):
        parts = text[len("file://") :].split("/")
        dotted = [i for i, p in enumerate(parts) if "." in p]
        end = (dotted[-1] if dotted else 0) + 1
        return Locator("file", tuple(p for p in parts[end:] if p), "/".join(parts[:end]), raw=raw)
    return Locator("name", name=text, raw=raw)


def locate_plan(query: str | None, path: str | None, has_vectors: bool = True) -> str:
    """structural_path, scoped_semantic, semantic (up to two words), hybrid or structural_search."""
    if query is None and path is None:
        raise InvalidRequest("either a query or a path is needed")
    if query is None:
        return "structural_path"
    if path is not None:
        return "scoped_semantic"
    if not has_vectors:
        return "structural_search"
    return "semantic" if len(query.split()) <= 2 else "hybrid"


def check_locate(query: str | None, path: str | None, file: str | None = None, files: list[str] | None = None) -> None:
    locate_plan(query, path)
    if file is not None and files:
        raise InvalidRequest("either file or files can be given")
    if query is not None and path is not None and file is None and parse_locator(path).kind != "file":
        raise InvalidRequest("a scoped search needs a file")


def is_identifier(q: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", q.strip()) is not None


def is_locator(q: str) -> bool:
    return any(mark in q for mark in (":L", "/", "*", "."))


def choose_strategy(q: str, mode: str = "auto") -> str:
    if mode in ("smart", "semantic"):
        return mode
    if is_identifier(q):
        return "definition"
    return "locate" if mode == "structural" or is_locator(q) else "semantic"


def strategy_column(q: Column) -> Column:
    """choose_strategy in mode auto, for a log of queries."""
    locator = q.contains(":L") | q.contains("/") | q.contains("*") | q.contains(".")
    return F.when(F.trim(q).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "definition").when(locator, "locate").otherwise("semantic")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))
