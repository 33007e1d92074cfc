"""The tables' columns, by schema version, and the steps from one version to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2
TABLES = {
    "files": "file_id bigint, path string, hash string, language string, size bigint, modified timestamp, content string",
    "symbols": "symbol_id string, name string, kind string, file string, range_start bigint, range_end bigint, signature string, parent_id string",
    "chunks": "chunk_id string, file string, range_start bigint, range_end bigint, text string, kind string, language string",
    "imports": "file string, language string, raw string, range_start bigint, range_end bigint, target_file string, items array<string>",
    "edges": "from_id string, to_id string, kind string, confidence string, from_file string, from_name string, to_file string, to_name string, from_start bigint, to_start bigint",
    "nodes": "id bigint, file_id bigint, kind string, label string, path_joined string, path array<string>, byte_start bigint, byte_end bigint, line_start int, line_end int, parent_id bigint, depth int",
    "vectors": "chunk_id string, embedding array<float>, model string, dimension int",
    "memories": "id string, scope string, content string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
}


def _edge_parts(df: DataFrame) -> DataFrame:
    """1 to 2: edges carry the parts of their ids as columns."""
    from .operators.graph import with_parts

    return with_parts(df.select("from_id", "to_id", "kind", "confidence"))


#: (table, version reached) -> step; applied in order, each at most once.
STEPS: dict[tuple[str, int], Callable[[DataFrame], DataFrame]] = {("edges", 2): _edge_parts}


def conform(table: str, df: DataFrame) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others are left out."""
    parts = _split(TABLES[table])
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in parts))


def migrate(table: str, df: DataFrame, version: int) -> DataFrame:
    """A table written at `version`, as the current version has it; running it on a current table changes nothing."""
    for v in range(version + 1, VERSION + 1):
        if (table, v) in STEPS:
            df = STEPS[table, v](df)
    return conform(table, df)


def _split(text: str) -> list[tuple[str, str]]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += c
    return out
