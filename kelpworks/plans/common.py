"""Views that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import slashed
from ..sources.tables import load

FILES = r"f AS (SELECT DISTINCT file_id, repo, replace(path, '\', '/') AS path, hash, lower(language) AS language, size, modified, content FROM files)"
EDGES = r"""e AS (
  SELECT DISTINCT from_id, to_id, kind, confidence, regexp_extract(from_id, '^(.*)::(.*)::(\d+)$', 1) AS from_file, regexp_extract(from_id, '^(.*)::(.*)::(\d+)$', 2) AS from_name,
         regexp_extract(to_id, '^(.*)::(.*)::(\d+)$', 1) AS to_file, regexp_extract(to_id, '^(.*)::(.*)::(\d+)$', 2) AS to_name
  FROM edges WHERE from_id <> '' AND to_id <> '')"""
SYMBOLS = "s AS (SELECT DISTINCT symbol_id, name, kind, file, range_start, range_end, signature, parent_id FROM symbols WHERE deleted_at IS NULL)"
NODES = "n AS (SELECT DISTINCT ON (id) id, file_id, kind, label, path_joined, byte_start, byte_end, line_start, line_end, parent_id, depth FROM structural_nodes)"


def files_view(spark, folder, *columns):
    cols = columns or ("file_id", "repo", "path", "hash", "language", "size", "modified", "content")
    df = load(spark, folder, "files", *cols).dropDuplicates(["file_id"] if "file_id" in cols else list(cols))
    if "path" in cols:
        df = df.withColumn("path", slashed(F.col("path")))
    return df.withColumn("language", F.lower("language")) if "language" in cols else df


def symbols_view(spark, folder):
    return load(spark, folder, "symbols").filter("deleted_at IS NULL").select("symbol_id", "name", "kind", "file", "range_start", "range_end", "signature", "parent_id").distinct()


def nodes_view(spark, folder):
    return load(spark, folder, "structural_nodes").dropDuplicates(["id"])
