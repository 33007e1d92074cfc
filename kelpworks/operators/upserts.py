"""Upserts, replacements and deletes as functions from snapshots to snapshots.

Each gives the next state of a table; nothing is changed in place. Keys are compared null-safe only where
said; rows with a null key are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame | None, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, with the greatest version; later columns decide among equal versions.

    A partial aggregate on the map side leaves one row per key and task, so a hot key costs nothing.
    """
    rows = old if new is None else old.unionByName(new)
    rows = rows.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    rest = [c for c in rows.columns if c not in keys]
    order = version + [c for c in rest if c not in version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_m"))
    return best.select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest)).select(*rows.columns)


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows whose key is in `new` go, the new ones come (structural nodes of a file, rows of a partition)."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_edges(old: DataFrame, new: DataFrame, file: str = "from_file") -> DataFrame:
    """Edges that leave a file of the batch are replaced; of equal (from, to, kind) one stays."""
    return replace_by(old, new, file).dropDuplicates(["from_id", "to_id", "kind"])


def replace_edges_of_file(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Edges that touch the file go, the new ones come; of equal (from, to, kind) one stays."""
    rest = old.filter((F.coalesce("from_file", F.lit("")) != path) & (F.coalesce("to_file", F.lit("")) != path))
    return rest.unionByName(new.select(*old.columns)).dropDuplicates(["from_id", "to_id", "kind"])


def delete_keys(table: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """The rows whose key is not in `gone`; a key that is not there is no error."""
    g = gone.select(F.col(gone_key or key).alias("_gone")).distinct()
    return table.join(g, F.col(key) == F.col("_gone"), "left_anti")


def delete_files(paths: DataFrame, files: DataFrame, **derived: DataFrame) -> dict[str, DataFrame]:
    """Every table without what belongs to the paths: files by path, nodes by file_id, edges by either end, others by file."""
    out = {"files": delete_keys(files, paths, "path")}
    ids = files.join(paths.select("path").distinct(), "path", "left_semi")
    for name, df in derived.items():
        if "file_id" in df.columns:
            out[name] = delete_keys(df, ids, "file_id")
        elif "from_file" in df.columns:
            out[name] = delete_keys(delete_keys(df, paths, "from_file", "path"), paths, "to_file", "path")
        else:
            out[name] = delete_keys(df, paths, "file", "path")
    return out
