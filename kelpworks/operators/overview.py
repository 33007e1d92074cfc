"""Counts and listings about the whole index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paths that count as entry points of a repository.
ENTRY_POINTS = ("src/main.rs", "src/lib.rs", "main.rs", "lib.rs", "src/index.ts", "src/index.js", "src/index.py")
#: Names of the introduction, in order of preference.
README_NAMES = ("README.md", "README", "readme.md")


def language_counts(files: DataFrame, unknown: str | None = None) -> DataFrame:
    """`language, files`; files without a language are left out, or counted as `unknown`."""
    rows = files.filter("language IS NOT NULL") if unknown is None else files.withColumn("language", F.coalesce("language", F.lit(unknown)))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def largest(files: DataFrame, n: int = 12) -> DataFrame:
    return files.filter("size IS NOT NULL").orderBy(F.desc("size"), "path").limit(n).select("path", "size")


def entry_points(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(F.col(path).isin(*ENTRY_POINTS)).select("path")


def readme_excerpt(files: DataFrame, lines: int = 10, path: str = "path") -> DataFrame:
    """`excerpt`: the first lines of the preferred introduction at the root; no row if there is none."""
    order = reduce(lambda acc, iv: acc.when(F.col(path) == iv[1], iv[0]), enumerate(README_NAMES), F.when(F.lit(False), 0))
    best = files.filter(F.col(path).isin(*README_NAMES) & F.col("content").isNotNull()).orderBy(order).limit(1)
    return best.select(F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n").alias("excerpt"))


def tree(files: DataFrame, depth: int = 3, most: int = 500) -> DataFrame:
    """`pos, level, name`: the tree of the first paths in order, each folder or file once, down to `depth`.

    The listing is a top-k report of `most` paths, so its window is over one small group.
    """
    first = files.select("path").distinct().orderBy("path").limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy("path")
    rows = first.select("path", F.split("path", "/").alias("parts")).withColumn("prev", F.coalesce(F.lag("parts").over(w), F.array().cast("array<string>"))).withColumn("row", F.row_number().over(w))
    same = F.aggregate(F.zip_with("parts", "prev", lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["on"] & x).alias("on"), (acc["n"] + (acc["on"] & x).cast("int")).alias("n")))["n"]
    rows = rows.select("row", "parts", same.alias("common"))
    parts = rows.select("row", "common", F.posexplode(F.slice("parts", 1, depth)).alias("level", "name"))
    return parts.filter(F.col("level") >= F.col("common")).select((F.col("row") * 100 + F.col("level")).alias("pos"), "level", "name")


def status(**tables: DataFrame) -> DataFrame:
    """`tab, rows` of each table."""
    return reduce(lambda a, b: a.unionByName(b), (df.agg(F.lit(n).alias("tab"), F.count(F.lit(1)).alias("rows")) for n, df in tables.items()))
