"""Finding structural nodes by path or by query, and turning them into spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from .retrieval import bm25, hybrid, top_k
from .routing import Locator, parse_locator
from .text import bytes_of

ELLIPSIS = "\n... (truncated)"


def by_path(nodes: DataFrame, path_joined: str, file_id: int | None = None) -> DataFrame:
    """The node with exactly this path, of the first file and the least depth."""
    rows = nodes.filter(F.col("path_joined") == path_joined)
    rows = rows if file_id is None else rows.filter(F.col("file_id") == file_id)
    return rows.orderBy("file_id", "depth", "id").limit(1)


def ranked_by_path(nodes: DataFrame, wanted: str, most: int = 1) -> DataFrame:
    """Nodes by an exact path (1.0), by a path or label that is the last part (0.9), or by a part of a path (0.8)."""
    last = wanted.rsplit("/", 1)[-1]
    score = F.when(F.col("path_joined") == wanted, 1.0).when((F.col("label") == last) | F.col("path_joined").endswith("/" + wanted), 0.9).when(F.col("path_joined").contains(wanted), 0.8)
    return nodes.withColumn("score", score).filter("score IS NOT NULL").orderBy(F.desc("score"), "file_id", "depth", "id").limit(most)


def resolve_locator(nodes: DataFrame, files: DataFrame, locator: Locator | str, most: int = 1) -> DataFrame:
    loc = parse_locator(locator) if isinstance(locator, str) else locator
    if loc.kind == "any":
        return nodes.withColumn("score", F.lit(1.0)).limit(0)
    if loc.kind == "file":
        inside = nodes.join(files.filter(F.col("path") == loc.file).select("file_id"), "file_id", "left_semi")
        return ranked_by_path(inside, "/".join(loc.path), most) if loc.path else inside.withColumn("score", F.lit(1.0)).orderBy("depth", "byte_start", "id").limit(most)
    return ranked_by_path(nodes, loc.name if loc.kind == "name" else "/".join(loc.path), most)


def searchable(nodes: DataFrame) -> DataFrame:
    """`id, text`: what full-text search over nodes reads, label and path."""
    return nodes.select("id", F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce("path_joined", F.lit(""))).alias("text"))


def structural_hits(nodes: DataFrame, query: str, most: int, keep: Column | None = None, index=None) -> DataFrame:
    """`id, score`: full-text search over label and path; keep holds before the cut. index is the nodes' stored index."""
    if index is not None:
        return top_k(index.search(query, keep=None if keep is None else nodes.filter(keep).select("id")), most, "id")
    text = F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce("path_joined", F.lit("")))
    return top_k(bm25(nodes.withColumn("_text", text), "id", "_text", query, keep=keep), most, "id")


def spans(nodes: DataFrame, files: DataFrame, max_bytes: int = 4096, every: DataFrame | None = None) -> DataFrame:
    """Nodes (with score) as spans: content up to max_bytes and the node's end, and what they can be expanded to.

    Parents are looked up in `every`, by default among the nodes themselves.
    """
    f = files.select(F.col("file_id").alias("f_id"), F.col("path").alias("file"), F.col("content").alias("body"), F.octet_length("content").alias("file_bytes"))
    p = (nodes if every is None else every).select(F.col("id").alias("p_id"), F.col("label").alias("p_label"), (F.col("byte_end") - F.col("byte_start")).alias("p_bytes"))
    wide = F.col("byte_end") - F.col("byte_start") > max_bytes
    stop = F.when(wide, F.col("byte_start") + (max_bytes - len(ELLIPSIS))).otherwise(F.col("byte_end"))
    text = bytes_of(F.col("body"), F.col("byte_start"), F.least(stop, F.col("file_bytes")))
    j = nodes.join(f, F.col("file_id") == F.col("f_id")).join(p, F.col("parent_id") == F.col("p_id"), "left")
    return j.select(
        "id", F.concat_ws(":", "file", "byte_start", "byte_end").alias("node_id"), "file", "byte_start", "byte_end", "line_start", "line_end", "kind", "path_joined",
        F.concat(text, F.when(wide, ELLIPSIS).otherwise("")).alias("content"), "score", wide.alias("truncated"), F.col("p_id").alias("parent_id"), F.col("p_label").alias("parent_label"), F.col("p_bytes").alias("parent_bytes"), "file_bytes",
    )


def fresh_nodes(nodes: DataFrame, files: DataFrame, indexed: DataFrame) -> DataFrame:
    """The nodes with those of files whose hash changed since indexing (`file_id, hash`) read anew.

    Only changed files are parsed; the node is matched by path and label afterwards as any other.
    """
    from ..sources.structural import structural_nodes

    old = indexed.select("file_id", F.col("hash").alias("old_hash"))
    stale = files.join(old, "file_id").filter("NOT (hash <=> old_hash)").drop("old_hash")
    kept = nodes.join(stale.select("file_id"), "file_id", "left_anti")
    return kept.unionByName(structural_nodes(stale).select(*nodes.columns))


def hybrid_locate(nodes: DataFrame, chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], most: int = 5, node_index=None, chunk_index=None) -> DataFrame:
    """`node_id, score`: structural hits first (score 1), then the nodes around the middle of hybrid hits, each range once.

    chunks has `chunk_id, file_id, file, text, range_start, range_end`; a hit outside every node has a null node_id
    and keeps its chunk's range.
    """
    direct = structural_hits(nodes, query, most, index=node_index).select(F.col("id").alias("node_id"), F.lit(1.0).alias("score"), F.lit(0).alias("ord"))
    hits = hybrid(chunks, vectors, "chunk_id", query, vector, most, index=chunk_index).select("chunk_id", F.col("score").alias("h_score"))
    placed = chunks.join(F.broadcast(hits), "chunk_id").select(F.col("chunk_id").alias("point_id"), "file_id", F.expr("(range_start + range_end) div 2").alias("at"), "range_start", "range_end", "h_score")
    inside = G.enclosing_smallest(placed.select("point_id", "file_id", "at"), nodes)
    around = placed.join(inside, "point_id", "left").select("node_id", F.col("h_score").alias("score"), F.lit(1).alias("ord"), F.col("file_id").alias("c_file"), F.col("range_start").alias("c_start"), F.col("range_end").alias("c_end"))
    n = nodes.select(F.col("id").alias("n_id"), F.col("file_id").alias("n_file"), "byte_start", "byte_end")
    every = direct.withColumn("c_file", F.lit(None).cast("long")).withColumn("c_start", F.lit(None).cast("long")).withColumn("c_end", F.lit(None).cast("long")).unionByName(around)
    ranges = every.join(n, F.col("node_id") == F.col("n_id"), "left").select("node_id", "score", "ord", F.coalesce("n_file", "c_file").alias("file_id"), F.coalesce("byte_start", "c_start").alias("start"), F.coalesce("byte_end", "c_end").alias("end"))
    first = ranges.groupBy("file_id", "start", "end").agg(F.min(F.struct("ord", (-F.col("score")).alias("neg"), "node_id")).alias("m"))
    return first.select("m.node_id", (-F.col("m.neg")).alias("score"), "file_id", "start", "end").orderBy(F.desc("score"), "file_id", "start", "end").limit(most)


def hit_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of hybrid_locate's hits with their scores; a hit outside every node is a node of kind Chunk with the chunk's range."""
    own = nodes.join(F.broadcast(hits.filter("node_id IS NOT NULL").select(F.col("node_id").alias("id"), "score")), "id")
    made = {"file_id": F.col("file_id"), "kind": F.lit("Chunk"), "byte_start": F.col("start"), "byte_end": F.col("end"), "depth": F.lit(0)}
    kinds = dict(nodes.dtypes)
    loose = hits.filter("node_id IS NULL").select(*(made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in nodes.columns), "score")
    return own.select(*nodes.columns, "score").unionByName(loose)


def scoped(chunks: DataFrame, vectors: DataFrame, scope: DataFrame, query: str, vector: list[float], most: int = 5) -> DataFrame:
    """Hybrid search among the chunks that lie within the one node of `scope` (at most one row)."""
    s = F.broadcast(scope.select(F.col("file_id").alias("s_file"), F.col("byte_start").alias("s_start"), F.col("byte_end").alias("s_end")).limit(1))
    inside = chunks.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("range_start") >= F.col("s_start")) & (F.col("range_end") <= F.col("s_end"))).drop("s_file", "s_start", "s_end")
    return hybrid(inside, vectors.join(inside.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", query, vector, most)
