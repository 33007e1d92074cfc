"""Memories: scoped notes that can be saved, searched, listed and forgotten.

A store is a DataFrame `id, scope, content, metadata map<string,string>, created_at, updated_at`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import bm25, top_k
from .routing import clamp


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents seen as memories: the source is the scope."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("url"), F.col("url"))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), F.col("text").alias("content"), meta.alias("metadata"), F.col("collected_at").alias("created_at"), F.col("collected_at").alias("updated_at"))


def save(store: DataFrame, scope: str, content: str, metadata: dict[str, str] | None, now) -> DataFrame:
    """The store with one more memory under a new id."""
    spark = store.sparkSession
    kind = store.schema["id"].dataType.simpleString()
    new_id = F.expr("uuid()") if kind == "string" else F.expr("xxhash64(uuid())").cast(kind)
    meta = F.create_map(*(F.lit(x) for kv in (metadata or {}).items() for x in kv)) if metadata else F.create_map().cast("map<string,string>")
    stamp = F.lit(now).cast(store.schema["created_at"].dataType)
    row = spark.range(1).select(new_id.alias("id"), F.lit(scope).alias("scope"), F.lit(content).alias("content"), meta.alias("metadata"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return store.unionByName(row)


def search(store: DataFrame, query: str, scope: str | None = None, k: int = 10, index=None) -> DataFrame:
    """`id, score` of the best k; index is the stored full-text index of the contents, without which they are read."""
    keep = None if scope is None else F.col("scope") == scope
    if index is not None:
        return top_k(index.search(query, keep=None if keep is None else store.filter(keep).select("id")), clamp(k, 1, 100), "id")
    return top_k(bm25(store.select("id", "scope", "content"), "id", "content", query, keep=keep), clamp(k, 1, 100), "id")


def listing(store: DataFrame, scope: str | None = None) -> DataFrame:
    rows = store if scope is None else store.filter(F.col("scope") == scope)
    return rows.orderBy(F.desc("created_at"), "id")


def forget(store: DataFrame, memory_id) -> DataFrame:
    """The store without the memory; an unknown id changes nothing."""
    return store.filter(F.col("id") != F.lit(memory_id))
