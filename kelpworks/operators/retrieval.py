"""Full-text, vector and hybrid retrieval.

A query's terms and vector are constants of the plan. `bm25` here ranks texts that have no index: term counts come
from array functions on each text, one aggregate gives the corpus statistics as one row, which is broadcast. Where a
stored index (`fulltext.FullText`) exists, hybrid search takes its full-text list from that.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
MODULE_WEIGHT, SIZE_WEIGHT = 0.15, -0.10


def fts_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an underscore separates."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def _count_of(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == term))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key, term, tf`: the inverted index, for writing sorted by term."""
    return df.select(F.col(key), F.explode(fts_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, text: str, query: str, mode: str = "and", keep: Column | None = None) -> DataFrame:
    """`key, score` of the texts with all (and) or any (or) terms; statistics are those of all texts.

    keep restricts what is ranked, not the statistics. A query without terms finds nothing.
    """
    terms = query_terms(query)
    if not terms:
        return df.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    tokens = fts_tokens(F.coalesce(F.col(text), F.lit("")))
    lower = F.lower(F.col(text))
    counted = df.withColumn("_t", tokens).select(*df.columns, F.size("_t").alias("_dl"), *(_count_of(t).alias(f"_tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *(F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))))
    holds = [lower.contains(t) for t in terms]
    likely = reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), holds)
    ranked = df.filter(likely) if keep is None else df.filter(keep & likely)  # a cheap test before tokens are cut
    ranked = ranked.withColumn("_t", tokens).select(*df.columns, F.size("_t").alias("_dl"), *(_count_of(t).alias(f"_tf{i}") for i, t in enumerate(terms)))
    present = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    match = reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), present)

    def part(i: int) -> Column:
        df_, tf = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.greatest(F.log((F.col("_n") - df_ + 0.5) / (df_ + 0.5)), F.lit(IDF_FLOOR))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))).otherwise(0.0)

    score = reduce(lambda a, b: a + b, (part(i) for i in range(len(terms))))
    return ranked.filter(match).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row


def top_k(df: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), F.col(key)).limit(k)


def cosine(embedding: Column, query: list[float]) -> Column:
    """Cosine in doubles; a vector longer than the other counts up to the shorter one's length."""
    n = len(query)
    q = F.array(*(F.lit(float(x)) for x in query))
    e = F.transform(F.slice(embedding, 1, n), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(e, q, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(F.transform(embedding, lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x))
    tiny = float(np.finfo(np.float32).tiny)
    return dot / (F.greatest(norm, F.lit(tiny)) * max(float(np.linalg.norm(np.asarray(query, float))), tiny))


def vector_topk(vectors: DataFrame, key: str, query: list[float], k: int, embedding: str = "embedding", keep: Column | None = None) -> DataFrame:
    rows = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0))
    rows = rows if keep is None else rows.filter(keep)
    return top_k(rows.select(key, cosine(F.col(embedding), query).alias("score")), k, key)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, scaled to length 1."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    total = F.aggregate(F.slice(kept, 2, 1 << 30), F.transform(kept[0], lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.size(kept))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(mean, lambda x: x / norm)


def ranked(hits: DataFrame, key: str, source: str) -> DataFrame:
    """`key, rank, source` of a result list (a top-k, so one small group)."""
    return hits.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key)).alias("rank"), F.lit(source).alias("source"))


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """`key, score, source`: sums of 1 / (k + rank); source is hybrid where more than one list has the item."""
    every = reduce(lambda a, b: a.unionByName(b), lists)
    label = F.when(F.count_distinct("source") > 1, "hybrid").otherwise(F.max("source"))
    return every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), label.alias("source"))


def rerank(hits: DataFrame, focus: Column | None, file: str = "file", text: str = "text") -> DataFrame:
    """Adds a bonus for files beside the focus file and a malus for very long texts."""
    from ..functions.paths import same_module

    size = F.octet_length(text)
    long_ = F.when(size >= 16 * 1024, 1.0).when(size >= 8 * 1024, 0.5).otherwise(0.0)
    near = F.lit(0.0) if focus is None else F.when(same_module(focus, F.col(file)), 1.0).otherwise(0.0)
    return hits.withColumn("score", F.col("score") + MODULE_WEIGHT * near + SIZE_WEIGHT * long_)


def hybrid(chunks: DataFrame, vectors: DataFrame, key: str, query: str, vector: list[float], k: int, text: str = "text", file: str = "file", focus: Column | None = None, keep: Column | None = None, index=None) -> DataFrame:
    """`key, score, source`: BM25 and cosine, each its best max(k, 100), fused by ranks and reranked.

    keep is a condition on chunk columns and holds for both lists, before they are cut. index is the stored full-text
    index of the chunks, without which their texts are read.
    """
    depth = max(k, 100)
    found = bm25(chunks, key, text, query, "and", keep) if index is None else index.search(query, keep=None if keep is None else chunks.filter(keep).select(key))
    words = top_k(found, depth, key)
    allowed = vectors if keep is None else vectors.join(chunks.filter(keep).select(key), key, "left_semi")
    near = vector_topk(allowed, key, vector, depth)
    fused = rrf([ranked(words, key, "bm25"), ranked(near, key, "vector")], key)
    named = chunks.select(key, file, text).join(F.broadcast(fused), key)  # at most 2 * depth rows
    return rerank(named, focus, file, text).orderBy(F.desc("score"), file, key).limit(k)


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """Chunks that have no vector of the model."""
    return chunks.join(vectors.filter(F.col("model") == model).select(key).distinct(), key, "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`total, embedded, ratio`."""
    has = vectors.select(key, F.lit(1).alias("_has")).dropDuplicates([key])
    flags = chunks.select(key).distinct().join(has, key, "left")
    counts = flags.agg(F.count(F.lit(1)).alias("total"), F.count("_has").alias("embedded"))
    return counts.withColumn("ratio", F.when(F.col("total") > 0, F.col("embedded") / F.col("total")).otherwise(0.0))


def truncate_words(text: Column, most: int) -> Column:
    """The first words of a text, joined by single blanks."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, most), " ")


def hash_embedding(texts, dimension: int = 64) -> np.ndarray:
    """A deterministic embedding without a model: signed feature hashes of words and word pairs, length 1."""
    import xxhash

    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        words = query_terms_all(t or "")
        for f in [*words, *(a + " " + b for a, b in zip(words, words[1:]))]:
            h = xxhash.xxh64_intdigest(f)
            out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(out[i]))
        if n:
            out[i] /= n
    return out


def query_terms_all(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def embed(df: DataFrame, key: str, text: str, dimension: int = 64, embedder=hash_embedding, model: str = "feature-hash") -> DataFrame:
    """`key, embedding, model, dimension`; embedder takes a list of texts and gives a matrix."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            m = np.asarray(embedder(pdf[text].tolist(), dimension), np.float32)
            yield pd.DataFrame({key: pdf[key], "embedding": list(m), "model": model, "dimension": m.shape[1] if m.ndim == 2 else dimension})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>, model string, dimension int")
