"""One ranking from several differently-scaled scores, by leximin.

Each score becomes the share of its list (query and source) that it is at least as good as, so no list's
range or distribution matters. An item's shortfall in a list is the weight of the list times what is
missing to 1; the items are ordered by their shortfalls, the largest compared first. A high score
in one list so never masks a low one in another. The weights are hybrid_alpha for vector, 1 -
hybrid_alpha for bm25 and one half for hybrid; a list that a query does not have counts for nobody.

Defined cases: an item that is absent from a list of its query, or has a null or NaN score there, falls
short by the whole weight; repeated rows and several rows of an item in one list count once, with the
best score; a null hybrid_alpha (or a query without a configuration) is 0.5, values outside 0 to 1 are
clamped; equal items are ordered by chunk_id; rows without query, chunk or source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import group_ranks, tied_ranks

SOURCES = ("bm25", "vector", "hybrid")


def shortfalls(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """`query_id, chunk_id, lack array<double>`: each item's shortfalls, the largest first, rounded to 9 places."""
    score = F.col("score").cast("double")
    scored = hits.select("query_id", "chunk_id", "source", F.when(F.isnan(score), None).otherwise(score).alias("score")).filter(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("source").isin(*SOURCES))
    best = scored.groupBy("query_id", "source", "chunk_id").agg(F.max("score").alias("score"))
    ranked = tied_ranks(best, ["query_id", "source"], "score")
    share = F.when(F.col("score").isNull(), 0.0).otherwise(F.col("rank") / F.col("group_size"))
    shares = ranked.groupBy("query_id", "chunk_id").agg(*(F.coalesce(F.max(F.when(F.col("source") == s, share)), F.lit(0.0)).alias(s) for s in SOURCES))
    # Per query one row: which lists it has, and its weight.
    alpha = configs.filter("query_id IS NOT NULL").groupBy(F.col("query_id").alias("cq")).agg(F.max("hybrid_alpha").alias("alpha"))
    lists = scored.groupBy(F.col("query_id").alias("lq")).agg(*(F.max((F.col("source") == s).cast("int")).alias(f"has_{s}") for s in SOURCES))
    lists = lists.join(alpha, F.col("lq") == F.col("cq"), "left").select("lq", *(f"has_{s}" for s in SOURCES), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("alpha", F.lit(0.5)), F.lit(0.5)))).alias("alpha"))
    weight = {"bm25": 1 - F.col("alpha"), "vector": F.col("alpha"), "hybrid": F.lit(0.5)}
    lack = F.reverse(F.array_sort(F.array(*(F.round(F.col(f"has_{s}") * weight[s] * (1 - F.col(s)), 9) for s in SOURCES))))
    return shares.join(lists, F.col("query_id") == F.col("lq")).select("query_id", "chunk_id", lack.alias("lack"))


def leximin_ranking(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """`query_id, chunk_id, rank`: the whole ranking of each query."""
    lack = shortfalls(hits, configs)
    order = [F.col("lack")[i].asc() for i in range(len(SOURCES))] + [F.col("chunk_id").asc()]
    return group_ranks(lack, ["query_id"], order).select("query_id", "chunk_id", F.col("rank").cast("long"))


def leximin_first(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """`query_id, chunk_id`: the first of each query, by a partial aggregate."""
    best = F.min(F.struct("lack", "chunk_id"))
    return shortfalls(hits, configs).groupBy("query_id").agg(best.alias("m")).select("query_id", "m.chunk_id")
