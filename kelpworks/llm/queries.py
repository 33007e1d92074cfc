"""Named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import fusion, handwritten, neighbours, packing, spam, splitting, syntax, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: splitting -------------------------------------------------------------------------------


@query
def p1_pieces(spark, folder):
    hits, nodes, files = (load(spark, folder, t) for t in ("semantic_hits", "structural_nodes", "files"))
    return splitting.split_items(splitting.oversized(hits, nodes, files))


@query
def p1_found(spark, folder):
    return splitting.cut_kinds(p1_pieces(spark, folder))


SQL["p1_found"] = r"""
WITH i AS (
  SELECT DISTINCT 'hit' AS item_kind, hit_id AS item_id, encode(chunk_text) AS data FROM semantic_hits WHERE strlen(chunk_text) > 2000
  UNION ALL
  SELECT DISTINCT 'node', id, encode(content)[byte_start + 1 : byte_end] FROM structural_nodes JOIN files USING (file_id)
  WHERE byte_start >= 0 AND byte_end - byte_start > 2000 AND byte_end <= strlen(content))
SELECT item_kind, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(decode(data), '[ \t\r\n]'), lambda x: strlen(x))) > 2000 THEN 'forced' ELSE 'clean' END AS cut
FROM i
"""


# --- 4: fusion ----------------------------------------------------------------------------------


@query
def p4_ranking(spark, folder):
    return fusion.leximin_ranking(load(spark, folder, "semantic_hits"), load(spark, folder, "search_configs"))


@query
def p4_found(spark, folder):
    return fusion.leximin_first(load(spark, folder, "semantic_hits"), load(spark, folder, "search_configs"))


_LEXIMIN = """
WITH h AS (
  SELECT query_id, source, chunk_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END::DOUBLE) AS score FROM semantic_hits
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND source IN ('bm25', 'vector', 'hybrid') GROUP BY ALL),
s AS (SELECT *, CASE WHEN score IS NULL THEN 0 ELSE cume_dist() OVER (PARTITION BY query_id, source ORDER BY score NULLS FIRST) END AS share FROM h),
c AS (SELECT query_id, coalesce(max(hybrid_alpha), 0.5) AS alpha FROM search_configs GROUP BY query_id),
l AS (SELECT query_id, max((source = 'bm25')::INT) AS hb, max((source = 'vector')::INT) AS hv, max((source = 'hybrid')::INT) AS hh FROM h GROUP BY query_id),
p AS (
  SELECT query_id, chunk_id, coalesce(max(share) FILTER (source = 'bm25'), 0) AS b, coalesce(max(share) FILTER (source = 'vector'), 0) AS v,
         coalesce(max(share) FILTER (source = 'hybrid'), 0) AS y FROM s GROUP BY query_id, chunk_id),
k AS (
  SELECT query_id, chunk_id, list_reverse_sort([round(hb * (1 - coalesce(alpha, 0.5)) * (1 - b), 9), round(hv * coalesce(alpha, 0.5) * (1 - v), 9), round(hh * 0.5 * (1 - y), 9)]) AS lack
  FROM p JOIN l USING (query_id) LEFT JOIN c USING (query_id)),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY lack[1], lack[2], lack[3], chunk_id) AS rank FROM k)
"""
SQL["p4_ranking"] = _LEXIMIN + "SELECT query_id, chunk_id, rank FROM r"
SQL["p4_found"] = _LEXIMIN + "SELECT query_id, chunk_id FROM r WHERE rank = 1"


# --- 8, 9: tokens and containers ----------------------------------------------------------------


@query
def p8_ids(spark, folder):
    return tokens.encode_column(load(spark, folder, "documents", "doc_id", "text"))


@query
def p9_containers(spark, folder):
    docs = load(spark, folder, "documents", "doc_id", "text")
    return packing.fill_containers(tokens.count_column(docs), "doc_id", "n_tokens", expected=docs.select("doc_id").count())


@query
def p9_found(spark, folder):
    return p9_containers(spark, folder).filter("pieces > 1 AND piece = 0").select(F.col("item").alias("doc_id"))


# --- 6: most similar vectors --------------------------------------------------------------------


@query
def p6_found(spark, folder):
    return neighbours.close_pairs(neighbours.most_similar(load(spark, folder, "vectors"), k=5, min_cosine=0.93))


@query
def p6_neighbours(spark, folder):
    """The 5 most similar of every vector whose id is divisible by 50, whatever their cosine."""
    return neighbours.most_similar(load(spark, folder, "vectors"), k=5, every=50)


SQL["p6_found"] = """
WITH u AS (
  SELECT DISTINCT ON (vec_id) vec_id, model, embedding::DOUBLE[] AS e FROM vectors
  WHERE len(embedding) = dimension AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.vec_id AS q, b.vec_id AS o, round(list_cosine_similarity(a.e, b.e), 9) AS cosine FROM u a JOIN u b ON a.model = b.model AND a.vec_id <> b.vec_id),
k AS (SELECT q, o, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, o) AS n FROM c)
SELECT DISTINCT least(q, o) AS vec_a, greatest(q, o) AS vec_b FROM k WHERE n <= 5 AND cosine >= 0.93
"""


# --- 10: spam pages -----------------------------------------------------------------------------


@query
def p10_pages(spark, folder):
    """The flagged pages with how many of their characters are evidence, and how many of those are phrases of other hosts."""
    return spam.spam_pages(load(spark, folder, "documents", "doc_id", "text", "url", "source")).select("doc_id", "total", F.round("spam", 3).alias("spam"), F.round("by_hosts", 3).alias("by_hosts"))


@query
def p10_found(spark, folder):
    return spam.spam_pages(load(spark, folder, "documents", "doc_id", "text", "url", "source")).select("doc_id")


# --- 5: generated, minified, third-party and data files ------------------------------------------


@query
def p5_reasons(spark, folder):
    return handwritten.not_handwritten(load(spark, folder, "files", "file_id", "repo", "path", "content"))


@query
def p5_found(spark, folder):
    return p5_reasons(spark, folder).select("file_id")


# --- 2: files that do not parse -----------------------------------------------------------------


@query
def p2_errors(spark, folder):
    return syntax.checked_files(load(spark, folder, "files", "file_id", "repo", "path", "content")).filter("NOT valid")


@query
def p2_found(spark, folder):
    return p2_errors(spark, folder).select("file_id")


@query
def p2_rates(spark, folder):
    return syntax.error_rates(syntax.checked_files(load(spark, folder, "files", "file_id", "repo", "path", "content")))
