"""Upserts, retrieval and memories."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import fulltext as FT
from ..operators import locate as L
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import upserts as U
from ..sources.tables import load
from .catalog import query
from .common import EDGES, FILES, files_view, nodes_view
from .graph_common import edges_view

_SPLIT = datetime.datetime(2031, 3, 10)
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("content_hash", f"WITH {FILES} SELECT file_id, sha256(content) AS digest FROM f WHERE content IS NOT NULL")
def content_hash(spark, folder):
    return files_view(spark, folder, "file_id", "content").filter("content IS NOT NULL").select("file_id", F.sha2("content", 256).alias("digest"))


@query("chunk_norm_id", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS chunk_id FROM documents WHERE text IS NOT NULL")
def chunk_norm_id(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.sha2(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")), 256).alias("chunk_id"))


@query("upsert_latest", "SELECT path, arg_max(scan_id, (arrived_at, scan_id)) AS scan_id, arg_max(hash, (arrived_at, scan_id)) AS hash FROM file_scans WHERE hash IS NOT NULL GROUP BY path")
def upsert_latest(spark, folder):
    rows = load(spark, folder, "file_scans", "path", "arrived_at", "scan_id", "hash").filter("hash IS NOT NULL")
    return U.upsert_latest(rows, None, ["path"], ["arrived_at", "scan_id"]).select("path", "scan_id", "hash")


@query("upsert_symbols", "SELECT symbol_id, max(seen_at) AS seen_at, arg_max(name, seen_at) AS name FROM symbols GROUP BY symbol_id")
def upsert_symbols(spark, folder):
    s = load(spark, folder, "symbols", "symbol_id", "seen_at", "name")
    split = F.lit(_SPLIT)
    return U.upsert_latest(s.filter(F.col("seen_at") < split), s.filter(F.col("seen_at") >= split), ["symbol_id"], ["seen_at"])


@query("upsert_vectors", "SELECT chunk_id, arg_max(vec_id, (created_at, vec_id)) AS vec_id FROM vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def upsert_vectors(spark, folder):
    v = load(spark, folder, "vectors", "chunk_id", "created_at", "vec_id").distinct()
    return U.upsert_latest(v, None, ["chunk_id"], ["created_at", "vec_id"]).select("chunk_id", "vec_id")


@query(
    "upsert_edges_replace",
    f"WITH {EDGES}, t AS (SELECT from_id, to_id, kind, max(observed_at) AS seen FROM edges GROUP BY ALL), o AS (SELECT DISTINCT e.from_id, e.to_id, e.kind, e.from_file, seen FROM e JOIN t USING (from_id, to_id, kind)), b AS (SELECT * FROM o WHERE seen >= TIMESTAMP '2031-03-10'), r AS (SELECT * FROM o WHERE seen < TIMESTAMP '2031-03-10' AND from_file NOT IN (SELECT from_file FROM b)) SELECT from_id, to_id, kind FROM b UNION SELECT from_id, to_id, kind FROM r",
)
def upsert_edges_replace(spark, folder):
    e = edges_view(spark, folder, "observed_at").groupBy("from_id", "to_id", "kind", "from_file").agg(F.max("observed_at").alias("seen"))
    split = F.lit(_SPLIT)
    return U.upsert_edges(e.filter(F.col("seen") < split), e.filter(F.col("seen") >= split)).select("from_id", "to_id", "kind")


@query("replace_edges_one_file", f"WITH {EDGES}, x AS (SELECT min(from_file) AS p FROM e WHERE from_file <> '') SELECT DISTINCT from_id, to_id, kind FROM e, x WHERE from_file <> p AND to_file <> p")
def replace_edges_one_file(spark, folder):
    e = edges_view(spark, folder).select("from_id", "to_id", "kind", "from_file", "to_file").distinct()
    path = e.filter("from_file <> ''").agg(F.min("from_file")).first()[0] or ""
    return U.replace_edges_of_file(e, e.limit(0), path).select("from_id", "to_id", "kind")


@query("replace_edges_insert", f"WITH {EDGES}, x AS (SELECT min(from_file) AS p FROM e WHERE from_file <> '') SELECT DISTINCT from_id, to_id, kind FROM e, x WHERE (from_file <> p AND to_file <> p) OR (from_file = p AND kind IN ('Calls', 'Defines'))")
def replace_edges_insert(spark, folder):
    """The edges of one file are replaced by its calls and definitions."""
    e = edges_view(spark, folder).select("from_id", "to_id", "kind", "from_file", "to_file").distinct()
    path = e.filter("from_file <> ''").agg(F.min("from_file")).first()[0] or ""
    fresh = e.filter((F.col("from_file") == path) & F.col("kind").isin("Calls", "Defines"))
    return U.replace_edges_of_file(e, fresh, path).select("from_id", "to_id", "kind")


@query("upsert_chunks", "SELECT chunk_id, max(hit_id) AS hit_id, arg_max(file, hit_id) AS file FROM semantic_hits WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def upsert_chunks(spark, folder):
    h = load(spark, folder, "semantic_hits", "chunk_id", "hit_id", "file", "source")
    return U.upsert_latest(h.filter("source <> 'hybrid'").drop("source"), h.filter("source = 'hybrid' OR source IS NULL").drop("source"), ["chunk_id"], ["hit_id"])


@query("delete_cascade", f"WITH {FILES}, {EDGES}, gone AS (SELECT path, file_id FROM f WHERE starts_with(path, 'amber-anvil/')) SELECT 'files' AS tab, count(*) AS n FROM f WHERE path NOT IN (SELECT path FROM gone) UNION ALL SELECT 'nodes', count(*) FROM (SELECT DISTINCT ON (id) * FROM structural_nodes) WHERE file_id NOT IN (SELECT file_id FROM gone) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT from_id, to_id, kind, from_file, to_file FROM e) WHERE from_file NOT IN (SELECT path FROM gone) AND to_file NOT IN (SELECT path FROM gone)")
def delete_cascade(spark, folder):
    files = files_view(spark, folder, "file_id", "path")
    gone = files.filter(F.col("path").startswith("amber-anvil/")).select("path")
    left = U.delete_files(gone, files, nodes=nodes_view(spark, folder), edges=edges_view(spark, folder).select("from_id", "to_id", "kind", "from_file", "to_file").distinct())
    parts = [left[t].agg(F.lit(t).alias("tab"), F.count(F.lit(1)).alias("n")) for t in ("files", "nodes", "edges")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("upsert_nodes_replace", f"WITH n AS (SELECT DISTINCT ON (id) id, file_id, kind, label FROM structural_nodes) SELECT id, file_id, CASE WHEN kind = 'JsonKey' AND file_id IN (SELECT file_id FROM n WHERE kind = 'JsonKey') THEN upper(label) ELSE label END AS label FROM n")
def upsert_nodes_replace(spark, folder):
    n = nodes_view(spark, folder).select("id", "file_id", "kind", "label")
    fresh = n.filter("kind = 'JsonKey'").withColumn("label", F.upper("label"))
    return U.replace_by(n, fresh, "file_id").select("id", "file_id", "label")


@query("missing_vectors", "WITH h AS (SELECT DISTINCT chunk_id FROM semantic_hits WHERE chunk_id IS NOT NULL) SELECT chunk_id FROM h WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE model = 'lumen-text-64' AND chunk_id IS NOT NULL)")
def missing_vectors(spark, folder):
    return R.missing_vectors(load(spark, folder, "semantic_hits", "chunk_id").filter("chunk_id IS NOT NULL").distinct(), load(spark, folder, "vectors", "chunk_id", "model"), "lumen-text-64")


@query("coverage_ratio", "WITH h AS (SELECT DISTINCT chunk_id FROM semantic_hits), c AS (SELECT count(*) AS total, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM vectors)) AS embedded FROM h) SELECT total, embedded, round(embedded / total, 6) AS ratio FROM c")
def coverage_ratio(spark, folder):
    return R.coverage(load(spark, folder, "semantic_hits", "chunk_id"), load(spark, folder, "vectors", "chunk_id")).withColumn("ratio", F.round("ratio", 6))


@query("chunk_in_list", "SELECT DISTINCT h.chunk_id, h.chunk_text FROM semantic_hits h WHERE h.chunk_id IN (SELECT chunk_id FROM vectors WHERE model = 'kestrel-code-48') AND h.chunk_text IS NOT NULL")
def chunk_in_list(spark, folder):
    wanted = load(spark, folder, "vectors", "model", "chunk_id").filter("model = 'kestrel-code-48'").select("chunk_id")
    return load(spark, folder, "semantic_hits", "chunk_id", "chunk_text").filter("chunk_text IS NOT NULL").distinct().join(wanted, "chunk_id", "left_semi")


@query("vectors_join_chunks", "WITH v AS (SELECT DISTINCT vec_id, chunk_id, model FROM vectors), h AS (SELECT DISTINCT chunk_id, file FROM semantic_hits) SELECT vec_id, model, file FROM v JOIN h USING (chunk_id)")
def vectors_join_chunks(spark, folder):
    v = load(spark, folder, "vectors", "vec_id", "chunk_id", "model").distinct()
    return v.join(load(spark, folder, "semantic_hits", "chunk_id", "file").distinct(), "chunk_id").select("vec_id", "model", "file")


@query("fts_tokens", f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def fts_tokens(spark, folder):
    return R.postings(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("corpus_stats", f"SELECT count(*) AS n, round(avg(len({_TOK})), 6) AS avgdl FROM documents")
def corpus_stats(spark, folder):
    d = load(spark, folder, "documents", "text")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(R.fts_tokens(F.coalesce("text", F.lit(""))))), 6).alias("avgdl"))


def bm25_sql(terms: list[str], mode: str, keep: str = "true", table: str = "documents", key: str = "doc_id") -> str:
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    cond = (" AND " if mode == "and" else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"WITH b0 AS (SELECT *, {_TOK} AS tk FROM {table}), b1 AS (SELECT *, len(tk) AS dl, {tf} FROM b0), b2 AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM b1), bm AS (SELECT {key}, {part} AS score FROM b1, b2 WHERE ({cond}) AND {keep})"


def _docs(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text", "lang")


def _index(spark, folder, folds=False):
    """The documents' stored index, written by the first query that needs it; the SQL of most queries keeps accents."""
    return FT.stored(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", "documents", folds)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("bm25_and", bm25_sql(["token", "budget"], "and") + " SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_and(spark, folder):
    return _rounded(_index(spark, folder).search("token budget"))


@query("bm25_or", bm25_sql(["snapshot", "retries"], "or") + " SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50")
def bm25_or(spark, folder):
    return _rounded(R.top_k(_index(spark, folder).search("snapshot retries", "or"), 50, "doc_id"))


@query("bm25_filtered", bm25_sql(["vector", "store"], "and", "lang = 'en'") + " SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_filtered(spark, folder):
    return _rounded(_index(spark, folder).search("vector store", keep=_docs(spark, folder).filter("lang = 'en'").select("doc_id")))


_UNINDEXED = bm25_sql(["vector", "store"], "and", "lang = 'en'") + " SELECT doc_id, round(score, 6) AS score FROM bm"


@query("bm25_unindexed", _UNINDEXED)
def bm25_unindexed(spark, folder):
    """The same ranking over texts without an index."""
    return _rounded(R.bm25(_docs(spark, folder), "doc_id", "text", "vector store", keep=F.col("lang") == "en"))


_UNIT_SQL = r"""
WITH t AS (SELECT doc_id, """ + _TOK.replace("lower(coalesce(text, ''))", "strip_accents(lower(coalesce(text, '')))") + r""" AS tk FROM documents),
u AS (SELECT doc_id, len(tk) AS dl,
        len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'memory' AND tk[i + 1] = 'log')) AS tf0,
        len(list_filter(tk, lambda x: starts_with(x, 'snap'))) AS tf1, len(list_filter(tk, lambda x: x = 'retries')) AS bad FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM u)
SELECT doc_id, round(greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
FROM u, s WHERE tf0 > 0 AND tf1 > 0 AND bad = 0
"""


@query("match_language", _UNIT_SQL)
def match_language(spark, folder):
    """A phrase, a prefix and a word that must not occur."""
    return _rounded(_index(spark, folder, True).search('"memory log" snap* NOT retries'))


@query("structural_search", "WITH n AS (SELECT DISTINCT ON (id) id, coalesce(label, '') || ' ' || coalesce(path_joined, '') AS text FROM structural_nodes), " + bm25_sql(["token", "count"], "and", table="n", key="id")[5:] + " SELECT id, round(score, 6) AS score FROM bm")
def structural_search(spark, folder):
    return _rounded(FT.stored(L.searchable(load(spark, folder, "structural_nodes", "id", "label", "path_joined")), "id", "text", "nodes", False).search("token_count"))


@query("memory_search", bm25_sql(["search", "cache"], "and", "source = 'amber-anvil/docs'") + " SELECT doc_id AS id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10")
def memory_search(spark, folder):
    index = FT.FullText(spark, _index(spark, folder).folder, "id", False)
    return _rounded(M.search(M.from_documents(load(spark, folder, "documents")), "search cache", "amber-anvil/docs", 10, index))


@query("memory_list", "SELECT doc_id AS id, collected_at AS created_at FROM documents WHERE source = 'amber-anvil/docs'")
def memory_list(spark, folder):
    return M.listing(M.from_documents(load(spark, folder, "documents")), "amber-anvil/docs").select("id", "created_at")


@query("memory_forget", "SELECT doc_id AS id FROM documents WHERE doc_id <> 7")
def memory_forget(spark, folder):
    return M.forget(M.from_documents(load(spark, folder, "documents")), 7).select("id")


_COS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 3), c AS (SELECT vec_id, list_cosine_similarity(v, qv) AS score FROM e, q)"


def _query_vector(spark, folder):
    return list(load(spark, folder, "embeddings").filter("vec_id = 3").first()["embedding"])


@query("vector_topk", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM c ORDER BY c.score DESC, vec_id LIMIT 20")
def vector_topk(spark, folder):
    return _rounded(R.vector_topk(load(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", _query_vector(spark, folder), 20))


@query("vector_topk_filtered", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM c JOIN embeddings USING (vec_id) WHERE label % 2 = 0 ORDER BY c.score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, folder):
    return _rounded(R.vector_topk(load(spark, folder, "embeddings"), "vec_id", _query_vector(spark, folder), 20, keep=F.col("label") % 2 == 0))


@query("mean_pool_norm", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), m AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN list_transform(v, lambda x, i: (x + v[65 - i]) / 2) ELSE v END AS m FROM e), s AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM m) SELECT vec_id, round(m[1] / n, 6) AS first, round(m[64] / n, 6) AS last FROM s")
def mean_pool_norm(spark, folder):
    e = load(spark, folder, "embeddings")
    pooled = R.mean_pool(F.array("embedding", F.reverse("embedding")), F.array(F.lit(1), F.when(F.col("label") % 2 == 0, 1).otherwise(0)))
    return e.select("vec_id", pooled.alias("m")).select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.col("m")[63], 6).alias("last"))


_FUSED = bm25_sql(["memory", "log"], "and") + f", {_COS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 100), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM c QUALIFY r <= 100), u AS (SELECT doc_id, r, 'bm25' AS source FROM a UNION ALL SELECT doc_id, r, 'vector' FROM b), fu AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score, CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid' ELSE max(source) END AS source FROM u GROUP BY doc_id)"


def _lists(spark, folder):
    words = R.top_k(_index(spark, folder).search("memory log"), 100, "doc_id")
    near = R.vector_topk(load(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", _query_vector(spark, folder), 100)
    return words, near


@query("rrf_fuse", _FUSED + " SELECT doc_id, round(score, 6) AS score, source FROM fu")
def rrf_fuse(spark, folder):
    words, near = _lists(spark, folder)
    return _rounded(R.rrf([R.ranked(words, "doc_id", "bm25"), R.ranked(near, "doc_id", "vector")], "doc_id"))


_RERANKED = ", re AS (SELECT doc_id, fu.score + 0.15 * CASE WHEN starts_with(source_, 'amber-anvil') AND source_ = 'amber-anvil/docs' THEN 1 ELSE 0 END - 0.1 * CASE WHEN strlen(text) >= 16384 THEN 1.0 WHEN strlen(text) >= 8192 THEN 0.5 ELSE 0 END AS score, fu.source AS source, source_ FROM fu JOIN (SELECT doc_id, text, coalesce(source, '') AS source_ FROM documents) USING (doc_id))"


def _chunks(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text", "source").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id")).alias("file"))


@query("hybrid_search", _FUSED + _RERANKED.replace("0.15 * CASE WHEN starts_with(source_, 'amber-anvil') AND source_ = 'amber-anvil/docs' THEN 1 ELSE 0 END", "0") + " SELECT doc_id, round(score, 6) AS score, source FROM re ORDER BY re.score DESC, source_ || '/' || doc_id, doc_id LIMIT 10")
def hybrid_search(spark, folder):
    v = load(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")
    return _rounded(R.hybrid(_chunks(spark, folder), v, "doc_id", "memory log", _query_vector(spark, folder), 10, index=_index(spark, folder))).select("doc_id", "score", "source")


@query("rerank_focus", _FUSED + _RERANKED + " SELECT doc_id, round(score, 6) AS score, source FROM re ORDER BY re.score DESC, source_ || '/' || doc_id, doc_id LIMIT 10")
def rerank_focus(spark, folder):
    v = load(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")
    return _rounded(R.hybrid(_chunks(spark, folder), v, "doc_id", "memory log", _query_vector(spark, folder), 10, focus=F.lit("amber-anvil/docs/x"), index=_index(spark, folder))).select("doc_id", "score", "source")


@query("truncate_words", r"SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> ''), 1, 20), ' ') AS text FROM documents WHERE text IS NOT NULL")
def truncate_words(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", R.truncate_words(F.col("text"), 20).alias("text"))


@query("embed_texts")
def embed_texts(spark, folder):
    return R.embed(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
