"""Text search, path filters and span shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import text as T
from ..sources.tables import load
from .catalog import query
from .common import FILES, files_view

_LINES = "l AS (SELECT file_id, path, unnest(string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10)), 1) AS line FROM f WHERE content <> ''), t AS (SELECT file_id, path, line::INT AS line, CASE WHEN suffix(raw, chr(13)) THEN left(raw, len(raw) - 1) ELSE raw END AS text FROM l)"
_COUNT = "len(regexp_extract_all(text, '(?i)vector'))"


def _hits(spark, folder):
    return T.search_lines(files_view(spark, folder, "file_id", "path", "content"), ["file_id", "path"], "vector")


@query("text_search_lines", f"WITH {FILES}, {_LINES} SELECT file_id, path, line, {_COUNT} AS matches FROM t WHERE {_COUNT} > 0")
def text_search_lines(spark, folder):
    return _hits(spark, folder).select("file_id", "path", "line", "matches")


@query("text_search_total", f"WITH {FILES} SELECT CAST(sum(len(regexp_extract_all(content, '(?i)vector'))) AS BIGINT) AS total FROM f")
def text_search_total(spark, folder):
    return T.total_matches(files_view(spark, folder, "file_id", "content"), "vector")


@query(
    "text_search_context",
    f"WITH {FILES}, {_LINES}, c AS (SELECT file_id, path, line, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM t WINDOW w AS (PARTITION BY file_id ORDER BY line)) SELECT path, line, text, before, after, {_COUNT} AS matches FROM c WHERE {_COUNT} > 0 ORDER BY path, line LIMIT 100",
)
def text_search_context(spark, folder):
    return _hits(spark, folder).select("path", "line", "text", "before", "after", "matches").orderBy("path", "line").limit(100)


@query("text_search_regex", f"WITH {FILES}, {_LINES} SELECT file_id, line, len(regexp_extract_all(text, 'fn [a-z]+_[a-z]+')) AS matches FROM t WHERE regexp_matches(text, 'fn [a-z]+_[a-z]+')")
def text_search_regex(spark, folder):
    return T.search_lines(files_view(spark, folder, "file_id", "content"), ["file_id"], "fn [a-z]+_[a-z]+", regex=True, case_sensitive=True).select("file_id", "line", "matches")


_COLUMNS = (
    f"WITH {FILES}, {_LINES}, p AS (SELECT file_id, line, text, string_split(lower(text), 'vector') AS parts FROM t WHERE regexp_matches(text, '(?i)vector'))"
    " SELECT file_id, line, CAST(list_sum(list_transform(parts[1:k], lambda x: strlen(x))) + (k - 1) * 6 + 1 AS INT) AS column, regexp_extract_all(text, '(?i)vector')[k] AS match FROM p, unnest(range(1, len(parts))) u(k)"
)


@query("text_search_columns", _COLUMNS)
def text_search_columns(spark, folder):
    return T.match_columns(files_view(spark, folder, "file_id", "content"), ["file_id"], "vector")


@query("text_search_glob", f"WITH {FILES} SELECT file_id, path FROM f WHERE (path LIKE 'amber-anvil/%' AND regexp_matches(path, '^amber-anvil/.*\\.rs$') OR regexp_matches(path, '^[^/]*/src/.*\\.py$')) AND NOT regexp_matches(path, '^.*/tests/.*$')")
def text_search_glob(spark, folder):
    return files_view(spark, folder, "file_id", "path").filter(P.path_filter(F.col("path"), ["amber-anvil/**.rs", "*/src/**.py"], ["**/tests/**"]))


@query("sqlite_glob_filter", f"WITH {FILES} SELECT file_id, path FROM f WHERE path GLOB '*/src/*.rs' AND NOT path GLOB '*_table*'")
def sqlite_glob_filter(spark, folder):
    p = F.col("path")
    return files_view(spark, folder, "file_id", "path").filter(p.rlike(P.sqlite_glob("*/src/*.rs")) & ~p.rlike(P.sqlite_glob("*_table*")))


@query("prefix_select", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a')")
def prefix_select(spark, folder):
    return load(spark, folder, "part", "p_partkey", "p_name").filter(F.col("p_name").startswith("a"))


@query("prefix_paths", f"WITH {FILES} SELECT file_id, path FROM f WHERE starts_with(path, 'amber-anvil/src/')")
def prefix_paths(spark, folder):
    return files_view(spark, folder, "file_id", "path").filter(F.col("path").startswith("amber-anvil/src/"))


@query("contains_select", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e')")
def contains_select(spark, folder):
    return load(spark, folder, "part", "p_partkey", "p_name").filter(F.col("p_name").contains("e"))


@query("test_file_filter", f"WITH {FILES} SELECT file_id, path FROM f WHERE regexp_matches(path, '(_test\\.(rs|ts|tsx|js|jsx|py)|_spec\\.(ts|js)|test\\.py)$|/(test|tests|__tests__|spec)/|^(test|tests)/')")
def test_file_filter(spark, folder):
    return files_view(spark, folder, "file_id", "path").filter(P.is_test_file(F.col("path")))


@query("doc_file_filter", f"WITH {FILES} SELECT file_id, path FROM f WHERE path LIKE '%.md'")
def doc_file_filter(spark, folder):
    return files_view(spark, folder, "file_id", "path").filter(P.is_doc_file(F.col("path")))


@query("extension_filter", f"WITH {FILES} SELECT file_id, path FROM f WHERE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ('rs', 'toml')")
def extension_filter(spark, folder):
    return files_view(spark, folder, "file_id", "path").filter(F.lower(P.extension(F.col("path"))).isin("rs", "toml"))


@query("language_filter", f"WITH {FILES} SELECT file_id, path FROM f WHERE language IN ('rust', 'python')")
def language_filter(spark, folder):
    return files_view(spark, folder, "file_id", "path", "language").filter(F.col("language").isin("rust", "python")).select("file_id", "path")


@query("size_language_filter", f"WITH {FILES} SELECT file_id, size FROM f WHERE size <= 1000 AND language IS NOT NULL")
def size_language_filter(spark, folder):
    return files_view(spark, folder, "file_id", "size", "language").filter("size <= 1000 AND language IS NOT NULL").select("file_id", "size")


@query("language_from_path", f"WITH {FILES}, x AS (SELECT file_id, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM f) SELECT file_id, CASE ext WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'toml' THEN 'toml' WHEN 'csv' THEN 'csv' END AS lang FROM x")
def language_from_path(spark, folder):
    return files_view(spark, folder, "file_id", "path").select("file_id", P.language_of(F.col("path")).alias("lang"))


@query("normalize_path", f"WITH {FILES} SELECT file_id, regexp_replace(path, '^[^/]+/[^/]+/', '') AS p FROM f WHERE len(string_split(path, '/')) > 2")
def normalize_path(spark, folder):
    p = F.col("path")
    first = F.split(p, "/")
    detour = F.concat(F.lit("./"), first[0], F.lit("/../"), first[1], F.lit("//../"), F.array_join(F.slice(first, 3, 1000), "/"))
    return files_view(spark, folder, "file_id", "path").filter(F.size(first) > 2).select("file_id", P.normalize_path(detour).alias("p"))


@query("path_guard", r"SELECT DISTINCT path, NOT starts_with(replace(path, '\', '/'), '/') AND NOT list_contains(string_split(replace(path, '\', '/'), '/'), '..') AS safe FROM files")
def path_guard(spark, folder):
    return load(spark, folder, "files", "path").distinct().select("path", P.safe_path(F.col("path")).alias("safe"))


@query("query_router", "WITH q AS (SELECT DISTINCT query_id, query FROM search_configs) SELECT query_id, CASE WHEN regexp_matches(trim(query), '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'definition' WHEN contains(query, ':L') OR contains(query, '/') OR contains(query, '*') OR contains(query, '.') THEN 'locate' ELSE 'semantic' END AS strategy FROM q")
def query_router(spark, folder):
    from ..operators.routing import strategy_column

    return load(spark, folder, "search_configs", "query_id", "query").distinct().select("query_id", strategy_column(F.col("query")).alias("strategy"))


_LN = "CASE WHEN suffix(content, chr(10)) THEN len(string_split(content, chr(10))) - 1 ELSE len(string_split(content, chr(10))) END"


@query("line_range_slice", f"WITH {FILES} SELECT file_id, CASE WHEN 3 > {_LN} THEN '' ELSE array_to_string(list_slice(string_split(content, chr(10)), 3, 6), chr(10)) || CASE WHEN 6 < {_LN} OR (suffix(content, chr(10)) AND 6 = {_LN}) THEN chr(10) ELSE '' END END AS slice FROM f WHERE content <> ''")
def line_range_slice(spark, folder):
    return files_view(spark, folder, "file_id", "content").filter("content <> ''").select("file_id", T.line_range(F.col("content"), 3, 6).alias("slice"))


_STARTS = "l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM f WHERE content <> ''), b AS (SELECT file_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM l)"


@query("byte_to_line", f"WITH {FILES}, n AS (SELECT DISTINCT id, file_id, byte_start FROM structural_nodes WHERE byte_start >= 0), {_STARTS} SELECT id, CAST(count(*) AS INT) AS line FROM n JOIN b USING (file_id) WHERE at_ <= byte_start GROUP BY id")
def byte_to_line(spark, folder):
    nodes = load(spark, folder, "structural_nodes", "id", "file_id", "byte_start").filter("byte_start >= 0").distinct()
    points = nodes.select(F.col("id").alias("point_id"), "file_id", F.col("byte_start").alias("at"))
    return T.byte_lines(points, files_view(spark, folder, "file_id", "content")).withColumnRenamed("point_id", "id")


@query("byte_range_text", f"WITH {FILES}, n AS (SELECT DISTINCT id, file_id, byte_start, byte_end FROM structural_nodes WHERE byte_start >= 0 AND byte_end > byte_start), x AS (SELECT id, TRY(decode(encode(content)[byte_start + 1 : least(byte_end, byte_start + 16384)])) AS slice, byte_end - byte_start > 16384 AS truncated FROM n JOIN f USING (file_id) WHERE byte_end <= strlen(content)) SELECT * FROM x WHERE slice IS NOT NULL")
def byte_range_text(spark, folder):
    """The ranges whose bytes are whole characters, as the SQL has no others; byte_range_text_all has every range."""
    j, end = _byte_ranges(spark, folder)
    whole = F.is_valid_utf8(T.raw_bytes_of(F.col("content"), F.col("byte_start"), end).cast("string"))
    return _range_text(j.filter(whole), end)


@query("byte_range_text_all")
def byte_range_text_all(spark, folder):
    """Every range within its file; a cut character becomes U+FFFD, which DuckDB's decode cannot say."""
    return _range_text(*_byte_ranges(spark, folder))


def _byte_ranges(spark, folder):
    nodes = load(spark, folder, "structural_nodes", "id", "file_id", "byte_start", "byte_end").filter("byte_start >= 0 AND byte_end > byte_start").distinct()
    end = F.least(F.col("byte_end"), F.col("byte_start") + 16384)
    return nodes.join(files_view(spark, folder, "file_id", "content"), "file_id").filter("byte_end <= octet_length(content)"), end


def _range_text(ranges, end):
    return ranges.select("id", T.bytes_of(F.col("content"), F.col("byte_start"), end).alias("slice"), (F.col("byte_end") - F.col("byte_start") > 16384).alias("truncated"))


@query("line_start_bytes", f"WITH {FILES}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM f WHERE content <> '') SELECT file_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l")
def line_start_bytes(spark, folder):
    return T.line_starts(files_view(spark, folder, "file_id", "content"), ["file_id"])


@query("span_truncate", "WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p, suffix(text, chr(10)) AS e FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN text = '' THEN 0 WHEN e THEN len(p) - 1 ELSE len(p) END AS n FROM d) SELECT doc_id, CASE WHEN n <= 80 THEN text ELSE array_to_string(p[1:40], chr(10)) || chr(10) || '[...' || (n - 60) || ' lines elided...]' || chr(10) || array_to_string(p[n - 19 : n], chr(10)) || CASE WHEN e THEN chr(10) ELSE '' END END AS text FROM c")
def span_truncate(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", T.truncate_lines(F.col("text")).alias("text"))


@query("span_total_cap", "WITH h AS (SELECT DISTINCT hit_id, query_id, score, chunk_text FROM semantic_hits WHERE source = 'bm25' AND chunk_text IS NOT NULL AND score IS NOT NULL), c AS (SELECT *, CASE WHEN chunk_text = '' THEN 0 ELSE greatest(1, len(string_split(chunk_text, chr(10))) - CASE WHEN suffix(chunk_text, chr(10)) THEN 1 ELSE 0 END) END AS lines FROM h), r AS (SELECT *, sum(lines) OVER (PARTITION BY query_id ORDER BY score DESC, hit_id ROWS UNBOUNDED PRECEDING) AS running FROM c) SELECT query_id, hit_id, CAST(running AS BIGINT) AS running FROM r WHERE running <= 100")
def span_total_cap(spark, folder):
    hits = load(spark, folder, "semantic_hits", "hit_id", "query_id", "score", "chunk_text", "source").filter("source = 'bm25' AND chunk_text IS NOT NULL AND score IS NOT NULL").dropDuplicates(["hit_id"])
    return T.cap_total_lines(hits, [F.desc("score"), F.col("hit_id")], 100, "chunk_text", by=["query_id"]).select("query_id", "hit_id", "running")
