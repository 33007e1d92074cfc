"""Structural parsing, locating, packing."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import locate as L
from ..operators import pack as P
from ..operators import retrieval as R
from ..operators.text import raw_bytes_of
from ..sources import code, structural
from ..sources.tables import load
from .catalog import query
from .common import EDGES, FILES, NODES, files_view, nodes_view
from .graph_common import edges_view

_NOW = datetime.datetime(2031, 3, 1)


@query("json_keys", "SELECT event_id, unnest(json_keys(props)) AS label, unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, '$.' || x))) AS value FROM events")
def json_keys(spark, folder):
    e = load(spark, folder, "events", "event_id", "props").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("label", "value"))


@query("structural_parse")
def structural_parse(spark, folder):
    return structural.structural_nodes(files_view(spark, folder, "file_id", "path", "language", "content"))


_JSON_NODES = (
    f"WITH {FILES}, d AS (SELECT f.file_id, t.id, t.parent, t.key, t.type FROM (SELECT file_id, content FROM f WHERE language = 'json' AND json_valid(content)) f, json_tree(f.content) t),"
    " n AS (SELECT c.file_id, c.id, c.parent, CASE WHEN p.type = 'ARRAY' THEN '[' || c.key || ']' ELSE c.key END AS label FROM d c JOIN d p ON p.file_id = c.file_id AND p.id = c.parent)"
    " SELECT n.file_id, n.label, p.label AS parent_label FROM n LEFT JOIN n p ON p.file_id = n.file_id AND p.id = n.parent"
)


@query("json_nodes", _JSON_NODES)
def json_nodes(spark, folder):
    """The JSON part of structural_parse: a node per member and element, with the node around it."""
    files = files_view(spark, folder, "file_id", "path", "language", "content").filter("language = 'json'")
    n = structural.structural_nodes(files).select("id", "file_id", "label", "parent_id")
    p = n.select(F.col("id").alias("p_id"), F.col("label").alias("parent_label"))
    return n.join(p, F.col("parent_id") == F.col("p_id"), "left").select("file_id", "label", "parent_label")


@query("symbols_extract")
def symbols_extract(spark, folder):
    return code.symbols(files_view(spark, folder, "file_id", "path", "language", "content"))


@query("chunk_split")
def chunk_split(spark, folder):
    return code.chunks(files_view(spark, folder, "file_id", "path", "language", "content"), 1024)


@query("imports_extract")
def imports_extract(spark, folder):
    return code.imports(files_view(spark, folder, "file_id", "path", "language", "content"))


_MD = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents WHERE text IS NOT NULL), g AS (SELECT *, sum(CASE WHEN starts_with(t, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS fences FROM l), h AS (SELECT doc_id, line, len(regexp_extract(t, '^(#{1,6})[ ]', 1)) AS level, trim(regexp_extract(t, '^#{1,6}[ ](.*)$', 1)) AS title FROM g WHERE fences % 2 = 0 AND regexp_matches(t, '^#{1,6}[ ][^#]+$'))"


def _headings(spark, folder):
    """The headings outside fenced code; the windows are over one document's lines."""
    d = load(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).filter(F.col("t").startswith("#") | F.col("t").startswith("```"))
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    outside = lines.withColumn("fences", F.sum(F.col("t").startswith("```").cast("int")).over(w)).filter("fences % 2 = 0")
    heads = outside.filter(F.col("t").rlike(r"^#{1,6}[ ][^#\n]+\z"))
    return heads.select("doc_id", (F.col("p") + 1).alias("line"), F.length(F.regexp_extract("t", "^(#{1,6})[ ]", 1)).alias("level"), F.trim(F.regexp_extract("t", r"^#{1,6}[ ]([^\n]*)", 1)).alias("title"))


@query("md_sections", f"WITH {_MD} SELECT doc_id, line, CAST(level AS INT) AS level, title FROM h")
def md_sections(spark, folder):
    return _headings(spark, folder)


@query("md_section_end", f"WITH {_MD} SELECT a.doc_id, a.line, (SELECT min(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) AS next_line FROM h a")
def md_section_end(spark, folder):
    """The next heading of each level comes from six running minima, one per level, not from collected lists."""
    after = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(after).alias(f"n{k}") for k in range(1, 7)]
    h = _headings(spark, folder).select("doc_id", "line", "level", *nexts)
    return h.select("doc_id", "line", F.array(*(F.col(f"n{k}") for k in range(1, 7)))[F.col("level") - 1].alias("next_line"))


@query("md_sections_all")
def md_sections_all(spark, folder):
    """Every heading that the Markdown parser knows (also setext, indented and closed ones; none in ``` or ~~~ fences) and the next of its level or above."""

    def run(batches):
        for pdf in batches:
            rows = [(d, *h) for d, t in zip(pdf["doc_id"], pdf["text"]) for h in structural.markdown_headings(t)]
            yield pd.DataFrame({"doc_id": pd.Series([r[0] for r in rows], dtype="int64"), "line": pd.Series([r[1] for r in rows], dtype="int32"), "level": pd.Series([r[2] for r in rows], dtype="int32"), "title": pd.Series([r[3] for r in rows], dtype="object"), "next_line": pd.array([r[4] for r in rows], dtype="Int32")})

    d = load(spark, folder, "documents", "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.mapInPandas(run, "doc_id long, line int, level int, title string, next_line int")


@query("node_by_path", f"WITH {NODES}, x AS (SELECT min(path_joined) AS p FROM n WHERE depth = 1) SELECT id, label FROM n, x WHERE path_joined = p ORDER BY file_id, depth, id LIMIT 1")
def node_by_path(spark, folder):
    n = nodes_view(spark, folder)
    return L.by_path(n, n.filter("depth = 1").agg(F.min("path_joined")).first()[0] or "").select("id", "label")


@query("node_by_id", f"WITH {NODES} SELECT id, label, kind FROM n WHERE id = 40")
def node_by_id(spark, folder):
    return load(spark, folder, "structural_nodes").filter("id = 40").dropDuplicates(["id"]).select("id", "label", "kind")


@query("locate_path_ranked", f"WITH {NODES} SELECT id, CASE WHEN path_joined = 'token_count' THEN 1.0 WHEN label = 'token_count' OR path_joined LIKE '%/token_count' THEN 0.9 ELSE 0.8 END::DOUBLE AS score FROM n WHERE contains(path_joined, 'token_count') OR label = 'token_count' ORDER BY score DESC, file_id, depth, id LIMIT 10")
def locate_path_ranked(spark, folder):
    return L.ranked_by_path(nodes_view(spark, folder), "token_count", 10).select("id", "score")


@query("locate_spans", f"WITH {NODES}, {FILES}, x AS (SELECT n.id, TRY(decode(encode(content)[byte_start + 1 : CASE WHEN byte_end - byte_start > 200 THEN byte_start + 184 ELSE byte_end END])) AS part, byte_end - byte_start > 200 AS truncated FROM n JOIN f USING (file_id) WHERE byte_start >= 0 AND byte_end >= byte_start AND byte_end <= strlen(content)) SELECT id, part || CASE WHEN truncated THEN chr(10) || '... (truncated)' ELSE '' END AS content, truncated FROM x WHERE part IS NOT NULL")
def locate_spans(spark, folder):
    """The spans whose bytes are whole characters, as the SQL has no others; locate_spans_all has every span."""
    n, f = _ranged_nodes(spark, folder)
    stop = F.when(F.col("byte_end") - F.col("byte_start") > 200, F.col("byte_start") + 184).otherwise(F.col("byte_end"))
    whole = F.is_valid_utf8(raw_bytes_of(F.col("body"), F.col("byte_start"), stop).cast("string"))
    return L.spans(n.filter(whole).drop("body"), f, 200).select("id", "content", "truncated")


@query("locate_spans_all")
def locate_spans_all(spark, folder):
    """Every span within its file; a cut character becomes U+FFFD, which DuckDB's decode cannot say."""
    n, f = _ranged_nodes(spark, folder)
    return L.spans(n.drop("body"), f, 200).select("id", "content", "truncated")


def _ranged_nodes(spark, folder):
    """The nodes whose range lies within their file, with its text as body, and the files."""
    n = nodes_view(spark, folder).filter("byte_start >= 0 AND byte_end >= byte_start").withColumn("score", F.lit(1.0))
    f = files_view(spark, folder, "file_id", "path", "content")
    bodies = f.select(F.col("file_id").alias("x"), F.col("content").alias("body"))
    return n.join(bodies, F.col("file_id") == F.col("x")).filter(F.col("byte_end") <= F.octet_length("body")).drop("x"), f


@query("locate_hybrid_merge")
def locate_hybrid_merge(spark, folder):
    nodes, files = nodes_view(spark, folder), files_view(spark, folder, "file_id", "path", "language", "content")
    chunks = code.chunks(files, 1024).join(files.select("file_id", F.col("path").alias("p")), F.col("file") == F.col("p")).drop("p")
    vectors = R.embed(chunks, "chunk_id", "text")
    return L.hybrid_locate(nodes, chunks, vectors, "token budget", [float(x) for x in R.hash_embedding(["token budget"])[0]], 10)


_PRIO = f"{FILES}, {EDGES}, ie AS (SELECT to_file AS file, count(*) AS in_edges FROM (SELECT DISTINCT from_id, to_id, kind, confidence, from_file, to_file FROM e) WHERE to_file <> '' AND from_file <> to_file GROUP BY to_file), pr AS (SELECT f.file_id, f.path, content, coalesce(in_edges, 0) AS in_edges, CASE WHEN regexp_replace(path, '^.*/', '') IN ('main.rs', 'lib.rs', 'index.ts', 'index.tsx', '__main__.py', 'main.py') THEN 1 WHEN NOT contains(path, '/') AND path IN ('README.md', 'README.rst', 'CONTRIBUTING.md', 'ARCHITECTURE.md', 'LICENSE') THEN 2 WHEN modified <= TIMESTAMP '2031-03-01' AND modified >= TIMESTAMP '2031-03-01' - INTERVAL 7 DAYS THEN 3 ELSE 4 END AS rank FROM f LEFT JOIN ie ON ie.file = f.path)"


def _prioritized(spark, folder):
    edges = edges_view(spark, folder).select("from_id", "to_id", "kind", "confidence", "from_file", "to_file").distinct()
    return P.prioritized(files_view(spark, folder, "file_id", "path", "content", "modified"), P.in_edge_counts(edges), _NOW)


@query("pack_priority", f"WITH {_PRIO} SELECT path, CAST(rank AS INT) AS rank, in_edges FROM pr")
def pack_priority(spark, folder):
    return _prioritized(spark, folder).select("path", "rank", "in_edges")


@query("pack_order", f"WITH {_PRIO} SELECT path, rank FROM pr ORDER BY rank, CASE WHEN rank = 4 THEN -in_edges ELSE 0 END, path LIMIT 40")
def pack_order(spark, folder):
    return _prioritized(spark, folder).orderBy(*P.pack_order()).limit(40).select("path", "rank")


@query("pack_omitted", f"WITH {_PRIO}, o AS (SELECT path FROM pr WHERE content IS NOT NULL ORDER BY rank, CASE WHEN rank = 4 THEN -in_edges ELSE 0 END, path LIMIT 20) SELECT path FROM pr WHERE path NOT IN (SELECT path FROM o)")
def pack_omitted(spark, folder):
    p = _prioritized(spark, folder)
    kept = p.filter("content IS NOT NULL").orderBy(*P.pack_order()).limit(20).select("path")
    return p.select("path").join(kept, "path", "left_anti")


@query("pack_tokens", f"WITH {FILES} SELECT file_id, CAST(ceil(strlen(content) / 4) AS BIGINT) AS tokens FROM f WHERE content IS NOT NULL")
def pack_tokens(spark, folder):
    return files_view(spark, folder, "file_id", "content").filter("content IS NOT NULL").select("file_id", P.estimate_tokens(F.col("content")).alias("tokens"))


@query("pack_budget")
def pack_budget(spark, folder):
    return P.budgeted(_prioritized(spark, folder), P.pack_order(), 20_000)


# The fold of the budget, file by file: the share of a file is an equal part of what the ones before left.
_FOLD = (
    f"WITH RECURSIVE {_PRIO}, o AS (SELECT path, content, row_number() OVER (ORDER BY rank, CASE WHEN rank = 4 THEN -in_edges ELSE 0 END, path) AS i FROM pr WHERE content IS NOT NULL QUALIFY i <= (200000 - 1) // 120), n AS (SELECT count(*) AS n FROM o),"
    " q AS (SELECT i, path, content, CAST(ceil(strlen(content) / 4) AS BIGINT) AS whole, string_split(content, chr(10)) AS lines FROM o),"
    " r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(200000 - 120 * n AS BIGINT) AS room, '' AS path, '' AS content, false AS truncated, CAST(0 AS BIGINT) AS tokens, false AS kept FROM n UNION ALL"
    " SELECT i, room - CASE WHEN tokens <= share THEN tokens ELSE 0 END, path, content, truncated, tokens, tokens <= share FROM ("
    " SELECT i, room, path, share, whole > share AS truncated, CASE WHEN whole <= share THEN content ELSE cut END AS content, CASE WHEN whole <= share THEN whole ELSE CAST(ceil(strlen(cut) / 4) AS BIGINT) END AS tokens FROM ("
    " SELECT *, CASE WHEN whole > share THEN array_to_string(list_concat(lines[1:len(list_filter(range(1, len(lines) + 1), lambda k: list_sum(list_transform(lines[1:k], lambda x: ceil(strlen(x) / 4) + 1)) <= share - 4))], ['... [truncated]']), chr(10)) END AS cut FROM ("
    " SELECT q.i, r.room, q.path, q.content, q.whole, q.lines, r.room // (n.n - q.i + 1) AS share FROM r JOIN q ON q.i = r.i + 1, n))))"
    " SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS pos, path, content, truncated, tokens FROM r WHERE kept"
)


@query("pack_budget_large", _FOLD)
def pack_budget_large(spark, folder):
    """A budget that pays for the frames of all files and cuts most of them."""
    return P.budgeted(_prioritized(spark, folder), P.pack_order(), 200_000)


_XML = "'  <file path=\"' || replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\" tokens=\"' || CAST(ceil(strlen(content) / 4) AS BIGINT) || '\" truncated=\"false\">' || chr(10) || '<![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]>' || chr(10) || '  </file>' || chr(10)"


@query("pack_render_xml", f"WITH {FILES} SELECT file_id, {_XML} AS part FROM f WHERE content IS NOT NULL")
def pack_render_xml(spark, folder):
    f = files_view(spark, folder, "file_id", "path", "content").filter("content IS NOT NULL")
    return f.select("file_id", P.xml_element(F.col("path"), F.col("content"), F.lit(False), P.estimate_tokens(F.col("content"))).alias("part"))


@query("pack_render_md", f"WITH {FILES} SELECT file_id, '## File: ' || path || ' (tokens: ' || CAST(ceil(strlen(content) / 4) AS BIGINT) || ', truncated: false)' || chr(10) || chr(10) || '```' || CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'json' THEN 'json' ELSE '' END || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) AS part FROM f WHERE content IS NOT NULL")
def pack_render_md(spark, folder):
    f = files_view(spark, folder, "file_id", "path", "content").filter("content IS NOT NULL")
    return f.select("file_id", P.markdown_section(F.col("path"), F.col("content"), F.lit(False), P.estimate_tokens(F.col("content"))).alias("part"))
