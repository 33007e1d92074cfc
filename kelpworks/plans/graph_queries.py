"""Graph, intervals, imports, overview."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import imports as I
from ..operators import overview as O
from ..operators import text as T
from ..sources import code
from ..sources.tables import load
from ..streaming.changes import resolve_imports
from .catalog import query
from .common import EDGES, FILES, NODES, SYMBOLS, files_view, nodes_view, symbols_view
from .graph_common import edges_view


def _pick(df, column, where):
    """A constant for a lookup: the smallest value, as one row."""
    return df.filter(where).agg(F.min(column)).first()[0] or ""


@query("edge_kind_counts", f"WITH {EDGES} SELECT kind, count(*) AS n FROM (SELECT DISTINCT from_id, to_id, kind FROM e) GROUP BY kind")
def edge_kind_counts(spark, folder):
    return edges_view(spark, folder).dropDuplicates(["from_id", "to_id", "kind"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("edges_dedupe", f"WITH {EDGES} SELECT DISTINCT from_id, to_id, kind FROM e")
def edges_dedupe(spark, folder):
    return edges_view(spark, folder).dropDuplicates(["from_id", "to_id", "kind"]).select("from_id", "to_id", "kind")


@query("define_edges", f"WITH {SYMBOLS} SELECT symbol_id AS from_id, symbol_id AS to_id, 'Defines' AS kind, 'Resolved' AS confidence FROM s")
def define_edges(spark, folder):
    return G.define_edges(symbols_view(spark, folder))


_CALLS = f"WITH {EDGES}, x AS (SELECT min(to_name) AS name FROM e WHERE kind = 'Calls' AND to_name <> '')"


@query("callers", _CALLS + " SELECT from_file AS file, from_name AS name, min(from_id) AS symbol_id, count(DISTINCT from_id) AS sites FROM e, x WHERE kind = 'Calls' AND to_name = x.name GROUP BY from_file, from_name")
def callers(spark, folder):
    e = edges_view(spark, folder)
    name = _pick(e, "to_name", "kind = 'Calls' AND to_name <> ''")
    return G.callers(e, G.Selector(name=name)).withColumn("sites", F.size("sites").cast("long"))


_CALLEES = f"WITH {EDGES}, x AS (SELECT min(from_name) AS name FROM e WHERE kind = 'Calls' AND from_name <> '')"


@query("callees", _CALLEES + " SELECT to_file AS file, to_name AS name, min(to_id) AS symbol_id, count(DISTINCT regexp_extract(from_id, '::([0-9]+)$', 1)) AS sites FROM e, x WHERE kind = 'Calls' AND from_name = x.name GROUP BY to_file, to_name")
def callees(spark, folder):
    e = edges_view(spark, folder)
    name = _pick(e, "from_name", "kind = 'Calls' AND from_name <> ''")
    return G.callees(e, G.Selector(name=name)).withColumn("sites", F.size("sites").cast("long"))


@query("references_incoming", f"WITH {EDGES}, x AS (SELECT min(to_id) AS id FROM e WHERE kind = 'References') SELECT from_id, kind, confidence FROM e, x WHERE kind = 'References' AND to_id = x.id")
def references_incoming(spark, folder):
    e = edges_view(spark, folder)
    return G.incoming(e, G.Selector(symbol_id=_pick(e, "to_id", "kind = 'References'")), "References").select("from_id", "kind", "confidence")


@query("neighbours_outgoing", f"WITH {EDGES} SELECT from_id, to_id, kind FROM e WHERE contains(from_id, 'fold_record') ")
def neighbours_outgoing(spark, folder):
    return G.outgoing(edges_view(spark, folder), G.Selector(qualified="fold_record")).select("from_id", "to_id", "kind")


@query("imports_of", f"WITH {EDGES}, x AS (SELECT min(from_file) AS p FROM e WHERE kind = 'Imports' AND from_file <> '') SELECT DISTINCT to_file AS file FROM e, x WHERE kind = 'Imports' AND from_file = x.p")
def imports_of(spark, folder):
    e = edges_view(spark, folder)
    return G.imports_of(e, _pick(e, "from_file", "kind = 'Imports' AND from_file <> ''"))


@query("imported_by", f"WITH {EDGES}, x AS (SELECT max(to_file) AS p FROM e WHERE kind = 'Imports' AND to_file <> '') SELECT DISTINCT from_file AS file FROM e, x WHERE kind = 'Imports' AND to_file = x.p")
def imported_by(spark, folder):
    e = edges_view(spark, folder)
    return G.imported_by(e, e.filter("kind = 'Imports' AND to_file <> ''").agg(F.max("to_file")).first()[0] or "")


@query("import_neighbours", f"WITH {EDGES}, {FILES}, c AS (SELECT DISTINCT path FROM f WHERE repo = 'amber-anvil'), i AS (SELECT DISTINCT from_file, to_file FROM e WHERE kind = 'Imports') SELECT file FROM (SELECT to_file AS file FROM i WHERE from_file IN (SELECT path FROM c) UNION SELECT from_file FROM i WHERE to_file IN (SELECT path FROM c)) WHERE file NOT IN (SELECT path FROM c)")
def import_neighbours(spark, folder):
    changed = files_view(spark, folder, "repo", "path").filter("repo = 'amber-anvil'").select(F.col("path").alias("file"))
    return G.import_neighbours(edges_view(spark, folder), changed)


@query("find_definition", f"WITH {SYMBOLS}, {FILES}, x AS (SELECT min(name) AS name FROM s WHERE kind = 'class'), l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM f WHERE content <> ''), b AS (SELECT path, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM l) SELECT symbol_id, file, CAST(count(*) AS INT) AS start_line FROM s JOIN b ON b.path = s.file, x WHERE s.name = x.name AND at_ <= range_start GROUP BY symbol_id, file")
def find_definition(spark, folder):
    s = symbols_view(spark, folder)
    hit = s.filter(F.col("name") == _pick(s, "name", "kind = 'class'"))
    files = files_view(spark, folder, "file_id", "path", "content").filter("content <> ''")
    return hit.join(files, F.col("file") == F.col("path")).select("symbol_id", "file", T.line_of_byte(F.col("content"), F.col("range_start")).alias("start_line"))


# Chunks are lines here, with byte ranges.
_LINE_CHUNKS = "l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM f WHERE content <> ''), c AS (SELECT path AS file, t AS text, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0, CAST(sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e0 FROM l)"


def _line_chunks(spark, folder):
    files = files_view(spark, folder, "file_id", "path", "content").filter("content <> ''")
    lines = files.select("path", F.explode(F.arrays_zip(F.split("content", "\n").alias("t"), T.start_bytes(F.col("content")).alias("s"))).alias("l"))
    return lines.select(F.col("path").alias("file"), F.col("l.s").alias("range_start"), (F.col("l.s") + F.octet_length("l.t") + 1).alias("range_end"), F.col("l.t").alias("text"))


@query("word_index", f"WITH {FILES}, w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM f) SELECT word, count(*) AS files FROM w GROUP BY word")
def word_index(spark, folder):
    f = files_view(spark, folder, "file_id", "content")
    return f.select("file_id", F.explode(G.words_of(F.col("content"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


@query("called_words", f"WITH {FILES}, w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS word FROM f) SELECT word, count(*) AS files FROM w GROUP BY word")
def called_words(spark, folder):
    f = files_view(spark, folder, "file_id", "content")
    return f.select("file_id", F.explode(G.called_words(F.col("content"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


_REFS = f"WITH {SYMBOLS}, {FILES}, {_LINE_CHUNKS}, m AS (SELECT DISTINCT s.symbol_id, s.file, unnest(regexp_extract_all(text, '%s'%s)) AS word FROM s JOIN c ON s.file = c.file AND s.range_start < c.e0 AND c.s0 < s.range_end WHERE lower(s.kind) NOT IN ('variable', 'constant'))"
_R = _REFS % ("[A-Za-z_][A-Za-z0-9_]*", "")
_C = _REFS % ("([A-Za-z_][A-Za-z0-9_]*)\\(", ", 1")


@query("identifier_refs", _R + " SELECT DISTINCT m.symbol_id AS from_id, t.symbol_id AS to_id FROM m JOIN s t ON t.file = m.file AND t.name = m.word AND t.symbol_id <> m.symbol_id")
def identifier_refs(spark, folder):
    e = G.reference_edges(symbols_view(spark, folder), _line_chunks(spark, folder))
    return e.filter("kind = 'References'").select("from_id", "to_id").distinct()


@query("call_edges", _C + " SELECT DISTINCT m.symbol_id AS from_id, t.symbol_id AS to_id FROM m JOIN s t ON t.file = m.file AND t.name = m.word AND t.symbol_id <> m.symbol_id AND t.kind IN ('function', 'method')")
def call_edges(spark, folder):
    e = G.reference_edges(symbols_view(spark, folder), _line_chunks(spark, folder))
    return e.filter("kind = 'Calls'").select("from_id", "to_id").distinct()


_ITEMS = "i AS (SELECT DISTINCT from_file AS file, to_file AS target_file, to_name AS item FROM e WHERE kind = 'Imports' AND from_file <> '' AND to_file <> ''), t AS (SELECT file, name, arg_min(symbol_id, (range_start, symbol_id)) AS to_id FROM s GROUP BY ALL), p AS (SELECT DISTINCT s.symbol_id AS from_id, t.to_id FROM i JOIN t ON i.target_file = t.file AND i.item = t.name JOIN s ON s.file = i.file)"


def _items(spark, folder):
    e = edges_view(spark, folder).filter("kind = 'Imports' AND from_file <> '' AND to_file <> ''")
    return e.select(F.col("from_file").alias("file"), F.col("to_file").alias("target_file"), F.array("to_name").alias("items")).distinct()


@query("import_edges", f"WITH {EDGES}, {SYMBOLS}, {_ITEMS} SELECT from_id, to_id, 'Imports' AS kind FROM p UNION SELECT to_id, from_id, 'ImportedBy' FROM p")
def import_edges(spark, folder):
    return G.import_edges(symbols_view(spark, folder), _items(spark, folder)).select("from_id", "to_id", "kind").distinct()


# One scan of the words for both kinds: a call is an occurrence with a parenthesis.
_BUILT = (
    f"WITH {SYMBOLS}, {FILES}, {EDGES}, {_LINE_CHUNKS}, {_ITEMS}, src AS (SELECT * FROM s WHERE lower(kind) NOT IN ('variable', 'constant')),"
    " w AS (SELECT DISTINCT file, s0, e0, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*\\(?')) AS said FROM c),"
    " m AS (SELECT DISTINCT src.symbol_id, src.file, rtrim(said, '(') AS word, suffix(said, '(') AS called FROM src JOIN w ON src.file = w.file AND src.range_start < w.e0 AND w.s0 < src.range_end WHERE src.range_end > src.range_start),"
    " x AS (SELECT m.symbol_id AS from_id, q.symbol_id AS to_id, bool_or(called AND lower(q.kind) IN ('function', 'method')) AS calls FROM m JOIN s q ON q.file = m.file AND q.name = m.word AND q.symbol_id <> m.symbol_id GROUP BY ALL)"
    " SELECT symbol_id AS from_id, symbol_id AS to_id, 'Defines' AS kind, 'Resolved' AS confidence FROM s"
    " UNION SELECT from_id, to_id, 'References', 'Heuristic' FROM x UNION SELECT from_id, to_id, 'Calls', 'Heuristic' FROM x WHERE calls"
    " UNION SELECT from_id, to_id, 'Imports', 'Heuristic' FROM p UNION SELECT to_id, from_id, 'ImportedBy', 'Heuristic' FROM p"
)


@query("edges_build", _BUILT)
def edges_build(spark, folder):
    return G.build_edges(symbols_view(spark, folder), _line_chunks(spark, folder), _items(spark, folder))


@query("refresh_edges", _BUILT)
def refresh_edges(spark, folder):
    """The index of 10 March 2031 brought up to date: every file with a symbol that came or went since is refreshed."""
    seen = load(spark, folder, "symbols", "symbol_id", "name", "kind", "file", "range_start", "range_end", "signature", "parent_id", "seen_at", "deleted_at")
    split = F.lit(datetime.datetime(2031, 3, 10))
    then = seen.filter((F.col("seen_at") < split) & (F.col("deleted_at").isNull() | (F.col("deleted_at") >= split))).drop("seen_at", "deleted_at").distinct()
    changed = seen.filter((F.col("seen_at") >= split) | (F.col("deleted_at") >= split)).select("file").distinct()
    chunks, items = _line_chunks(spark, folder), _items(spark, folder)
    old = G.with_parts(G.build_edges(then, chunks, items))
    return G.refresh_edges(old, symbols_view(spark, folder), chunks, items, changed).select("from_id", "to_id", "kind", "confidence")


@query("outline_tree", f"WITH RECURSIVE {SYMBOLS}, p AS (SELECT s.symbol_id, s.name, q.symbol_id AS parent FROM s LEFT JOIN s q ON q.symbol_id = s.parent_id AND q.file = s.file), r AS (SELECT symbol_id, name, 0 AS depth, name AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.symbol_id, p.name, depth + 1, path || '/' || p.name FROM p JOIN r ON p.parent = r.symbol_id) SELECT symbol_id, CAST(depth AS INT) AS depth, path FROM r")
def outline_tree(spark, folder):
    return G.outline(symbols_view(spark, folder)).select("symbol_id", "depth", "path")


@query("outline_depth", "SELECT 0 AS depth, count(*) AS n FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def outline_depth(spark, folder):
    r = load(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("symbol_id"), F.col("r_name").alias("name"), F.lit("x").alias("file"), F.lit(None).cast("string").alias("parent_id"))
    n = load(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("symbol_id"), F.col("n_name").alias("name"), F.lit("x").alias("file"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = load(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("symbol_id"), F.col("c_name").alias("name"), F.lit("x").alias("file"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return G.outline(r.unionByName(n).unionByName(c), 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("interval_overlap", f"WITH {SYMBOLS} SELECT a.symbol_id AS a_id, b.symbol_id AS b_id FROM s a JOIN s b ON a.file = b.file AND a.range_start < b.range_end AND b.range_start < a.range_end WHERE a.kind = 'class' AND b.kind = 'method' AND a.range_end > a.range_start AND b.range_end > b.range_start")
def interval_overlap(spark, folder):
    s = symbols_view(spark, folder)
    side = lambda kind, p: s.filter(F.col("kind") == kind).select("file", F.col("symbol_id").alias(f"{p}_id"), F.col("range_start").alias(f"{p}_start"), F.col("range_end").alias(f"{p}_end"))
    return G.overlapping(side("class", "a"), side("method", "b"), "file").select("a_id", "b_id")


_OKN = "m AS (SELECT * FROM n WHERE byte_start >= 0 AND byte_end >= byte_start)"


@query("enclosing_smallest", f"WITH {NODES}, {_OKN}, p AS (SELECT id AS point_id, file_id, byte_start + (byte_end - byte_start) // 2 AS at_ FROM m) SELECT point_id, arg_min(m.id, (byte_end - byte_start, m.id)) AS node_id FROM p JOIN m ON p.file_id = m.file_id AND byte_start <= at_ AND at_ <= byte_end GROUP BY point_id")
def enclosing_smallest(spark, folder):
    n = nodes_view(spark, folder)
    points = n.filter("byte_start >= 0 AND byte_end >= byte_start").select(F.col("id").alias("point_id"), "file_id", F.expr("byte_start + (byte_end - byte_start) div 2").alias("at"))
    return G.enclosing_smallest(points, n)


@query("scope_containment", f"WITH {NODES}, {_OKN} SELECT c.id, p.id AS scope FROM m c JOIN m p ON c.parent_id = p.id WHERE c.byte_start >= p.byte_start AND c.byte_end <= p.byte_end")
def scope_containment(spark, folder):
    n = nodes_view(spark, folder).filter("byte_start >= 0 AND byte_end >= byte_start")
    p = n.select(F.col("id").alias("scope"), F.col("byte_start").alias("s0"), F.col("byte_end").alias("e0"))
    return n.join(p, F.col("parent_id") == F.col("scope")).filter("byte_start >= s0 AND byte_end <= e0").select("id", "scope")


@query("parent_assign", f"WITH {NODES}, {_OKN}, j AS (SELECT c.id, arg_max(p.id, (p.depth, p.byte_start, p.id)) AS parent FROM m c JOIN m p ON c.file_id = p.file_id AND p.id <> c.id AND p.byte_start <= c.byte_start AND p.byte_end >= c.byte_end AND p.depth < c.depth GROUP BY c.id) SELECT id, parent FROM j")
def parent_assign(spark, folder):
    return G.nearest_parent(nodes_view(spark, folder).filter("byte_start >= 0 AND byte_end >= byte_start"))


@query("parent_lookup", f"WITH {NODES} SELECT c.id, p.label AS parent_label, p.byte_end - p.byte_start AS parent_bytes FROM n c LEFT JOIN n p ON c.parent_id = p.id")
def parent_lookup(spark, folder):
    n = nodes_view(spark, folder)
    p = n.select(F.col("id").alias("p_id"), F.col("label").alias("parent_label"), (F.col("byte_end") - F.col("byte_start")).alias("parent_bytes"))
    return n.join(p, F.col("parent_id") == F.col("p_id"), "left").select("id", "parent_label", "parent_bytes")


# --- imports ------------------------------------------------------------------------------------

_RAW = "r AS (SELECT DISTINCT path, trim(unnest(string_split(content, chr(10))), ' ' || chr(13)) AS raw FROM f WHERE path LIKE '%{ext}' AND content IS NOT NULL), i AS (SELECT * FROM r WHERE regexp_matches(raw, '{pat}'))"


def _raw(spark, folder, ext, pattern):
    f = files_view(spark, folder, "file_id", "path", "content").filter(F.col("path").endswith(ext))
    return f.select("path", F.explode(F.split("content", "\n")).alias("raw")).select("path", F.trim(F.col("raw"), F.lit(" \r")).alias("raw")).filter(F.col("raw").rlike(pattern)).distinct()


def _flat(df, parsed, target):
    return df.select("path", "raw", parsed.alias("p")).select("path", "raw", F.array_join("p.module_path", "|").alias("module"), F.array_join("p.items", "|").alias("items"), target(F.col("p.module_path")).alias("target"))


@query("import_parse_rs", f"WITH {FILES}, " + _RAW.format(ext=".rs", pat=r"^use crate::[a-z_]+::\{[^}]*\};$") + r" SELECT path, raw, regexp_extract(raw, 'crate::([a-z_]+)', 1) AS module, array_to_string(list_transform(string_split(regexp_extract(raw, '\{([^}]*)\}', 1), ','), lambda x: trim(x)), '|') AS items, 'src/' || regexp_extract(raw, 'crate::([a-z_]+)', 1) || '.rs' AS target FROM i")
def import_parse_rs(spark, folder):
    return _flat(_raw(spark, folder, ".rs", r"^use crate::[a-z_]+::\{[^}]*\};$"), I.rust_use(F.col("raw")), I.resolve_rust)


@query("import_parse_ts", f"WITH {FILES}, " + _RAW.format(ext=".ts", pat=r"^import \{ [A-Za-z]+ \} from ..?/?[a-z]*.;$") + r" SELECT path, raw, '.|' || regexp_extract(raw, '/([a-z]+)', 1) AS module, regexp_extract(raw, '\{ ([A-Za-z]+) \}', 1) AS items, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_extract(raw, '/([a-z]+)', 1) || '.ts' AS target FROM i")
def import_parse_ts(spark, folder):
    return _flat(_raw(spark, folder, ".ts", r"^import \{ [A-Za-z]+ \} from ..?/?[a-z]*.;$"), I.ts_import(F.col("raw")), lambda m: I.resolve_ts(F.col("path"), m))


@query("import_parse_py", f"WITH {FILES}, " + _RAW.format(ext=".py", pat=r"^from \.[a-z]+ import [a-z_0-9]+$") + r" SELECT path, raw, regexp_extract(raw, '\.([a-z]+)', 1) AS module, regexp_extract(raw, 'import ([a-z_0-9]+)$', 1) AS items, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_extract(raw, '\.([a-z]+)', 1) || '.py' AS target FROM i")
def import_parse_py(spark, folder):
    return _flat(_raw(spark, folder, ".py", r"^from \.[a-z]+ import [a-z_0-9]+$"), I.py_import(F.col("raw")), lambda m: I.resolve_py(F.col("path"), F.col("raw")))


@query("imports_resolved")
def imports_resolved(spark, folder):
    """Every import statement of the sources, of any shape, with its items and the file it stands for."""
    files = files_view(spark, folder, "file_id", "path", "language", "content")
    return resolve_imports(code.imports(files)).select("file", "raw", F.array_join("items", "|").alias("items"), "target_file")


# --- overview -----------------------------------------------------------------------------------


@query("lang_histogram", f"WITH {FILES} SELECT language, count(*) AS files FROM f WHERE language IS NOT NULL GROUP BY language")
def lang_histogram(spark, folder):
    return O.language_counts(files_view(spark, folder, "file_id", "language"))


@query("lang_histogram_all", f"WITH {FILES} SELECT coalesce(language, 'unknown') AS language, count(*) AS files FROM f GROUP BY ALL")
def lang_histogram_all(spark, folder):
    return O.language_counts(files_view(spark, folder, "file_id", "language"), "unknown")


@query("repo_totals", f"WITH {FILES} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM f")
def repo_totals(spark, folder):
    return O.totals(files_view(spark, folder, "file_id", "size"))


@query("largest_files", f"WITH {FILES} SELECT path, size FROM f WHERE size IS NOT NULL ORDER BY size DESC, path LIMIT 12")
def largest_files(spark, folder):
    return O.largest(files_view(spark, folder, "file_id", "path", "size"))


_SHORT = "g AS (SELECT repo, regexp_replace(path, '^[^/]+/', '') AS path, regexp_replace(regexp_replace(path, '^[^/]+/', ''), '^.*/', '') AS name, content FROM f)"


@query("entry_points", f"WITH {FILES} SELECT path FROM f WHERE path IN ('src/main.rs', 'src/lib.rs', 'main.rs', 'lib.rs', 'src/index.ts', 'src/index.js', 'src/index.py')")
def entry_points(spark, folder):
    return O.entry_points(files_view(spark, folder, "file_id", "path"))


@query("readme_excerpt", f"WITH {FILES}, g AS (SELECT regexp_replace(path, '^.*/', '') AS path, content, path AS whole FROM f), b AS (SELECT content FROM g WHERE path IN ('README.md', 'README', 'readme.md') AND content IS NOT NULL ORDER BY whole LIMIT 1) SELECT array_to_string(string_split(content, chr(10))[1:10], chr(10)) AS excerpt FROM b")
def readme_excerpt(spark, folder):
    f = files_view(spark, folder, "file_id", "path", "content").filter("content IS NOT NULL").withColumn("name", F.substring_index("path", "/", -1)).filter(F.col("name").isin(*O.README_NAMES))
    return O.readme_excerpt(f.orderBy("path").limit(1).withColumn("path", F.col("name")))


@query("tree_listing", f"WITH {FILES}, d AS (SELECT DISTINCT path FROM f ORDER BY path LIMIT 500), t AS (SELECT path, string_split(path, '/')[1:3] AS parts FROM d), x AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS prefix, i - 1 AS level, parts[i] AS name FROM t, range(1, 4) r(i) WHERE i <= len(parts)) SELECT CAST(level AS INT) AS level, name, count(*) AS n FROM x GROUP BY ALL")
def tree_listing(spark, folder):
    return O.tree(files_view(spark, folder, "path")).groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"))


@query("index_status", f"WITH {FILES}, {SYMBOLS}, {NODES} SELECT 'files' AS tab, count(*) AS rows FROM f UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'vectors', count(DISTINCT vec_id) FROM vectors")
def index_status(spark, folder):
    return O.status(files=files_view(spark, folder, "file_id", "path"), symbols=symbols_view(spark, folder), nodes=nodes_view(spark, folder), vectors=load(spark, folder, "vectors", "vec_id").distinct())
