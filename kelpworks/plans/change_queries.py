"""Change events and windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pack import scope_files
from ..sources.tables import load
from ..streaming import changes as C
from .catalog import query
from .common import EDGES
from .graph_common import edges_view


def _scans_at(spark, folder, day):
    s = load(spark, folder, "file_scans", "path", "hash", "modified", "arrived_at", "scan_id").filter(f"hash IS NOT NULL AND arrived_at < TIMESTAMP_NTZ '{day}'")
    return C.latest_per_path(s, "path", ("arrived_at", "scan_id")).select("path", "hash", "modified")


def _at(day: str) -> str:
    return f"(SELECT path, arg_max(hash, (arrived_at, scan_id)) AS hash, arg_max(modified, (arrived_at, scan_id)) AS modified FROM (SELECT path, hash, coalesce(modified, TIMESTAMP '1900-01-01') AS modified, arrived_at, scan_id FROM file_scans) WHERE hash IS NOT NULL AND arrived_at < TIMESTAMP '{day}' GROUP BY path)"


@query("snapshot_diff", f"WITH b AS {_at('2031-03-08')}, a AS {_at('2031-03-15')} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash OR a.modified <> b.modified")
def snapshot_diff(spark, folder):
    return C.snapshot_diff(_scans_at(spark, folder, "2031-03-08"), _scans_at(spark, folder, "2031-03-15"), marks=("hash", "modified"))


def _events(spark, folder):
    return load(spark, folder, "events", "event_id", "ts", "user_id", "event_type")


@query("latest_per_path", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_path(spark, folder):
    return C.latest_per_path(_events(spark, folder), "user_id").select("user_id", "ts", "event_id")


@query(
    "debounce_sessions",
    "WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS end_, count(*) AS events FROM s GROUP BY user_id, n",
)
def debounce_sessions(spark, folder):
    return C.debounced(_events(spark, folder), "user_id", gap="2 hours").withColumnRenamed("end", "end_")


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_limit_window(spark, folder):
    return C.rate_of(_events(spark, folder), "event_type", seconds=3600).select("event_id", "recent")


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, folder):
    return C.tumbling(_events(spark, folder), "ts", "1 hour", "event_type")


@query("sliding_counts", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type FROM events, range(0, 2) r(k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark, folder):
    return C.tumbling(_events(spark, folder), "ts", "2 hours", "event_type", slide="1 hour")


@query("hit_intersection", "SELECT query_id, chunk_id FROM semantic_hits WHERE source = 'bm25' INTERSECT SELECT query_id, chunk_id FROM semantic_hits WHERE source = 'vector'")
def hit_intersection(spark, folder):
    h = load(spark, folder, "semantic_hits", "query_id", "chunk_id", "source")
    part = lambda s: h.filter(F.col("source") == s).select("query_id", "chunk_id")
    return part("bm25").intersect(part("vector"))


@query("hit_union_first", "WITH u AS (SELECT DISTINCT file, byte_start, byte_end, hit_id, CASE source WHEN 'bm25' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END AS o FROM semantic_hits) SELECT file, byte_start, byte_end, arg_min(hit_id, (o, hit_id)) AS hit_id FROM u GROUP BY file, byte_start, byte_end")
def hit_union_first(spark, folder):
    h = load(spark, folder, "semantic_hits", "file", "byte_start", "byte_end", "hit_id", "source")
    order = F.when(F.col("source") == "bm25", 0).when(F.col("source") == "vector", 1).otherwise(2)
    return h.groupBy("file", "byte_start", "byte_end").agg(F.min(F.struct(order.alias("o"), "hit_id")).alias("m")).select("file", "byte_start", "byte_end", "m.hit_id")


@query("edge_set_union", f"WITH {EDGES} SELECT from_id, to_id FROM e WHERE kind = 'Calls' UNION SELECT from_id, to_id FROM e WHERE kind = 'References'")
def edge_set_union(spark, folder):
    e = edges_view(spark, folder)
    return e.filter("kind = 'Calls'").select("from_id", "to_id").union(e.filter("kind = 'References'").select("from_id", "to_id")).distinct()


@query("symbol_scope_files", f"WITH {EDGES}, x AS (SELECT min(to_name) AS name FROM e WHERE kind = 'Calls' AND to_name <> '') SELECT DISTINCT file FROM (SELECT to_file AS file FROM e, x WHERE to_name = x.name UNION SELECT to_file FROM e, x WHERE kind = 'Calls' AND from_name = x.name UNION SELECT from_file FROM e, x WHERE kind = 'References' AND to_name = x.name)")
def symbol_scope_files(spark, folder):
    e = edges_view(spark, folder)
    name = e.filter("kind = 'Calls' AND to_name <> ''").agg(F.min("to_name")).first()[0] or ""
    paths = e.select(F.col("to_file").alias("path")).union(e.select("from_file")).distinct()
    symbols = e.select(F.col("to_name").alias("name"), F.col("to_file").alias("file")).distinct()
    return scope_files(paths, e, symbols, symbol=name).withColumnRenamed("path", "file")
