"""Queries for increments (p3) and orphan references (p7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.increments import IncrementLedger, changed_per_run, replay, run_windows
from ..operators.orphans import orphan_counts, orphan_references
from ..sources.tables import load
from ..session import shared_dir
from .catalog import query

_CHANGED = """
WITH ok AS (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'ok'),
s AS (SELECT DISTINCT path, hash, arrived_at, scan_id FROM file_scans WHERE path IS NOT NULL AND hash IS NOT NULL AND arrived_at IS NOT NULL AND scan_id IS NOT NULL),
state AS (
  SELECT run_id, started_at, path, arg_max(hash, (arrived_at, scan_id)) AS hash
  FROM ok JOIN s ON s.arrived_at <= ok.started_at GROUP BY ALL),
changed AS (
  SELECT run_id, path, hash, lag(hash) OVER (PARTITION BY path ORDER BY started_at, run_id) AS before FROM state)
"""


@query("p3_found", _CHANGED + "SELECT run_id, path FROM changed WHERE before IS NULL OR before <> hash")
def p3_found(spark, folder):
    return changed_per_run(load(spark, folder, "file_scans"), load(spark, folder, "index_runs")).select("run_id", "path")


@query("p3_counts", _CHANGED + "SELECT run_id, count(*) AS n FROM changed WHERE before IS NULL OR before <> hash GROUP BY run_id")
def p3_counts(spark, folder):
    return p3_found(spark, folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("p3_ledger", _CHANGED + "SELECT run_id, path FROM changed WHERE before IS NULL OR before <> hash")
def p3_ledger(spark, folder):
    """p3_found by live runs: every run of the history takes its records, the failed and killed ones in vain."""
    ledger = IncrementLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", compact_every=8)
    return replay(ledger, load(spark, folder, "file_scans"), load(spark, folder, "index_runs")).select("run_id", "path")


@query(
    "p3_windows",
    """
WITH r AS (SELECT DISTINCT run_id, started_at, finished_at, status FROM index_runs),
c AS (SELECT *, coalesce(finished_at, lead(started_at) OVER (ORDER BY started_at, run_id)) AS closed FROM r),
k AS (SELECT run_id, row_number() OVER w AS seq, started_at AS high, lag(started_at) OVER w AS prev_high FROM c WHERE status = 'ok' WINDOW w AS (ORDER BY started_at, run_id))
SELECT k.run_id, CAST(k.seq AS INT) AS seq, k.high, k.prev_high, coalesce(min(c.started_at), k.prev_high) AS low
FROM k LEFT JOIN c ON c.started_at <= k.prev_high AND (c.closed IS NULL OR c.closed >= k.prev_high) GROUP BY k.run_id, k.seq, k.high, k.prev_high
""",
)
def p3_windows(spark, folder):
    return run_windows(load(spark, folder, "index_runs"))


_ORPHANS = """
WITH r AS (
  SELECT DISTINCT edge_id, observed_at AS t0, 'from' AS side, from_id AS id FROM edges WHERE from_id <> ''
  UNION SELECT DISTINCT edge_id, observed_at, 'to', to_id FROM edges WHERE to_id <> ''),
x AS (SELECT r.* FROM r WHERE id NOT IN (SELECT symbol_id FROM external_symbols)),
j AS (
  SELECT edge_id, side, t0, count(symbol_id) AS known,
         coalesce(bool_or(seen_at <= t0 AND (deleted_at IS NULL OR deleted_at > t0)), false) AS alive,
         coalesce(bool_or(deleted_at <= t0), false) AS ended
  FROM x LEFT JOIN symbols s ON s.symbol_id = x.id GROUP BY edge_id, side, t0, id),
o AS (
  SELECT edge_id, side, CASE WHEN known = 0 THEN 'missing' WHEN ended THEN 'deleted' ELSE 'late' END AS reason, CAST(t0 AS DATE) AS day
  FROM j WHERE known = 0 OR (NOT alive AND t0 IS NOT NULL))
"""


def _orphans(spark, folder):
    return orphan_references(load(spark, folder, "edges"), load(spark, folder, "symbols"), load(spark, folder, "external_symbols"))


@query("p7_found", _ORPHANS + "SELECT DISTINCT edge_id, side, reason FROM o")
def p7_found(spark, folder):
    return _orphans(spark, folder).select("edge_id", "side", "reason")


@query("p7_counts", _ORPHANS + "SELECT side, reason, day, count(*) AS n FROM o GROUP BY ALL")
def p7_counts(spark, folder):
    return orphan_counts(_orphans(spark, folder))
