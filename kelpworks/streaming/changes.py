"""Change events: polling diffs, debouncing, rate limits and incremental refresh.

Batch functions work on any DataFrame of events; the stream functions use them with watermarks or in
foreachBatch, so a stream's state is bounded by its watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "500 milliseconds"
RATE_LIMIT, RATE_SECONDS = 60, 60
POLL = "5 seconds"


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", marks: tuple[str, ...] = ("modified", "size")) -> DataFrame:
    """`key, change` of two snapshots: created, modified (any mark differs) or removed."""
    b = before.select(F.col(key).alias("b_key"), *(F.col(m).alias(f"b_{m}") for m in marks))
    a = after.select(F.col(key).alias("a_key"), *(F.col(m).alias(f"a_{m}") for m in marks))
    same = F.lit(True)
    for m in marks:
        same = same & F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}"))
    change = F.when(F.col("b_key").isNull(), "created").when(F.col("a_key").isNull(), "removed").when(~same, "modified")
    return b.join(a, F.col("b_key") == F.col("a_key"), "full_outer").select(F.coalesce("a_key", "b_key").alias(key), change.alias("change")).filter("change IS NOT NULL")


def latest_per_path(events: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last event of each path, by a partial aggregate."""
    rest = [c for c in events.columns if c != key and c not in order]
    best = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


#: Microseconds of the units of a gap.
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def micros_of(gap: str) -> int:
    """Microseconds of a text such as "500 milliseconds"."""
    number, unit = gap.split()
    return round(float(number) * _UNITS[unit.rstrip("s")])


def debounced(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = DEBOUNCE) -> DataFrame:
    """`key, start, end, events`: bursts of a path's events that no pause of `gap` interrupts. Works on streams, too.

    In a batch the events of one path and one stretch of `gap` are one burst for certain, so they are counted first, on
    the map side; a path with a third of all events is put in order by its stretches only.
    """
    if events.isStreaming:
        return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    width = micros_of(gap)
    kind = events.schema[ts].dataType
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stretches = events.filter(F.col(ts).isNotNull()).groupBy(key, F.floor(at / width).alias("_s")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_s")
    begins = F.coalesce(F.col("_first") >= F.lag("_last").over(w) + width, F.lit(True))
    bursts = stretches.withColumn("_new", begins.cast("int")).withColumn("_burst", F.sum("_new").over(w))
    out = bursts.groupBy(key, "_burst").agg(F.min("_first").alias("a"), F.max("_last").alias("b"), F.sum("_n").alias("events"))
    time = lambda c: F.timestamp_micros(c).cast(kind)
    return out.select(key, time(F.col("a")).alias("start"), time(F.col("b") + width).alias("end"), "events")


def rate_of(batches: DataFrame, by: str, ts: str = "ts", limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """Adds `recent`, the events of the trailing window, and whether they exceed the limit.

    Each event is counted in the bucket of its own time and, as context, in the next one, so a window
    holds two buckets of one key, however many events the key has.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(F.col("_at") / width)
    own = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = batches.withColumn("_at", at).select("*", own.alias("_own")).withColumn("_bucket", bucket + F.when(F.col("_own"), 0).otherwise(1))
    w = Window.partitionBy(by, "_bucket").orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = rows.withColumn("recent", F.count(F.lit(1)).over(w)).filter("_own")
    return counted.drop("_at", "_own", "_bucket").withColumn("over_limit", F.col("recent") > limit)


def tumbling(events: DataFrame, ts: str, width: str, *by: str, slide: str | None = None) -> DataFrame:
    """`start, by…, n` per window; give slide for overlapping windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


# --- streams ------------------------------------------------------------------------------------


def change_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Change events from files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def debounced_stream(events: DataFrame, key: str = "path", ts: str = "ts", late: str = "10 seconds", gap: str = DEBOUNCE) -> DataFrame:
    return debounced(events.withWatermark(ts, late), key, ts, gap)


def windowed_stream(events: DataFrame, ts: str, width: str, *by: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    return tumbling(events.withWatermark(ts, late), ts, width, *by, slide=slide)


def reindex_stream(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = POLL, key: str = "path", order: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """Runs `refresh(latest change per path, batch id)` for each batch; refresh must be idempotent by batch id."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(latest_per_path(batch, key, order), batch_id)

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def poll_once(snapshot: Callable[[], DataFrame], store, on_changes: Callable[[DataFrame], None], version: int, table: str = "polled", keep: int = 4) -> None:
    """Stores a snapshot as `version` and reports how it differs from the stored version before it.

    The listing is evaluated once, as it is written, so a change during a tick is in this report or in the next. A
    tick that is repeated after a failure finds its version stored and reports the same difference again.
    """
    store.write(table, snapshot(), version)
    older = [v for v in store.versions(table) if v < version]
    now = store.read(table, version)
    on_changes(snapshot_diff(store.read(table, older[-1]) if older else now.limit(0), now))
    store.drop_before(table, keep)


def poll_stream(spark: SparkSession, snapshot: Callable[[], DataFrame], store, on_changes: Callable[[DataFrame], None], checkpoint: str, every: str = POLL) -> StreamingQuery:
    """Compares a fresh snapshot with the stored one at each tick; `store` is a SnapshotStore, table `polled`.

    on_changes gets each difference at least once; it must be idempotent.
    """
    source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return source.writeStream.foreachBatch(lambda _, batch_id: poll_once(snapshot, store, on_changes, batch_id)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# --- incremental refresh ------------------------------------------------------------------------


def refresh_index(tables: dict[str, DataFrame], changes: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """The next state of `files, nodes, symbols, chunks, imports, edges` after changes (path, change).

    current has the present files (path, hash, language, size, modified, content, file_id). Files that were removed
    vanish from every table; created and modified ones are read anew. Edges are rebuilt for them and for the
    imports between them and others, in either direction; the result is that of build_index over `current`.
    """
    from ..operators import graph as G
    from ..operators.upserts import delete_files

    paths = changes.select("path").distinct()
    fresh = current.join(changes.filter("change <> 'removed'").select("path").distinct(), "path", "left_semi").select(*tables["files"].columns)
    old = {k: tables[k] for k in ("nodes", "symbols", "chunks", "imports")}
    left = delete_files(paths, tables["files"], **old)
    out = {"files": left["files"].unionByName(fresh)}
    for name, df in parsed_tables(fresh).items():
        out[name] = left[name].unionByName(df.select(*left[name].columns))
    out["edges"] = G.refresh_edges(tables["edges"], out["symbols"], out["chunks"], out["imports"], paths.select(F.col("path").alias("file")))
    return out


def resolve_imports(imports: DataFrame) -> DataFrame:
    """Import statements (file, language, raw) with `target_file` and `items`."""
    from ..operators import imports as I

    raw = F.col("raw")
    parsed = F.when(F.col("language") == "rust", I.rust_use(raw)).when(F.col("language") == "typescript", I.ts_import(raw)).when(F.col("language") == "python", I.py_import(raw))
    p = imports.withColumn("p", parsed)
    return p.select(*imports.columns, I.resolve(F.col("language"), F.col("file"), raw, F.col("p.module_path")).alias("target_file"), F.col("p.items").alias("items"))


def parsed_tables(files: DataFrame) -> dict[str, DataFrame]:
    """What is read from the texts of files alone: `nodes, symbols, chunks, imports`.

    Code is read at once and once for its three tables; what was read lies in the shared folder.
    """
    from ..session import cut
    from ..sources import code, structural

    parts = code.parts_of(cut(code.parse(files)))
    return {"nodes": structural.structural_nodes(files), "symbols": parts["symbols"], "chunks": parts["chunks"], "imports": resolve_imports(parts["imports"])}


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """All tables from the files, as refresh_index keeps them."""
    from ..operators import graph as G

    t = parsed_tables(files)
    return {"files": files, **t, "edges": G.with_parts(G.build_edges(t["symbols"], t["chunks"], t["imports"]))}
