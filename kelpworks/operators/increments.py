"""Processing only new or changed records.

Each run rereads from the start of the oldest run that was still open when the last successful run
began, and an anti-join of key-and-version pairs against the ledger of processed versions removes
the overlap. A failed or killed run commits nothing, so its records come to the next successful run.

Two forms share these rules:

* `changed_per_run` derives the increments of a whole run history in one plan. There every row counts as visible from
  its arrival on, so each row of an overlap was within reach of an earlier run and the anti-join removes it;
* `IncrementLedger` executes one live run at a time against a ledger in the shared folder. Rows that became visible
  after their arrival are met by the reread, and the anti-join tells them from those already processed.

Defined cases: repeated rows are one version; a null hash is no state (the file could not be read);
null keys, versions or arrival times are ignored; ties of arrival are resolved by the larger version
id; empty inputs give empty results; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import group_ranks
from ..session import cut


def run_windows(runs: DataFrame, one_task: int = 100_000) -> DataFrame:
    """`run_id, seq, low, high, prev_high` of each `ok` run, in order of started_at (then run_id).

    high is the run's start and prev_high that of the `ok` run before it. low is the start of the
    oldest run open at prev_high: one that began by then and had not finished. A killed run has no
    end of its own; it counts as ended when the next run starts. A history of up to `one_task` runs, whose size is
    checked, is put in order in one task, a longer one by distributed ranks; open runs meet by days.
    """
    few = runs.count() <= one_task
    runs = runs.select("run_id", "started_at", "finished_at", "status").filter("run_id IS NOT NULL AND started_at IS NOT NULL").dropDuplicates(["run_id"])
    in_order = [F.col("started_at").asc(), F.col("run_id").asc()]

    def neighbour(df: DataFrame, step: int, out: str) -> DataFrame:
        """Adds `_place` in order, and the start `step` places on as `out`."""
        if few:
            w = Window.partitionBy(F.lit(0)).orderBy(*in_order)
            return df.withColumn("_place", F.row_number().over(w)).withColumn(out, F.lead("started_at", step).over(w))
        placed = group_ranks(df, [], in_order, rank="_place", size="_of")
        return placed.join(placed.select((F.col("_place") - step).alias("_place"), F.col("started_at").alias(out)), "_place", "left")

    closed = neighbour(runs, 1, "_next").withColumn("closed_at", F.coalesce("finished_at", "_next"))
    ok = neighbour(closed.filter("status = 'ok'").select("run_id", "started_at"), -1, "prev_high").withColumnRenamed("_place", "_seq").select("run_id", F.col("_seq").cast("int").alias("seq"), F.col("started_at").alias("high"), "prev_high")
    day = lambda c: F.to_date(c)
    opened = closed.select(F.col("started_at").alias("o_start"), F.col("closed_at").alias("o_end")).filter("o_end IS NULL OR o_end >= o_start")
    endless = opened.filter("o_end IS NULL").agg(F.min("o_start").alias("e_start"))  # one row: the last run, if it was killed
    held = opened.filter("o_end IS NOT NULL").select("o_start", "o_end", F.explode(F.sequence(day("o_start"), day("o_end"))).alias("_day"))
    asked = ok.filter("prev_high IS NOT NULL").select(F.col("run_id").alias("_r"), F.col("prev_high").alias("_h"), day("prev_high").alias("_day"))
    lows = asked.join(held, "_day").filter("o_start <= _h AND o_end >= _h").groupBy("_r").agg(F.min("o_start").alias("o_low"))
    known = ok.join(lows, F.col("run_id") == F.col("_r"), "left").join(F.broadcast(endless))
    low = F.when(F.col("prev_high").isNotNull(), F.least(F.coalesce("o_low", "prev_high"), F.when(F.col("e_start") <= F.col("prev_high"), F.col("e_start"))))
    return known.select("run_id", "seq", "high", "prev_high", low.alias("low"))


def changed_per_run(scans: DataFrame, runs: DataFrame, key: str = "path", version: str = "scan_id", content: str = "hash", arrived: str = "arrived_at") -> DataFrame:
    """`run_id, <key>, <content>`: what each `ok` run has to process.

    A row is in the window of a run if low < arrival <= high; windows overlap where runs were open, and
    the ledger (the pairs that an earlier `ok` run had within its reach) is anti-joined away. What is
    left is reduced to the latest version per run and key before anything is compared, so a key with a
    third of all rows costs one partial aggregate and at most one row per run afterwards.
    """
    windows = cut(run_windows(runs))  # one row a run
    # Bins of the runs' mean distance make the range join an equi-join and give a window few bins; what arrived before the first run counts to the first bin.
    start, end, n = windows.agg(F.min(F.unix_micros(F.col("high").cast("timestamp"))), F.max(F.unix_micros(F.col("high").cast("timestamp"))), F.count(F.lit(1))).first()
    width = max(1, ((end or 0) - (start or 0)) // max(1, n))
    bin_of = lambda c: F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(c.cast("timestamp")) - F.lit(start or 0)) / width))
    windows = windows.withColumn("bin", F.explode(F.sequence(F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(bin_of(F.col("low"))), bin_of(F.col("high")))))
    rows = scans.select(F.col(key).alias("k"), F.col(version).alias("v"), F.col(content).alias("c"), F.col(arrived).alias("a")).filter("k IS NOT NULL AND v IS NOT NULL AND c IS NOT NULL AND a IS NOT NULL")
    rows = rows.withColumn("a_bin", bin_of(F.col("a")))
    reread = rows.join(windows, (F.col("a_bin") == F.col("bin")) & (F.col("a") <= F.col("high")) & (F.col("low").isNull() | (F.col("a") >= F.col("low"))), "inner").select("k", "v", "c", "a", "run_id", "seq", "prev_high")
    # The ledger holds the pairs that were processed by an earlier run; only pairs in an overlap can meet it.
    ledger = reread.filter(F.col("prev_high").isNull() | (F.col("a") > F.col("prev_high"))).select("k", "v", F.col("seq").alias("done"))
    overlap = reread.filter(F.col("a") <= F.col("prev_high"))
    l = ledger.alias("l")
    again = overlap.alias("o").join(l, (F.col("o.k") == F.col("l.k")) & (F.col("o.v") == F.col("l.v")) & (F.col("l.done") < F.col("o.seq")), "left_anti")
    fresh = reread.filter(F.col("prev_high").isNull() | (F.col("a") > F.col("prev_high"))).unionByName(again)
    latest = fresh.groupBy("k", "seq", "run_id").agg(F.max(F.struct("a", "v", "c")).alias("m")).select("k", "seq", "run_id", F.col("m.c").alias("c"))
    before = F.lag("c").over(Window.partitionBy("k").orderBy("seq"))
    return latest.withColumn("b", before).filter("b IS NULL OR b <> c").select("run_id", F.col("k").alias(key), F.col("c").alias(content))


class IncrementLedger:
    """The ledger of one consumer, in `folder` of the shared storage.

    `pending` writes the records of a run to a folder of that attempt and gives back what was written, so exactly what
    was processed is what `commit` records, whatever became visible in between. A commit is the creation of one marker
    that names the attempt: it happens or it does not; the same attempt again changes nothing, another one of the same
    run is refused. What uncommitted attempts left is never read.

    Every `compact_every` commits the ledger is folded into a base: the state of each key (its latest record), and
    the pairs that arrived at or after that run's `low`, which is all that a later reread can meet. So a run reads
    the base and the commits since, not the whole history.
    """

    ROWS = "k string, v string, o bigint, c string, a timestamp"

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 32):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _marks(self, kind: str) -> dict[int, str]:
        """Number -> attempt of the markers `_<kind>-<number>=<attempt>`; the earliest attempt counts."""
        out: dict[int, str] = {}
        for s in self._fs.globStatus(self._path(f"_{kind}-*")) or []:
            out[int(s.getPath().getName().split("-", 1)[1])] = self._text(s.getPath())
        return out

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _mark(self, name: str, text: str) -> None:
        """Creates a marker with its text in one step: the file is written aside and renamed; it never replaces another."""
        aside, final = self._path(f"_aside-{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise FileExistsError(name)

    def committed(self) -> dict[int, str]:
        """Committed run ids and the attempts that hold their records, in order of commit."""
        placed = sorted((int(t.split(" ")[0]), run, t.split(" ")[1]) for run, t in self._marks("done").items())
        return {run: name for _, run, name in placed}

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.ROWS)
        return self.spark.read.schema(self.ROWS).parquet(*(f"{self.folder}/{n}" for n in names))

    def _since(self) -> tuple[str | None, list[str]]:
        """(the newest base, attempts committed after it)."""
        bases = self._marks("base")
        at = max(bases, default=-1)
        return bases.get(at), [a for i, a in enumerate(self.committed().values()) if i > at]

    def entries(self) -> DataFrame:
        """`k, v, o, c, a`: the processed pairs that a reread can still meet."""
        base, later = self._since()
        return self._read([*([f"{base}/pairs"] if base else []), *later])

    def state(self) -> DataFrame:
        """`k, v, o, c, a`: the latest processed record of each key."""
        base, later = self._since()
        return _latest(self._read([*([f"{base}/state"] if base else []), *later]))

    def pending(self, rows: DataFrame, low, high, key: str = "path", version: str = "scan_id", content: str = "hash", arrived: str = "arrived_at") -> DataFrame:
        """`<key>, <version>, <content>, <arrived>, changed`: new records with low <= arrival <= high that no committed run has processed.

        One row per key, its latest record; changed tells whether that is another state than the last processed one (a
        record older than that changes nothing). All of them, older versions included, are the run's to commit.
        """
        kinds = dict(rows.select(version, arrived).dtypes)
        bound = lambda t: F.lit(t.isoformat(sep=" ")).cast(kinds[arrived])
        rows = rows.filter(F.col(arrived) <= bound(high))
        ledger = self.entries()
        if low is not None:
            rows, ledger = rows.filter(F.col(arrived) >= bound(low)), ledger.filter(F.col("a") >= bound(low).cast("timestamp"))
        rows = rows.select(F.col(key).cast("string").alias("k"), F.col(version).cast("string").alias("v"), F.expr(f"try_cast(`{version}` AS bigint)").alias("o"), F.col(content).cast("string").alias("c"), F.col(arrived).cast("timestamp").alias("a"))
        fresh = rows.filter("k IS NOT NULL AND v IS NOT NULL AND c IS NOT NULL AND a IS NOT NULL").dropDuplicates(["k", "v"]).join(ledger.select("k", "v"), ["k", "v"], "left_anti")
        name = f"attempt-{uuid.uuid4().hex}"
        fresh.select("k", "v", "o", "c", "a").write.parquet(f"{self.folder}/{name}")
        s = self.state().select(F.col("k").alias("sk"), F.struct("a", "o").alias("at"), F.col("c").alias("sc"))
        newer = F.col("sk").isNull() | ((F.struct("a", "o") > F.col("at")) & (F.col("sc") != F.col("c")))
        taken = _latest(self._read([name])).join(s, F.col("k") == F.col("sk"), "left")
        return taken.select(F.col("k").alias(key), F.col("v").cast(kinds[version]).alias(version), F.col("c").alias(content), F.col("a").cast(kinds[arrived]).alias(arrived), newer.alias("changed", metadata={"attempt": name}))

    def commit(self, run: int, taken: DataFrame, low=None) -> None:
        """Makes the attempt that the result `taken` of `pending` names (in its column `changed`) processed by `run`.

        low is that of the run; without low no earlier pair is let go when the ledger is compacted.
        """
        done = self.committed()
        name = taken.schema["changed"].metadata["attempt"]
        if done.get(int(run)) == name:
            return
        if int(run) in done or name in done.values():
            raise ValueError(f"run {run} is committed already, or what it took is")
        number = len(done)
        self._mark(f"_done-{int(run)}", f"{number} {name}")
        if (number + 1) % self.compact_every == 0:
            self._compact(number, low)

    def _compact(self, number: int, low) -> None:
        base = f"base-{number}-{uuid.uuid4().hex}"
        pairs = self.entries() if low is None else self.entries().filter(F.col("a") >= F.lit(low.isoformat(sep=" ")).cast("timestamp"))
        self.state().write.parquet(f"{self.folder}/{base}/state")
        pairs.write.parquet(f"{self.folder}/{base}/pairs")
        self._mark(f"_base-{number}", base)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.max(F.struct("a", "o", "v", "c")).alias("m")).select("k", "m.v", "m.o", "m.c", "m.a")


def replay(ledger: IncrementLedger, rows: DataFrame, runs: DataFrame, key: str = "path", version: str = "scan_id", content: str = "hash", arrived: str = "arrived_at") -> DataFrame:
    """`run_id, <key>, <content>`: the changed records that the `ok` runs of a history take, one live run after another.

    Failed and killed runs take their records, too, and die before they commit.
    """
    windows = {r["run_id"]: r for r in run_windows(runs).collect()}
    history = runs.filter("run_id IS NOT NULL AND started_at IS NOT NULL").dropDuplicates(["run_id"]).orderBy("started_at", "run_id").collect()
    last, out = None, []
    for r in history:
        w = windows.get(r["run_id"])
        low = w["low"] if w else last["high"] if last else None
        got = ledger.pending(rows, low, r["started_at"], key, version, content, arrived)
        if w:
            folder = f"{ledger.folder}/result-{r['run_id']}-{uuid.uuid4().hex}"
            got.filter("changed").select(F.lit(r["run_id"]).cast("long").alias("run_id"), key, content).write.parquet(folder)
            ledger.commit(r["run_id"], got, low)
            last, out = w, [*out, folder]
    spark = rows.sparkSession
    schema = f"run_id bigint, {key} string, {content} string"
    return spark.read.schema(schema).parquet(*out) if out else spark.createDataFrame([], schema)
