"""Sources, snapshots, streams and the tool surface."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from kelpworks.api import Engine, HandleStore, NotReady, UnknownHandle
from kelpworks.config import Config
from kelpworks.operators.fulltext import FullText
from kelpworks.operators.locate import fresh_nodes
from kelpworks.sources import walker
from kelpworks.sources.snapshots import SnapshotStore
from kelpworks.streaming import changes as C
from kelpworks.streaming.orchestrator import Orchestrator

FILES = {
    "docs/billing.md": "# Billing\n\n## Pricing\n\n### Hobby\n\nfree of charge\n\n### Enterprise\n\nask us\n\n## Limits\n\nnone\n",
    "config/app.json": '{"name": "x", "database": {"host": "localhost", "port": 1}}',
    "data/users.csv": "id,name\n1,ann\n2,bob\n3,cy\n",
    "src/main.rs": "use crate::util::{greet};\n\nfn main() {\n    greet();\n    help();\n}\n\nfn help() {}\n",
    "src/util.rs": "pub fn greet() {\n    println!(\"hello budget\");\n}\n",
    "skip/me.rs": "fn ignored() {}\n",
    ".hidden/x.rs": "fn hidden() {}\n",
    "logs/a.log": "x",
    "logs/keep.log": "y",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    for p, text in FILES.items():
        os.makedirs(r / os.path.dirname(p), exist_ok=True)
        (r / p).write_text(text)
    (r / ".gitignore").write_text("skip/\n*.log\n!keep.log\n# note\n")
    (r / "big.rs").write_bytes(b"x" * (walker.MAX_BYTES + 1))
    outside = tmp_path_factory.mktemp("outside")
    (outside / "secret.rs").write_text("fn secret() {}\n")
    os.symlink(outside, r / "src" / "out")
    os.symlink(outside / "secret.rs", r / "src" / "linked.rs")
    os.symlink(r / "src", r / "src" / "loop")
    return str(r)


@pytest.fixture(scope="module")
def engine(spark, root):
    files = walker.read_tree(spark, root).cache()
    e = Engine(spark, {k: v.cache() for k, v in C.build_index(files).items()})
    e.build_vectors()
    return e


def test_walk(spark, root):
    want = ["config/app.json", "data/users.csv", "docs/billing.md", "logs/keep.log", "src/main.rs", "src/util.rs"]
    assert [p for p, _ in walker.walk(root)] == want
    got = walker.read_tree(spark, root).orderBy("path").collect()
    assert [r["path"] for r in got] == want
    by = {r["path"]: r for r in got}
    assert by["src/main.rs"]["language"] == "rust" and by["src/main.rs"]["size"] == len(FILES["src/main.rs"]) and by["logs/keep.log"]["language"] is None
    assert [r["path"] for r in walker.read_tree(spark, root, "rs").collect()] == ["src/main.rs", "src/util.rs"]
    plain = {r["path"]: r["hash"] for r in walker.scan_folder(spark, root, ["rs"]).collect()}
    assert sorted(plain) == ["skip/me.rs", "src/main.rs", "src/util.rs"] and plain["src/util.rs"] == by["src/util.rs"]["hash"]
    assert not [p for p, _ in walker.walk(root, ignore=False) if "secret" in p or "linked" in p or "loop" in p or p.startswith(".")]


def test_ignore_rules():
    rules = lambda *lines: [("", [r for r in map(walker.ignore_rule, lines) if r])]
    assert walker.is_ignored(rules("*.log"), "a/b.log", False) and not walker.is_ignored(rules("/x.log"), "a/x.log", False)
    assert walker.is_ignored(rules("build/"), "a/build", True) and not walker.is_ignored(rules("build/"), "a/build", False)
    assert walker.is_ignored(rules("a/**/z"), "a/b/c/z", False) and walker.is_ignored(rules("a/**/z"), "a/z", False)
    assert not walker.is_ignored(rules("*.log", "!keep.log"), "keep.log", False) and walker.is_ignored(rules("[ab].x"), "a.x", False)


def test_tools(engine):
    e = engine
    assert e.tier() == "ready"
    hits = e.search_text("BUDGET", include=["src/**"]).collect()
    assert [(r["path"], r["line"]) for r in hits] == [("src/util.rs", 2)]
    d = e.find_definition("greet").first()
    assert (d["file"], d["start_line"], d["end_line"]) == ("src/util.rs", 1, 3) and d["signature"] == "pub fn greet()"
    assert [r["name"] for r in e.get_callers("help").collect()] == ["main"] and [r["name"] for r in e.get_callees("main").collect()] == ["help"]
    assert [r["line"] for r in e.find_references("help").collect()] == [3]
    assert [r["file"] for r in e.get_imports("src/main.rs")["imports"].collect()] == ["src/util.rs"]
    assert [r["file"] for r in e.get_imports("src/util.rs")["imported_by"].collect()] == ["src/main.rs"]
    assert [r["path"] for r in e.get_symbol_outline("src/main.rs").collect()] == ["help", "main"]
    assert {r["language"] for r in e.get_repo_overview()["languages"].collect()} == {"rust", "markdown", "json", "csv"}
    assert {r["tab"] for r in e.get_index_status().collect()} >= {"files", "nodes", "vectors"}
    found = e.search_semantic("hello budget", 3).collect()
    assert found[0]["file"] == "src/util.rs"
    assert not e.search_semantic("hello budget", 3, languages=["python"]).collect()


def test_locate(engine):
    e = engine
    s = e.locate(path="Enterprise").first()
    assert s["file"] == "docs/billing.md" and s["content"].startswith("### Enterprise") and s["parent_label"] == "Pricing" and s["score"] == 1.0
    assert "localhost" in e.locate(path="database/host", file="config/app.json").first()["content"]
    assert "2,bob" in e.locate(path="file://data/users.csv/row_2").first()["content"]
    assert e.locate(path="nothing like it").count() == 0 and e.locate(path="*").count() == 0
    assert e.locate(query="hello budget now please").count() >= 0
    cut = e.locate(path="Billing", max_bytes=40).first()
    assert cut["truncated"] and len(cut["content"].encode()) <= 40 and cut["content"].endswith("(truncated)")
    assert e.read_file_range("src/util.rs", 0, 6).first()["text"] == "pub fn"
    assert e.read_file_range("../x", 0, 6).count() == 0


def test_ask_and_smart(engine):
    e = engine
    assert e.ask("greet")[0] == "definition" and e.ask("no_such_name")[0] == "semantic" and e.ask("file://data/users.csv/row_1")[0] == "locate" and e.ask("what says hello")[0] == "semantic"
    steps = iter([{"tool": "locate", "args": {"path": "Enterprise"}}])

    def model(messages):
        if len(messages) == 1:
            return next(steps)
        return {"final": [messages[-1]["content"][0]["node_id"], "made:1:2"]}

    assert len(e.locate_smart("q", model)) == 1
    assert e.locate_smart("q", lambda m: {"final": ["made:1:2"]}) == []
    assert e.locate_smart("q", lambda m: {"tool": "locate", "args": {"path": "Billing"}}, budget=10) == []


def test_memories(spark):
    e = Engine(spark, {})
    now = datetime.datetime(2031, 1, 1)
    e.memory_save("a", "the lock is freed late", {"k": "v"}, now)
    e.memory_save("b", "the lock", None, now + datetime.timedelta(hours=1))
    assert [r["content"] for r in e.memory_list().collect()] == ["the lock", "the lock is freed late"]
    hit = e.memory_search("freed lock", "a").collect()
    assert len(hit) == 1
    e.memory_forget(hit[0]["id"])
    e.memory_forget("unknown")
    assert [r["scope"] for r in e.memory_list().collect()] == ["b"]


def test_handles():
    clock = [0.0]
    h = HandleStore(10, 2, lambda: clock[0])
    a, b = h.issue("f", 0, 1), h.issue("f", 1, 2)
    assert h.get(a) == ("f", 0, 1)
    h.issue("f", 2, 3)
    with pytest.raises(UnknownHandle):
        h.get(a)
    clock[0] = 11
    with pytest.raises(UnknownHandle):
        h.get(b)


def test_expand(engine):
    key = engine.handles.issue("src/util.rs", 0, 6)
    assert engine.expand_span(key).first()["text"] == "pub fn"


def test_snapshots(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert s.read("t") is None
    s.write("t", spark.range(3), 1)
    s.write("t", spark.range(9), 1)  # the same version again changes nothing
    s.write("t", spark.range(5), 2)
    assert s.read("t").count() == 5 and s.read("t", 1).count() == 3
    s.drop_before("t", 1)
    assert s.versions("t") == [2]


def test_refresh(spark, engine):
    t = engine.tables
    old = t["files"].select("path", "hash", "language", "size", "modified", "content", "file_id")
    text = "use crate::util::{greet};\n\nfn main() {\n    fresh();\n}\n\nfn fresh() {}\n"
    changed = old.withColumn("content", F.when(F.col("path") == "src/main.rs", text).otherwise(F.col("content"))).filter("path <> 'data/users.csv'")
    events = spark.createDataFrame([("src/main.rs", "modified"), ("data/users.csv", "removed")], "path string, change string")
    out = C.refresh_index(t | {"files": old}, events, changed)
    assert out["files"].count() == old.count() - 1 and out["nodes"].filter("kind = 'CsvRow'").count() == 0
    names = {(r["kind"], r["from_name"], r["to_name"]) for r in out["edges"].collect()}
    assert ("Calls", "main", "fresh") in names and ("Calls", "main", "help") not in names and ("Imports", "main", "greet") in names and ("Defines", "greet", "greet") in names
    assert out["edges"].count() == out["edges"].dropDuplicates(["from_id", "to_id", "kind"]).count()


def test_refresh_is_a_rebuild(spark):
    """m imports n, n imports c: a refresh after any change of one of them gives the tables of a whole rebuild."""
    text = {
        "src/m.rs": "use crate::n::{two};\n\nfn one() {\n    two();\n}\n",
        "src/n.rs": "use crate::c::{three};\nuse crate::later::{four};\n\npub fn two() {\n    three();\n}\n",
        "src/c.rs": "pub fn three() {}\n",
    }
    steps = [
        ({"src/c.rs": "fn other() {}\n\npub fn three() {\n    other();\n}\n", "src/later.rs": "pub fn four() {}\n"}, [("src/c.rs", "modified"), ("src/later.rs", "created")]),
        ({"src/c.rs": None, "src/n.rs": "pub fn two() {}\n"}, [("src/c.rs", "removed"), ("src/n.rs", "modified")]),
    ]

    def files(texts):
        rows = [(p, str(hash(t)), "rust", len(t), t, i) for i, (p, t) in enumerate(sorted(texts.items()))]
        return spark.createDataFrame(rows, "path string, hash string, language string, size long, content string, file_id long")

    rows_of = lambda df: sorted(tuple(str(r[c]) for c in sorted(df.columns) if c != "file_id") for r in df.collect())
    before = {k: d.cache() for k, d in C.build_index(files(text)).items()}
    assert {("Imports", "one", "two"), ("ImportedBy", "two", "one"), ("Imports", "two", "three")} <= {(r["kind"], r["from_name"], r["to_name"]) for r in before["edges"].collect()}
    for new, events in steps:
        now = files({p: t for p, t in (text | new).items() if t is not None})
        got = C.refresh_index(before, spark.createDataFrame(events, "path string, change string"), now)
        want = C.build_index(now)
        for table in ("edges", "symbols"):
            assert rows_of(got[table]) == rows_of(want[table])


def test_stale_nodes(spark, engine):
    t = engine.tables
    indexed = t["files"].select("file_id", F.when(F.col("path") == "config/app.json", "old").otherwise(F.col("hash")).alias("hash"))
    fresh = t["files"].withColumn("content", F.when(F.col("path") == "config/app.json", '{"other": 1}').otherwise(F.col("content")))
    labels = {r["label"] for r in fresh_nodes(t["nodes"], fresh, indexed).collect()}
    assert "other" in labels and "database" not in labels and "Enterprise" in labels


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2031, 1, 1)
    ms = lambda n: t0 + datetime.timedelta(milliseconds=n)
    rows = [(1, "a", "modified", ms(0)), (2, "a", "removed", ms(300)), (3, "b", "created", ms(100)), (4, "a", "created", ms(2000))]
    schema = "event_id long, path string, change string, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    assert sorted((r["path"], r["events"]) for r in C.debounced(df).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert {(r["path"], r["change"]) for r in C.latest_per_path(df).collect()} == {("a", "created"), ("b", "created")}
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    seen = []
    q = C.reindex_stream(C.change_stream(spark, src, schema), lambda d, i: seen.append((i, sorted((r["path"], r["change"]) for r in d.collect()))), str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    spark.createDataFrame([(9, "c", "created", ms(60_000))], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [x[1] for x in seen] == [[("a", "created"), ("b", "created")], [("c", "created")]]
    w = C.debounced_stream(C.change_stream(spark, src, schema)).writeStream.format("memory").queryName("deb").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("deb").count() == 3


def test_polling(spark, tmp_path):
    store, got = SnapshotStore(spark, f"file://{tmp_path}/p"), []
    state = spark.createDataFrame([("a", datetime.datetime(2031, 1, 1), 1)], "path string, modified timestamp, size long")
    q = C.poll_stream(spark, lambda: state, store, lambda d: got.append([tuple(r) for r in d.collect()]), str(tmp_path / "cp"), "0 seconds")
    end = time.time() + 30
    while time.time() < end and len(got) < 2:
        time.sleep(0.2)
    q.stop()
    assert got[0] == [("a", "created")] and got[1] == []


def test_polling_reports_every_change(spark, tmp_path):
    """The listing changes at each look; what is reported leads from nothing to the last stored state, also after a failure."""
    store, looks, got, fail = SnapshotStore(spark, f"file://{tmp_path}/p"), [0], [], [True]

    def listing():
        looks[0] += 1
        return spark.createDataFrame([(f"f{i}", datetime.datetime(2031, 1, 1), 1) for i in range(looks[0])], "path string, modified timestamp, size long")

    def report(changes):
        rows = [tuple(r) for r in changes.collect()]
        if fail[0] and len(got) == 1:
            fail[0] = False
            raise RuntimeError("the receiver is down")
        got.append(rows)

    for i in range(3):
        try:
            C.poll_once(listing, store, report, i)
        except RuntimeError:
            C.poll_once(listing, store, report, i)
    assert sorted(p for rows in got for p, c in rows if c == "created") == sorted(r["path"] for r in store.read("polled").collect())


def test_rate(spark):
    t0 = datetime.datetime(2031, 1, 1)
    rows = [("x", t0 + datetime.timedelta(seconds=s)) for s in [0, 1, 59, 60, 61, 200]]
    got = [r["recent"] for r in C.rate_of(spark.createDataFrame(rows, "k string, ts timestamp"), "k", limit=2).orderBy("ts").collect()]
    assert got == [1, 2, 3, 3, 3, 1]


def test_stored_engine(spark, root, tmp_path):
    """Build, open and refresh over the store give what an engine over plain tables gives; nothing is parsed at a tool call."""
    folder = f"file://{tmp_path}/index"
    with pytest.raises(NotReady):
        Engine.open(spark, folder)
    files = walker.read_tree(spark, root)
    built = Engine.build(spark, folder, files, Config())
    built.build_vectors()
    e = Engine.open(spark, folder)
    assert e.version == 1 and e.tier() == "ready" and "Python" not in e.tables["symbols"]._jdf.queryExecution().toString()
    assert e.search_semantic("hello budget", 3, exclude=["docs/**"]).first()["file"] == "src/util.rs"
    assert "PushedFilters: [In(term" in e.indexes["chunks"].postings.filter("term in ('hello', 'budget')")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("PushedFilters: [IsNotNull(term), ", "PushedFilters: [")
    assert e.semantic_coverage().first()["ratio"] == 1.0
    assert e.locate(query="pricing hobby section now", max_results=3).count() > 0
    assert [r["name"] for r in e.get_callers("help").collect()] == ["main"]
    e.memory_save("a", "kept over restarts", None, datetime.datetime(2031, 1, 1))
    text = "pub fn greet() {\n    fresh();\n}\n\nfn fresh() {}\n"
    now = e.tables["files"].withColumn("content", F.when(F.col("path") == "src/util.rs", text).otherwise(F.col("content")))
    e.refresh(spark.createDataFrame([("src/util.rs", "modified")], "path string, change string"), now)
    again = Engine.open(spark, folder)
    assert again.version == 2 and [r["name"] for r in again.get_callers("fresh").collect()] == ["greet"]
    assert [r["content"] for r in again.memory_list().collect()] == ["kept over restarts"]


def test_truncated_spans_have_handles(engine):
    rows = engine.deliver(engine.locate(path="Billing", max_bytes=40))
    assert rows[0]["truncated"] and rows[0]["handle"]
    assert engine.expand_span(rows[0]["handle"]).first()["text"] == FILES["docs/billing.md"]
    assert engine.deliver(engine.locate(path="Enterprise"))[0]["handle"] is None


def test_locate_reads_changed_files_anew(engine):
    e = Engine(engine.spark, engine.tables, engine.vectors)
    e.current = e.tables["files"].withColumn("content", F.when(F.col("path") == "config/app.json", '{"cache": {"size": 7}}').otherwise(F.col("content"))).withColumn("hash", F.sha2("content", 256))
    assert e.locate(path="cache/size").first()["file"] == "config/app.json" and e.locate(path="database/host").count() == 0


def test_orchestrator_switches_to_polling(spark):
    class Fake:
        def __init__(self):
            self.calls = []
            self.tables = {"files": spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")}

        def refresh(self, changes, current):
            self.calls.append(sorted(map(tuple, changes.collect())))
            self.tables["files"] = current

    clock, state, fake = [0.0], [[("a", "1"), ("b", "1")]], Fake()
    o = Orchestrator(fake, lambda: spark.createDataFrame(state[0], "path string, hash string"), limit=3, seconds=10, clock=lambda: clock[0])
    events = lambda *rows: spark.createDataFrame([(p, c, datetime.datetime(2031, 1, 1, 0, 0, i), i) for i, (p, c) in enumerate(rows)], "path string, change string, ts timestamp, event_id long")
    o.on_events(events(("a", "modified"), ("a", "removed")), 1)
    o.on_events(events(("a", "modified")), 1)  # the same batch again
    assert fake.calls == [[("a", "removed")]] and o.mode == "native"
    state[0] = [("b", "2"), ("c", "1")]
    o.on_events(events(*[("x", "modified")] * 5), 2)
    assert o.mode == "polling" and len(fake.calls) == 1
    fake.tables["files"] = spark.createDataFrame([("b", "1")], "path string, hash string")
    o.tick()
    assert fake.calls[1] == [("b", "modified"), ("c", "created")] and o.mode == "polling"
    clock[0] = 20
    o.tick()
    assert len(fake.calls) == 2 and o.mode == "native"


def test_match_language(spark, tmp_path):
    """Phrases, prefixes, NOT, OR, accents, repeated keys and texts without words."""
    rows = [(1, "the memory log is full"), (2, "log of the memory"), (3, "Mémoire: memory-log snapshots"), (4, None), (5, ""), (1, "zzz"), (None, "memory log")]
    ix = FullText.build(spark.createDataFrame([(*r, 0) for r in rows], "k long, t string, term int"), "k", "t", f"file://{tmp_path}/ft")
    find = lambda q, mode="and": sorted(r["k"] for r in FullText(spark, ix.folder, "k").search(q, mode).collect())
    assert find('"memory log"') == [1, 3] and find("memory log") == [1, 2, 3] and find("snap*") == [3] and find("memoire") == [3]
    assert find("memory NOT snapshots") == [1, 2] and find("full OR snapshots") == [1, 3] and find("full of", "or") == [1, 2] and find('"memory lo"*') == [1, 3]
    assert find("NOT memory") == [] and find("") == [] and find("zzz") == [] and find('"log memory"') == [] and ix.stats.first()["n"] == 5


def test_command_line(spark, root, tmp_path):
    from kelpworks.__main__ import parser, run

    call = lambda *a: run(parser().parse_args(["--index", f"file://{tmp_path}/cli", *a]), spark)
    assert {r["tab"] for r in call("index", root)} >= {"files", "edges"}
    assert call("definition", "greet")[0]["file"] == "src/util.rs" and [r["name"] for r in call("callers", "help")] == ["main"]
    assert call("search", "budget")[0]["line"] == 2 and call("pack", "--budget", "5000")[0].startswith("<?xml")
    assert call("imports", "src/util.rs")[0]["side"] == "imported_by"


def test_git_facts(tmp_path):
    import subprocess

    from kelpworks.sources.git import git_facts

    assert git_facts(str(tmp_path)) is None
    for args in (["init", "-q", "-b", "trunk"], ["-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    facts = git_facts(str(tmp_path))
    assert facts["branch"] == "trunk" and len(facts["head"]) >= 7 and facts["dirty"] is False
    (tmp_path / "new").write_text("x")
    assert git_facts(str(tmp_path))["dirty"] is True


def test_hot_path_bursts(spark):
    """One path with nearly all events, null times and a pause of exactly the gap."""
    t0 = datetime.datetime(2031, 1, 1)
    rows = [("hot", t0 + datetime.timedelta(milliseconds=300 * i)) for i in range(200)] + [("hot", t0 + datetime.timedelta(milliseconds=300 * 199 + 500)), ("hot", None), ("b", t0)]
    got = sorted((r["path"], r["start"], r["end"], r["events"]) for r in C.debounced(spark.createDataFrame(rows, "path string, ts timestamp")).collect())
    last = t0 + datetime.timedelta(milliseconds=300 * 199)
    half = datetime.timedelta(milliseconds=500)
    assert got == [("b", t0, t0 + half, 1), ("hot", t0, last + half, 200), ("hot", last + half, last + 2 * half, 1)]
