"""Core operators on small fixtures: defined cases, brute force and independent oracles."""

import datetime
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpworks.functions import paths as P
from kelpworks.functions.ranks import group_ranks, running_max
from kelpworks.functions.skew import salted_join
from kelpworks.operators import graph as G
from kelpworks.operators import imports as I
from kelpworks.operators import pack as K
from kelpworks.operators import retrieval as R
from kelpworks.operators import routing
from kelpworks.operators import text as T
from kelpworks.operators import upserts as U
from kelpworks.operators.increments import IncrementLedger, changed_per_run, run_windows
from kelpworks.operators.orphans import orphan_counts, orphan_references
from kelpworks.sources import code, structural

T0 = datetime.datetime(2031, 3, 1)
at = lambda h: T0 + datetime.timedelta(hours=h)


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- increments ---------------------------------------------------------------------------------


def brute_changes(scans, runs):
    ok = sorted({(s, r) for r, s, f, st_ in runs if st_ == "ok"})
    out, before = [], {}
    for start, run in ok:
        state = {}
        for scan, path, h, a in sorted(set(scans), key=lambda x: (x[3] or T0, x[0] or 0)):
            if None not in (scan, path, h, a) and a <= start:
                state[path] = h
        out += [(run, p) for p, h in state.items() if before.get(p) != h]
        before = state
    return sorted(out)


def make_scans(seed):
    rng = random.Random(seed)
    runs = [(i, at(10 * i), None if i % 5 == 3 else at(10 * i + rng.choice([1, 15, 30])), rng.choice(["ok", "ok", "failed", "killed"])) for i in range(12)]
    scans = [(i, rng.choice(["hot", "a", "b", "c", None]), rng.choice(["x", "y", None]), at(rng.randint(-50, 130))) for i in range(120)]
    return scans + scans[:10], runs + runs[:2]


@pytest.mark.parametrize("seed", range(4))
def test_changes_of_each_run(spark, seed):
    scans, runs = make_scans(seed)
    s = values(spark, [(*r, "x", 1) for r in scans], "scan_id long, path string, hash string, arrived_at timestamp_ntz, k string, seq int")
    r = values(spark, [(*x, 1) for x in runs], "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string, low int")
    got = sorted((x["run_id"], x["path"]) for x in changed_per_run(s, r).collect())
    assert got == brute_changes(scans, runs)
    assert changed_per_run(s.limit(0), r).count() == 0 and changed_per_run(s, r.limit(0)).count() == 0


def test_run_windows_of_any_length(spark):
    """The distributed order of a long history gives the windows of the order in one task."""
    runs = [(i, at(7 * i % 50), None if i % 4 == 1 else at(7 * i % 50 + i % 30), "ok" if i % 3 else "killed") for i in range(40)]
    r = values(spark, runs, "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    a, b = (sorted(map(tuple, run_windows(r, n).collect())) for n in (100_000, 0))
    ok = sorted((s, i) for i, s, _, st_ in runs if st_ == "ok")
    assert a == b and [x[0] for x in sorted(a, key=lambda x: x[1])] == [i for _, i in ok]


def test_ledger_survives_failed_runs(spark, tmp_path):
    ledger = IncrementLedger(spark, f"file://{tmp_path}/ledger")
    schema = "scan_id long, path string, hash string, arrived_at timestamp_ntz"
    rows = [(1, "a", "x", at(1)), (2, "b", "y", at(2)), (2, "b", "y", at(2)), (3, None, "y", at(2)), (4, "c", None, at(2))]
    first = ledger.pending(values(spark, rows, schema), None, at(5))
    assert sorted(x["path"] for x in first.filter("changed").collect()) == ["a", "b"]
    # The run dies here: nothing was committed, so the next run gets the same records.
    again = ledger.pending(values(spark, rows, schema), None, at(6))
    assert again.count() == 2
    ledger.commit(7, again)
    ledger.commit(7, again)
    rows += [(5, "a", "z", at(7)), (6, "b", "y", at(8))]
    late = ledger.pending(values(spark, rows, schema), at(0), at(9)).collect()
    assert {(x["path"], x["changed"]) for x in late} == {("a", True), ("b", False)}
    assert ledger.entries().count() == 2


def test_tied_ranks(spark):
    """One value with a third of the rows, nulls, both zeros and clashing names: the ranks of group_ranks with ties."""
    from kelpworks.functions.ranks import group_ranks, tied_ranks

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -0.0, 1.5, 1.5, 1.5, rng.random()]), i) for i in range(300)]
    df = values(spark, rows, "g string, v double, rows int")
    want = group_ranks(df.withColumn("v", F.col("v") + 0.0), ["g"], [F.col("v").asc_nulls_first()], ties=True)
    take = lambda d: sorted((r["rows"], r["rank"], r["group_size"]) for r in d.collect())
    assert take(tied_ranks(df, ["g"], "v")) == take(want) and tied_ranks(df.limit(0), ["g"], "v").count() == 0


# --- orphans ------------------------------------------------------------------------------------


def test_orphans_against_brute_force(spark):
    rng = random.Random(2)
    ids = [f"s{i}" for i in range(30)] + ["S1", "", None, "ext", "none"]
    lives = [(rng.choice(ids[:25]), at(a), rng.choice([None, at(a + rng.randint(0, 20))])) for a in [rng.randint(0, 50) for _ in range(60)]]
    lives += [(None, at(0), None), ("late", None, None)]
    edges = [(i, rng.choice(ids), "ext" if rng.random() < 0.4 else rng.choice(ids), rng.choice([None, at(rng.randint(-5, 70)), at(rng.randint(0, 60))])) for i in range(400)]
    edges += edges[:40] + [(900, "late", "s0", at(1)), (None, "none", "none", at(1))]
    known = {}
    for i, a, b in lives:
        known.setdefault(i, []).append((a, b))
    want = set()
    for e, f, t, seen in edges:
        for side, i in (("from", f), ("to", t)):
            if e is None or not i or i == "ext":
                continue
            if i not in known:
                want.add((e, side, "missing"))
            elif seen is not None and not any(a is not None and a <= seen and (b is None or b > seen) for a, b in known[i]):
                want.add((e, side, "deleted" if any(b is not None and b <= seen for _, b in known[i]) else "late"))
    e = values(spark, [(*x, "x", 1) for x in edges], "edge_id long, from_id string, to_id string, observed_at timestamp_ntz, reason string, h int")
    s = values(spark, [(*x, 1) for x in lives], "symbol_id string, seen_at timestamp_ntz, deleted_at timestamp_ntz, lives int")
    x = values(spark, [("ext", 1), ("ext", 1)], "symbol_id string, p_id int")
    for words, most in ((None, 64), (1, 64), (None, 1), (1, 0)):  # one word: nearly everything is filter-positive
        got = orphan_references(e, s, x, words=words, most_lives=most)
        assert {(r["edge_id"], r["side"], r["reason"]) for r in got.collect()} == want
        assert got.count() == len(want)
    assert orphan_counts(orphan_references(e, s, x)).agg(F.sum("n")).first()[0] == len(want)
    assert orphan_references(e.limit(0), s, x).count() == 0
    empty = orphan_references(e, s.limit(0), x.limit(0))
    assert {r["reason"] for r in empty.collect()} == {"missing"}


# --- skew helpers -------------------------------------------------------------------------------


def test_group_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(500)]
    df = values(spark, rows, "g string, v double, i long")
    for ties in (False, True):
        got = group_ranks(df, ["g"], [F.col("v").asc_nulls_first()] + ([] if ties else [F.col("i").asc()]), ties=ties).collect()
        assert len(got) == 500
        for r in got:
            peers = [x for x in rows if x[0] == r["g"]]
            key = lambda x: (x[1] is not None, x[1] or 0.0, 0 if ties else x[2])
            me = (r["g"], r["v"], r["i"])
            assert r["rank"] == sum(key(p) <= key(me) for p in peers) and r["group_size"] == len(peers)


def test_running_max(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "b"]), i, rng.choice([None, rng.randint(0, 100)])) for i in range(300)]
    got = {(r["g"], r["i"]): r["running"] for r in running_max(values(spark, rows, "g string, i long, v long"), ["g"], [F.col("i").asc()], "v").collect()}
    for g, i, _ in rows:
        seen = [v for h, j, v in rows if h == g and j <= i and v is not None]
        assert got[g, i] == (max(seen) if seen else None)


def test_salted_join(spark):
    many = values(spark, [("hot" if i % 3 else f"k{i % 40}", i) for i in range(900)], "k string, i long")
    one = values(spark, [("hot", 1), *((f"k{i}", i) for i in range(0, 40, 2))], "o string, w long")
    want = many.join(one, many.k == one.o, "left").select("k", "i", "w")
    got = salted_join(many, one, "k", "o", spread_by="i", hot_share=20).select("k", "i", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# --- paths and text -----------------------------------------------------------------------------


def test_globs():
    import re

    ok = lambda g, p: re.match(P.text_glob(g), p) is not None
    assert ok("src/*.rs", "src/a.rs") and not ok("src/*.rs", "src/b/a.rs") and ok("src/**.rs", "src/b/a.rs") and ok("!a?c", "abc") and not ok("a.c", "abc")
    sq = lambda g, p: re.match(P.sqlite_glob(g), p) is not None
    con = sqlite3.connect(":memory:")
    for g, p in [("*.rs", "a/b.rs"), ("a?c", "abc"), ("[ab]x", "bx"), ("[^ab]x", "cx"), ("a[b", "a[b"), ("*/t*", "x/y/tz"), ("A*", "abc")]:
        assert sq(g, p) == bool(con.execute("SELECT ? GLOB ?", (p, g)).fetchone()[0]), (g, p)


def test_path_columns(spark):
    rows = ["src/a/b.test.rs", "README.md", "tests/x.py", "a/../b//./c.py", "/abs/x", ".hidden", "a\\b\\c_test.ts", "x.py.bak", "deep/spec/y.js"]
    df = values(spark, [(r,) for r in rows], "p string")
    got = {r["p"]: r for r in df.select("p", P.basename(F.col("p")).alias("b"), P.dirname(F.col("p")).alias("d"), P.extension(F.col("p")).alias("e"), P.normalize_path(F.col("p")).alias("n"), P.is_test_file(P.slashed(F.col("p"))).alias("t"), P.safe_path(F.col("p")).alias("s"), P.language_of(F.col("p")).alias("l")).collect()}
    assert (got["src/a/b.test.rs"]["b"], got["src/a/b.test.rs"]["d"], got["src/a/b.test.rs"]["e"], got["src/a/b.test.rs"]["l"]) == ("b.test.rs", "src/a", "rs", "rust")
    assert got["a/../b//./c.py"]["n"] == "b/c.py" and got["/abs/x"]["n"] == "/abs/x" and got["README.md"]["d"] == ""
    assert [r for r in rows if got[r]["t"]] == ["tests/x.py", "a\\b\\c_test.ts", "deep/spec/y.js"]
    assert not got["a/../b//./c.py"]["s"] and not got["/abs/x"]["s"] and got["README.md"]["s"] and got[".hidden"]["e"] == ""


def test_search_lines(spark):
    df = values(spark, [("a", "One fish\nTWO (fish) fish\nred\n"), ("b", None), ("c", ""), ("d", "é fish\r\nlast fish")], "path string, content string")
    got = [tuple(r) for r in T.search_lines(df, ["path"], "fish").orderBy("path", "line").collect()]
    assert got == [("a", 1, "One fish", None, "TWO (fish) fish", 1), ("a", 2, "TWO (fish) fish", "One fish", "red", 2), ("d", 1, "é fish", None, "last fish", 1), ("d", 2, "last fish", "é fish", None, 1)]
    assert T.search_lines(df, ["path"], "(fish)").count() == 1 and T.search_lines(df, ["path"], "two", case_sensitive=True).count() == 0
    cols = [tuple(r) for r in T.match_columns(df, ["path"], "FISH").orderBy("path", "line", "column").collect()]
    assert cols == [("a", 1, 5, "fish"), ("a", 2, 6, "fish"), ("a", 2, 12, "fish"), ("d", 1, 4, "fish"), ("d", 2, 6, "fish")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=3), max_size=120), st.booleans())
def test_truncate_like_python(spark, lines, end):
    text = "\n".join(lines) + ("\n" if end and lines else "")
    parts = text.splitlines(keepends=True)
    want = text if len(parts) <= 80 else "".join(parts[:40]) + f"[...{len(parts) - 60} lines elided...]\n" + "".join(parts[-20:])
    row = values(spark, [(text,)], "t string").select(T.truncate_lines(F.col("t")).alias("x"), T.count_lines(F.col("t")).alias("n"), T.line_range(F.col("t"), 2, 4).alias("r")).first()
    assert row["x"] == want and row["n"] == len(parts) and row["r"] == "".join(parts[1:4])


def test_bytes(spark):
    df = values(spark, [("aé\nb",)], "t string")
    r = df.select(T.bytes_of(F.col("t"), F.lit(1), F.lit(3)).alias("x"), T.line_of_byte(F.col("t"), F.lit(3)).alias("l3"), T.line_of_byte(F.col("t"), F.lit(4)).alias("l4"), T.line_of_byte(F.col("t"), F.lit(99)).alias("l99")).first()
    assert tuple(r) == ("é", 1, 2, 2)
    far = df.select(T.bytes_of(F.col("t"), F.lit(1 << 40), F.lit(1 << 41)).alias("a"), T.bytes_of(F.col("t"), F.lit(3), F.lit(1 << 41)).alias("b"), T.bytes_of(F.col("t"), F.lit(0), F.lit(2)).alias("c")).first()
    assert tuple(far) == ("", "\nb", "a\ufffd")
    assert [tuple(x) for x in T.line_starts(df.withColumn("k", F.lit(1)), ["k"], "t").collect()] == [(1, 1, 0), (1, 2, 4)]


# --- upserts ------------------------------------------------------------------------------------


def test_upserts(spark):
    old = values(spark, [("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], "k string, v int, w string")
    new = values(spark, [("a", 2, "q"), ("c", 1, "r")], "k string, v int, w string")
    assert sorted(map(tuple, U.upsert_latest(old, new, ["k"], ["v"]).collect())) == [("a", 2, "q"), ("b", 1, "y"), ("c", 1, "r")]
    e = values(spark, [("1", "2", "C", "f", "g"), ("3", "4", "C", "g", "h"), ("5", "6", "C", "h", "f")], "from_id string, to_id string, kind string, from_file string, to_file string")
    n = values(spark, [("1", "9", "C", "f", "g"), ("1", "9", "C", "f", "g")], e.schema)
    assert sorted(r["to_id"] for r in U.upsert_edges(e, n).collect()) == ["4", "6", "9"]
    assert sorted(r["to_id"] for r in U.replace_edges_of_file(e, n, "f").collect()) == ["4", "9"]
    assert U.delete_keys(old, values(spark, [("zz",)], "k string"), "k").count() == 3


# --- retrieval ----------------------------------------------------------------------------------


@pytest.mark.parametrize("query", ["lock", "lock file", "open the file"])
def test_bm25_like_fts5(spark, query):
    rng = random.Random(7)
    words = "the a lock file open close tree node token budget".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", docs)
    want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (query,))}
    got = {r["id"]: r["score"] for r in R.bm25(values(spark, docs, "id long, body string"), "id", "body", query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_retrieval_cases(spark):
    docs = values(spark, [(1, "alpha beta", "x/a.md"), (2, "beta", "y/b.md"), (3, None, "y/c.md"), (4, "alpha " + "pad " * 5000, "x/d.md")], "chunk_id long, text string, file string")
    vecs = values(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.5, 0.5])], "chunk_id long, embedding array<float>")
    assert R.bm25(docs, "chunk_id", "text", "?!").count() == 0
    top = R.hybrid(docs, vecs, "chunk_id", "alpha", [1.0, 0.0], 10).collect()
    assert top[0]["chunk_id"] == 1 and top[0]["source"] == "hybrid" and top[-1]["chunk_id"] == 4
    only = R.hybrid(docs, vecs, "chunk_id", "alpha", [1.0, 0.0], 10, keep=F.col("file").startswith("y/")).collect()
    assert {r["chunk_id"] for r in only} == {2}
    lists = [R.ranked(values(spark, [("a", 2.0), ("b", 1.0)], "k string, score double"), "k", "bm25"), R.ranked(values(spark, [("b", 9.0)], "k string, score double"), "k", "vector")]
    one, two = R.rrf(lists, "k").orderBy("k").collect(), R.rrf(lists[::-1], "k").orderBy("k").collect()
    assert one == two and one[1]["source"] == "hybrid" and abs(one[1]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    m = R.hash_embedding(["a b", "", None], 8)
    assert m.shape == (3, 8) and not m[1:].any()


# --- graph and imports --------------------------------------------------------------------------


def test_graph_of_a_small_app(spark):
    src = "import { add } from './math';\n\nexport function run(x: number): number {\n  return add(x, helper(x));\n}\n\nfunction helper(y: number): number {\n  return y;\n}\n"
    math = "export function add(a: number, b: number): number {\n  return a + b;\n}\n"
    files = values(spark, [(1, "src/index.ts", "typescript", src), (2, "src/math.ts", "typescript", math)], "file_id long, path string, language string, content string")
    from kelpworks.streaming.changes import build_index

    e = build_index(files)["edges"]
    kinds = {(r["kind"], r["from_name"], r["to_name"]) for r in e.collect()}
    assert ("Calls", "run", "helper") in kinds and ("References", "run", "helper") in kinds and ("Defines", "add", "add") in kinds
    assert {("Imports", "run", "add"), ("Imports", "helper", "add"), ("ImportedBy", "add", "run")} <= kinds
    assert not any(k == "Calls" and a == b for k, a, b in kinds)
    assert [r["file"] for r in G.imports_of(e, "src/index.ts").collect()] == ["src/math.ts"]
    assert [r["file"] for r in G.imported_by(e, "src/math.ts").collect()] == ["src/index.ts"]
    assert [(r["name"], len(r["sites"])) for r in G.callers(e, G.Selector(name="helper")).collect()] == [("run", 1)]
    assert [r["name"] for r in G.callees(e, G.Selector(name="run", file="src/index.ts")).collect()] == ["helper"]


def test_intervals_against_brute_force(spark):
    rng = random.Random(4)
    iv = lambda n: [("f", i, s, s + rng.randint(0, 9000)) for i, s in ((i, rng.randint(0, 20000)) for i in range(n))]
    a, b = iv(40), iv(40)
    da, db = values(spark, a, "file string, a_id long, a_start long, a_end long"), values(spark, b, "file string, b_id long, b_start long, b_end long")
    want = {(x[1], y[1]) for x in a for y in b if x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3]}
    got = [(r["a_id"], r["b_id"]) for r in G.overlapping(da, db, "file").collect()]
    assert set(got) == want and len(got) == len(want)
    nodes = values(spark, [(1, i, s, e) for _, i, s, e in a], "file_id long, id long, byte_start long, byte_end long")
    points = values(spark, [(i, 1, rng.randint(0, 30000)) for i in range(50)], "point_id long, file_id long, at long")
    found = {r["point_id"]: r["node_id"] for r in G.enclosing_smallest(points, nodes).collect()}
    for p, _, x in [tuple(r) for r in points.collect()]:
        inside = [(e - s, i) for _, i, s, e in a if s <= x <= e]
        assert found.get(p) == (min(inside)[1] if inside else None)


def test_imports(spark):
    rust = ["use crate::a::b::{c, d as e, f::g};", "pub use self::x;", "use std::io;", "pub(crate) use a::{b};"]
    got = [tuple(r) for r in values(spark, [(r,) for r in rust], "r string").select("r", I.rust_use(F.col("r")).alias("p")).select("p.*").collect()]
    assert got == [(["a", "b"], ["c", "d", "f"]), (["x"], []), (["std", "io"], []), (["a"], ["b"])]
    ts = ["import { a as b, type C } from './x/y';", "import D from \"../z\"", "export { e } from './f'", "import './side'", "import type { T } from 'lib'"]
    got = [tuple(r) for r in values(spark, [(r,) for r in ts], "r string").select(I.ts_import(F.col("r")).alias("p")).select("p.*").collect()]
    assert got == [([".", "x", "y"], ["a", "C"]), (["..", "z"], ["D"]), ([".", "f"], ["e"]), (["./side"], []), (["lib"], ["T"])]
    py = ["from .m import x as y, z", "import a as b, c", "from .. import q", "from a.b import (d)"]
    df = values(spark, [(r,) for r in py], "r string")
    got = [tuple(r) for r in df.select(I.py_import(F.col("r")).alias("p")).select("p.*").collect()]
    assert got == [(["m"], ["x", "z"]), (["a", "c"], ["b"]), ([], ["q"]), (["a", "b"], ["d"])]
    assert [r[0] for r in df.select(I.resolve_py(F.lit("pkg/sub/f.py"), F.col("r"))).collect()] == ["pkg/sub/m.py", None, "pkg/__init__.py", None]
    assert values(spark, [(1,)], "x int").select(I.resolve_ts(F.lit("src/a.ts"), F.array(F.lit(".."), F.lit("b"))), I.resolve_rust(F.array(F.lit("a"), F.lit("b")))).first()[:] == ("b.ts", "src/a/b.rs")


# --- parsing ------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=400), st.integers(4, 60))
def test_char_split(text, most):
    data = text.encode()
    parts = code.char_split(data, most)
    assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] if parts else data == b""
    assert not parts or parts[-1][1] == len(data)
    for a, b in parts:
        assert 0 < b - a <= most
        data[a:b].decode()


def test_symbols():
    py = "@dec\nclass A:\n    def f(self):\n        def g(): pass\n\nasync def h(): pass\n"
    assert [(r[1], r[2], r[7] and r[7].split("::")[1]) for r in code.symbol_rows("m.py", "python", py)] == [("A", "class", None), ("f", "method", "A"), ("g", "method", "f"), ("h", "function", None)]
    rs = 'pub struct S { a: u8 }\nimpl<T> Tr for S { fn f(&self) { "}" ; } }\nmacro_rules! m { () => {} }\nconst X: u8 = 1;\nmod tests { fn t() {} }\n'
    assert [(r[1], r[2]) for r in code.symbol_rows("a.rs", "rust", rs)] == [("S", "struct"), ("S", "impl"), ("f", "function"), ("m", "macro"), ("X", "constant"), ("tests", "module"), ("t", "function")]
    ts = "export class A<T> {\n  f(x: string): void { if (x) { g() } }\n}\ninterface I { x: number }\nexport const k = (a) => a;\nenum E { A }\ntype Q = string;\nfunction* gen() {}\n"
    assert [(r[1], r[2]) for r in code.symbol_rows("a.ts", "typescript", ts)] == [("A", "class"), ("f", "method"), ("I", "interface"), ("k", "variable"), ("E", "enum"), ("Q", "type"), ("gen", "function")]
    chunks = code.chunk_rows("a.rs", "rust", rs, 60)
    assert all(rs.encode()[c[2] : c[3]].decode() == c[4] and c[3] - c[2] <= 60 for c in chunks)
    assert code.chunk_id(" a  b\n") == code.chunk_id("a b") and code.chunk_rows("x", "go", "", 10) == []


def test_structural_parsers():
    j = structural.parse_json('{"b": {"y": 1, "x": [1, {"q": null}]}, "a": "é"}')
    assert ["/".join(n[2]) for n in j] == ["a", "b", "b/x", "b/x/[0]", "b/x/[1]", "b/x/[1]/q", "b/y"]
    assert structural.parse_json("{") == [] and structural.parse_toml("a = ") == []
    text = "a: 1\nb:\n  c: x\n  d:\n    - e: 1\nf: |\n  g: no\n"
    assert ["/".join(n[2]) for n in structural.parse_yaml(text)] == ["a", "b", "b/c", "b/d", "f"]
    md = "# One\n\ntext\n\n## Two\n\n```rs\n# no\n```\n\nThree\n-----\nx\n\n# Four\n"
    n = structural.parse_markdown(md)
    assert [(x[0], x[1], x[6]) for x in n] == [("MdSection", "One", 1), ("MdSection", "Two", 2), ("MdCodeBlock", "rs", 7), ("MdSection", "Three", 2), ("MdSection", "Four", 1)]
    assert md[n[0][3] : n[0][4]].endswith("x\n\n") and n[2][5] == 1
    c = structural.parse_csv('a,b\n1,"x\ny"\n2,z\n')
    assert [x[2][0] for x in c] == ["header", "row_1", "row_2"] and c[2][1] == "2, z"


# --- routing and packing ------------------------------------------------------------------------


def test_routing():
    assert [routing.choose_strategy(q) for q in ("main", "src/*.rs", "how are errors handled")] == ["definition", "locate", "semantic"]
    assert routing.choose_strategy("main", "semantic") == "semantic" and routing.choose_strategy("a b", "structural") == "locate"
    assert routing.parse_locator("file://src/lib.rs/doc/Design") == routing.Locator("file", ("doc", "Design"), "src/lib.rs")
    assert routing.parse_locator("#Summary").path == ("Summary",) and routing.parse_locator("/").path == () and routing.parse_locator("any").kind == "any"
    assert [routing.locate_plan(*a) for a in ((None, "x"), ("two words", None), ("one two three", None), ("q", "p"))] == ["structural_path", "semantic", "hybrid", "scoped_semantic"]
    with pytest.raises(routing.InvalidRequest):
        routing.check_locate(None, None)


def test_pack(spark):
    rows = [("src/lib.rs", "fn a() {}\n", None), ("README.md", "# x\n", None), ("src/z.rs", "x\n" * 4000, None), ("src/new.rs", "n", at(-5)), ("src/a_test.rs", "t", None), ("tests/b.rs", "t", None), ("src/popular.rs", "]]>", None)]
    files = values(spark, rows, "path string, content string, modified timestamp_ntz")
    edges = values(spark, [("src/popular.rs", 5)], "file string, in_edges long")
    got = K.pack(files, T0, 2000, "xml", "r&d", edges)
    assert got.included == ["src/lib.rs", "src/new.rs", "src/popular.rs", "src/z.rs"] and got.truncated == ["src/z.rs"] and got.omitted == 0
    assert '<repository name="r&amp;d">' in got.text and "]]]]><![CDATA[>" in got.text and K.MARKER in got.text
    with pytest.raises(K.EmptyScope):
        K.pack(files.limit(0), T0)
    with pytest.raises(K.BudgetTooSmall):
        K.fit_budget([("a", "b")] * 10, 100, 10)
    md = K.pack(files, T0, 2000, "markdown", "r", edges, True, True)
    assert md.included[:2] == ["src/lib.rs", "README.md"] and "```rust\n" in md.text


def test_variables_can_be_referred_to(spark):
    """A function that mentions a constant refers to it; a constant refers to nothing."""
    s = values(spark, [("f::LIMIT::0", "LIMIT", "constant", "f", 0, 10), ("f::go::11", "go", "function", "f", 11, 40)], "symbol_id string, name string, kind string, file string, range_start long, range_end long")
    c = values(spark, [("f", 0, 10, "LIMIT = go"), ("f", 11, 40, "def go(): return LIMIT(1)")], "file string, range_start long, range_end long, text string")
    got = {(r["kind"], r["from_id"], r["to_id"]) for r in G.reference_edges(s, c).collect()}
    assert got == {("References", "f::go::11", "f::LIMIT::0")}


def test_spans_that_cut_a_character_are_kept(spark, tmp_path):
    """Every node within its file has its bytes; only where they cut a character U+FFFD stands for it."""
    from kelpworks.plans import all_queries

    texts = {1: "é" * 9000, 2: "a" + "é" * 9000, 3: "aé\u4e2d" * 6000}
    ranges = [(f, a, b) for f in texts for a, b in ((0, 10), (1, 9), (0, 200), (0, 201), (1, 400), (0, 17000), (1, 17001), (5, 5), (3, 40000))]
    nodes = [(i, f, "k", f"n{i}", f"n{i}", a, b, 1, 1, None, 0) for i, (f, a, b) in enumerate(ranges)]
    spark.createDataFrame(nodes, "id long, file_id long, kind string, label string, path_joined string, byte_start int, byte_end int, line_start int, line_end int, parent_id long, depth int").write.parquet(f"{tmp_path}/structural_nodes.parquet")
    spark.createDataFrame([(f, f"p{f}.txt", t) for f, t in texts.items()], "file_id long, path string, content string").write.parquet(f"{tmp_path}/files.parquet")
    inside = {i: (texts[f].encode(), a, b) for i, (f, a, b) in enumerate(ranges) if b <= len(texts[f].encode())}
    shown = lambda raw: raw.decode("utf-8", "replace")
    spans = {r["id"]: (r["content"], r["truncated"]) for r in all_queries()["locate_spans_all"](spark, str(tmp_path)).collect()}
    assert spans == {i: (shown(t[a : a + 184]) + "\n... (truncated)", True) if b - a > 200 else (shown(t[a:b]), False) for i, (t, a, b) in inside.items()}
    texts_ = {r["id"]: (r["slice"], r["truncated"]) for r in all_queries()["byte_range_text_all"](spark, str(tmp_path)).collect()}
    assert texts_ == {i: (shown(t[a : min(b, a + 16384)]), b - a > 16384) for i, (t, a, b) in inside.items() if b > a}
    cut = [i for i, (t, a, b) in inside.items() if "\ufffd" in spans[i][0]]
    assert cut and not {r["id"] for r in all_queries()["locate_spans"](spark, str(tmp_path)).collect()} & set(cut)


def test_outline_has_every_level(spark):
    """A chain of 40 levels comes out whole; symbols that are above themselves end it."""
    chain = [(f"c{i}", f"n{i}", "f", f"c{i - 1}" if i else None) for i in range(40)]
    loop = [("a", "a", "g", None), ("a", "a", "g", "b"), ("b", "b", "g", "a"), ("x", "x", "g", "y"), ("y", "y", "g", "x")]
    rows = G.outline(values(spark, chain + loop, "symbol_id string, name string, file string, parent_id string")).collect()
    assert {(r["symbol_id"], r["depth"], r["path"]) for r in rows if r["file"] == "f"} == {(f"c{i}", i, "/".join(f"n{k}" for k in range(i + 1))) for i in range(40)}
    assert {(r["symbol_id"], r["depth"], r["path"]) for r in rows if r["file"] == "g"} == {("a", 0, "a"), ("b", 1, "a/b")}


def test_markdown_headings_of_every_form(spark, tmp_path):
    """Titles with '#', indented, closed and setext headings count; lines in both kinds of fences do not."""
    from kelpworks.plans import all_queries

    text = "# A é\n\n## Issue #12\n~~~\n# no\n~~~\n  ## Indented ##\n```\n# no\n```\nSetext\n======\n\nSub\n---\n\n### C\n"
    values(spark, [(1, text), (2, None), (3, "plain")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in all_queries()["md_sections_all"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, "A é", 11), (1, 3, 2, "Issue #12", 7), (1, 7, 2, "Indented", 11), (1, 11, 1, "Setext", None), (1, 14, 2, "Sub", None), (1, 17, 3, "C", None)]


def test_ledger_takes_late_rows_once(spark, tmp_path):
    """Rows that become visible after their arrival are met by the reread, each pair is processed once, whatever is compacted."""
    ledger = IncrementLedger(spark, f"file://{tmp_path}/ledger", compact_every=2)
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdef"), rng.choice(["x", "y", "z"]), at(rng.randint(0, 60)), rng.choice([0, 0, 4, 9])) for i in range(300)]
    seen, state, last = [], {}, 0
    for run in range(1, 8):
        now, low = at(10 * run), at(10 * last - 10)  # what was open at the last success began up to ten hours before it
        visible = [r[:4] for r in rows if r[3] + datetime.timedelta(hours=r[4]) <= now]
        got = ledger.pending(values(spark, visible, "scan_id long, path string, hash string, arrived_at timestamp_ntz"), low, now)
        if run in (2, 5):
            continue  # the run dies
        todo = {r[0]: r for r in visible if r[3] >= low} if run > 1 else {r[0]: r for r in visible}
        fresh = [r for i, r in todo.items() if i not in set(seen)]
        before = dict(state)
        for r in sorted(fresh, key=lambda r: (r[3], r[0])):
            if r[1] not in state or (r[3], r[0]) > state[r[1]][0]:
                state[r[1]] = ((r[3], r[0]), r[2])
        want = {p for p, (_, c) in state.items() if p not in before or before[p][1] != c}
        rows_got = got.collect()
        assert {r["path"] for r in rows_got} == {r[1] for r in fresh}
        assert {r["path"] for r in rows_got if r["changed"]} == want
        seen, last = seen + [r[0] for r in fresh], run
        ledger.commit(run, got, low)
        ledger.commit(run, got, low)
    assert len(seen) == len(set(seen)) and set(seen) == {r[0] for r in rows}
    assert ledger.state().count() == 6 and list(ledger.committed()) == [1, 3, 4, 6, 7]
    with pytest.raises(ValueError):
        ledger.commit(7, ledger.pending(values(spark, [], "scan_id long, path string, hash string, arrived_at timestamp_ntz"), at(0), at(80)))


def test_imports_of_every_shape(spark):
    """Multi-line, aliased, nested and relative imports with what they stand for."""
    files = [
        ("src/a.rs", "rust", "use crate::n::{two, three as four};\nuse b::c;\nuse crate::deep::er::{\n    one,\n    two,\n};\npub use self::x::{y};\n"),
        ("web/a.ts", "typescript", "import x from './m';\nimport { a as b,\n  c } from '../n/q';\nimport 'side';\nexport { d } from './d';\nimport type { T } from './t';\n"),
        ("py/p/a.py", "python", "from .m import x as y, z\nimport a, b as c\nfrom ..up import (\n    q,\n    r,\n)\nfrom . import s\n"),
    ]
    from kelpworks.streaming.changes import resolve_imports

    df = values(spark, files, "path string, language string, content string")
    got = {(r["file"], tuple(r["items"]), r["target_file"]) for r in resolve_imports(code.imports(df)).collect()}
    assert got == {
        ("src/a.rs", ("two", "three"), "src/n.rs"), ("src/a.rs", (), "src/b/c.rs"), ("src/a.rs", ("one", "two"), "src/deep/er.rs"), ("src/a.rs", ("y",), "src/x.rs"),
        ("web/a.ts", ("x",), "web/m.ts"), ("web/a.ts", ("a", "c"), "n/q.ts"), ("web/a.ts", (), None), ("web/a.ts", ("d",), "web/d.ts"), ("web/a.ts", ("T",), "web/t.ts"),
        ("py/p/a.py", ("x", "z"), "py/p/m.py"), ("py/p/a.py", ("c",), None), ("py/p/a.py", ("q", "r"), "py/up.py"), ("py/p/a.py", ("s",), "py/p/__init__.py"),
    }


def test_one_reading_gives_all_tables(spark):
    """Symbols, chunks and imports of one reading are those of the three functions."""
    files = [("a.py", "python", "import x\n\nclass A:\n    def f(self):\n        return 1\n"), ("b.rs", "rust", "use a::b;\nfn g() {}\n"), ("c.md", "markdown", "# T\n\ntext\n"), ("d.py", "python", "def (\n"), ("e.py", None, "x = 1\n"), ("f.py", "python", None), ("g.ts", "typescript", "")]
    df = values(spark, files, "path string, language string, content string")
    rows = lambda d: sorted(map(str, d.collect()))
    parts = code.parts_of(code.parse(df))
    for name, one in (("symbols", code.symbols(df)), ("chunks", code.chunks(df)), ("imports", code.imports(df))):
        assert rows(parts[name]) == rows(one) and parts[name].columns == one.columns and (name == "imports" or parts[name].count())
