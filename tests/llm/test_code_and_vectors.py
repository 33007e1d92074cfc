"""Syntax, hand-written files and neighbours; the queries against DuckDB."""

import ast
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpworks.llm import glr, handwritten, lexers, neighbours, queries, syntax

VALID = {
    "py": ["", "x = 1\n", "if x:\n    pass\nelse:\n    y = [i for i in z if i]\n", "f'{a!r:>{w}} {{}} {b=}'\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': b, **c}: pass\n", "async def f(a, /, b=1, *args, c, **kw) -> int:\n    return await g(*a, **b)\n",
           "@d(1)\nclass A[T](B, metaclass=M):\n    x: int = 3\n    def f(self): yield from x\n", "with (open(a) as f, g()): pass\n", "x = lambda *a, k=1: (yield)\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\n", "print(*a, sep='')\nx[1:2, ..., ::3] = y = 1\n", "match = 1\ntype X = int\n", "a = '''\n'''; b = rb'\\x'\n", "if (n := f()) > 1: x\n", "del a.b, c[0]\nglobal q\n", "x = 1 if y else 2\nnot x in y\n", "def f():\n\tif x:\n\t\tpass\n"],
    "js": ["", "const a = 1\nlet b = `x${a + `y${b}`}z`\n", "x = a / b / c; y = /[/]\\/'/g.test(s)\n", "for (const [k, v] of m) { if (k) continue\n }", "a = b\n(c)\n", "class A extends B { static #x = 1; get y() { return this.#x } async *z() {} static { f() } }", "const {a = 1, ...r} = o, f = async (x, {y}) => ({x, y})", "label: for (;;) { break label }", "do x++; while (x < 3) y()", "export default function () {}\nimport x, {y as z} from './q'\nexport * from 'w'", "!function(){}()", "var a = {get: 1, set b(v) {}, async c() {}, [d]: 2, 'e': 3}", "x?.y?.[0]?.(1) ?? z", "if (a) b; else c", "switch (a) { case 1: default: f() }", "return_ = x => { return\n x }", "new A.B(1)[c]\nnew D", "try {} catch {} finally {}", "a = b ? c : d => e", "/* <<<<<<< */ // >>>>>>>\n"],
    "ts": ["let x: Array<Map<string, number[]>> = f<string>(a as any)!\n", "interface A<T extends B = C> extends D { readonly x?: number\n y(a: string): void; [k: string]: any; new (x: A): B }", "type F = (a: number, ...r: string[]) => a is B\ntype M = { readonly [K in keyof T]?: T[K] }\ntype C = T extends infer U ? `a${U}` : never", "enum E { A = 1, B = 'x', }\ndeclare module 'm' { export const x: number }", "abstract class A<T> implements B, C { constructor(private readonly x: string, public y?: number) { super() }\n abstract f(): void\n private g = 1; @dec() h!: string }", "function f(this: X, a?: number): asserts a is B {}\nfunction g<T>(x: T): T\nfunction g(x) { return <T>x }", "const a = <T,>(x: T): x is Y => x\nimport type { A } from './a'\nexport type { B }", "if (a < b && c > d) {}\nfor (const x of y as Z[]) {}", "namespace A.B { export let x = 1 }", "let t: [a: number, b?: string, ...c: X[]] = [1]"],
    "rs": ["", "#![allow(x)]\nuse a::{b, c as d, e::*};\npub(crate) fn f<'a, T: X + ?Sized>(x: &'a mut T) -> Result<(), Box<dyn E>> where T: Y { let Some(x) = y else { return Err(z)? }; Ok(()) }", "impl<T> A<T> for B where T: Fn(u8) -> u8 { const X: usize = 1; type Y = Z; fn g(&self) -> impl Iterator<Item = u8> + '_ { self.x.iter().map(|&a| a as u8 + 1) } }", "fn m() { match x { A { y, .. } if y > 1 => 2, B(1..=3 | 5) => {} _ => return, } let v = vec![1; 3]; println!(\"{}\", v[0]); }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "enum E { A = 1, B(u8), C { x: u8 } }\nstruct S(pub u8);\nunion U { a: u8 }", "fn f() { if x == S { } else if let Some(y) = z && w {} 'l: loop { break 'l 1; } unsafe { *p = 2 } a.0.1; x..=y; &mut *z; async move { f().await }; }", "static A: [char; 2] = ['(', '\\''];\nconst B: &str = r#\"a\"b\"#;", "trait T: A + B { fn f(self: Box<Self>) -> Self::X; }", "extern \"C\" { fn f(x: *const u8, ...); }", "fn f() -> Vec<Vec<u8>> { x::<Vec<Vec<u8>>>() >> 1 }"],
    "json": ["{}", '[1, -2.5e3, "a\\u00e9", {"x": [true, null]}]', ' "x" '],
    "toml": ["", 'a = 1\n[t.x]\nb = [1,\n 2, ] # c\nd = {e = "f", g.h = 1}\n[[q]]\n', "'a b' = 1979-05-27T07:32:00Z\nx = '''\n'''\ny = 0xff\nz = -inf\n"],
    "yaml": ["", "a: 1\nb:\n  - x\n  - y: z\n    w: [1, {q: r}]\nc: |\n  text\n   more\nd: >-\n  folded\n", "---\nx: &a {b: 'it''s'}\ny: *a\n...\n---\n- 1\n-\n  - 2\n", "plain text\nover lines\n", "? a\n: b\n", "a: \"x\n  y\"\n", "a:\n- b\n- c\nd: !!str 1 # note\n"],
}
INVALID = {
    "py": ["def f(:\n", "if x\n    y\n", "x = (1,\n", "  x = 1\n", "<<<<<<< HEAD\nx = 1\n", "'abc\n", "x = 1 +\n", "def f():\nreturn\n", "f() = 1\n", "0777\n", "1abc\n", "x\0y\n", "else:\n    pass\n", "f'{a'\n", "class A\n", "use a::b;\n", "if x:\n        a\n    b\n"],
    "js": ["function f( {", '{"a": 1}', "let x = ;", "<<<<<<< ours\na\n", "const a: number = 1", "x = 'abc\n", "for (;;", "}", "def f(x):\n  return x\n", "enum A { B }", "a b", "`${x", "/* open", "const x = 5 const y", "a: 1\nb: 2\n- c d\n"],
    "ts": ["interface A { x: ", "let x: = 1", "=======\n", "pub enum A { B }", "# Title\n\nSome text here\n", "class A { constructor(", "function f(): number[] { const a: number[] = []; for (c", "export const x = async (a: string): Promise<string> => {"],
    "rs": ["fn f( {", "pub fn f() -> { }", "let x = 1;", "fn f() { x + }", "<<<<<<< HEAD\nfn f() {}\n", "import { a } from './b';", "fn f() { match x { A => } }", "struct S { x: u8, y }", "fn f() { \"abc }", "0;a b;1.2", "fn f() { }}"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", '{"a": "b\n"}', "{} x", "nul", "01"],
    "toml": ["a", "a = ", "[t", 'x = "abc\n', "a = 1 b = 2", "a: 1", "<<<<<<< HEAD", "x = [1, 2", "x = 01\n"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: 'x\n", "a: 1\n b: 2\n", "\tx: 1\n", "a: 1\nfoo\nb: 2\n", "x: \0\n", "- a\nb: 1\n", "a: |x\n  y\n", "a: }\n"],
}


@pytest.mark.parametrize("ext", sorted(VALID))
def test_valid(ext):
    for text in VALID[ext]:
        assert syntax.first_error(ext, text) is None, (ext, text, syntax.first_error(ext, text))


@pytest.mark.parametrize("ext", sorted(INVALID))
def test_invalid(ext):
    for text in INVALID[ext]:
        assert syntax.first_error(ext, text) is not None, (ext, text)


def test_first_error_is_placed():
    assert syntax.first_error("py", "x = 1\ny = (2\nz = 3\n")[0] >= 2
    assert syntax.first_error("rs", "fn a() {}\n\nfn b( {\n}\n")[0] == 3


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 200))
def test_damaged_python_like_its_own_parser(seed, at):
    """A piece of a real module, cut at random, is judged as `ast` judges it."""
    with open(ast.__file__) as f:
        lines = f.read().split("\n")
    rng = random.Random(seed)
    start = rng.randrange(len(lines))
    text = "\n".join(lines[start : start + 30])
    text = text[: max(0, len(text) - at)]
    try:
        ast.parse(text)
        ok = True
    except SyntaxError:
        ok = False
    assert (lexers.check_python(text) is None) == ok, text


def test_ambiguity_keeps_all_readings():
    t = glr.Tables(glr.Grammar("s : s s | 'a' ;"))
    for n in range(1, 12):
        p = glr.Parser(t)
        assert all(p.feed("a") for _ in range(n)) and p.feed(glr.END)
    assert not glr.Parser(t).feed("b")


def test_checked_files(spark):
    rows = [(1, "r", "a/x.PY", "x = (", 1), (1, "r", "a/x.PY", "x = (", 1), (2, "r", "a\\y.js", "let a", 1), (3, None, "z.json", "", 1), (4, "q", "n.md", "(", 1), (5, "q", "m.rs", None, 1), (6, "q", None, "x", 1), (7, "q", "k.ts", "", 1)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string, ext int")
    got = syntax.checked_files(df)
    assert sorted((r["file_id"], r["valid"]) for r in got.collect()) == [(1, False), (2, True), (3, False), (7, True)]
    assert {(r["repo"], r["language"]): r["share"] for r in syntax.error_rates(got).collect()}[("r", "python")] == 1.0
    assert syntax.error_rates(syntax.checked_files(df.limit(0))).count() == 0


# --- hand-written files -------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_repair_round_trip(seq):
    last, rules = handwritten.repair(seq)
    base = list(dict.fromkeys(seq))

    def expand(x):
        return [base[x]] if x < len(base) else expand(rules[x - len(base)][0]) + expand(rules[x - len(base)][1])

    assert [y for x in last for y in expand(x)] == seq


HAND = 'import { a } from "./a";\n\n// Reports generated by the nightly job end up in x; edit the job, not the report.\nexport function total(items: number[]): number {\n  let sum = 0;\n  for (const i of items) {\n    if (i > 3) sum += i;\n  }\n  return sum;\n}\n\nconst SMALL = [1, 2, 3, 5, 8, 13];\nconst HEADER = "// @generated by our emitter";\n'
OTHER = "def walk(tree, seen):\n    for node in tree.children:\n        if node.name not in seen:\n            seen.add(node.name)\n            walk(node, seen)\n    return sorted(seen)\n"
GETTERS = "".join(f"export function getField{i}(m: number[]): number {{ return m[{i}]; }}\n" for i in range(40))
BLOB = random.Random(1)
FILES = {
    1: ("r/src/a.ts", HAND, None),
    2: ("r/src/gen.ts", "// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"),
    3: ("r/src/b.ts", GETTERS, "generated"),
    4: ("r/vendor/p/c.py", OTHER, "third-party"),
    5: ("s/src/d.py", OTHER.replace("    ", "  "), "copy"),
    6: ("r/src/e.py", "TABLE = [\n" + "".join(f"    {BLOB.randint(0, 99999)}, {BLOB.randint(0, 99999)},\n" for _ in range(200)) + "]\n", "data"),
    7: ("r/src/f.rs", 'pub const D: &str = "' + "".join(BLOB.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(3000)) + '";\n', "data"),
    8: ("r/src/g.js", "".join(f"function q{i}(p,t){{return p.x>{i}?t(p.x):void 0}}var m{i}=function(c){{for(var i=0;i<9;i++)c[i]+={i};return c}};" for i in range(20)), "minified"),
    9: ("r/deps-lock.json", '{"packages": {' + ",\n".join(f'"p{i}@1.{i}.0": {{\n"version": "1.{i}.0",\n"integrity": "h512-{BLOB.random()}"}}' for i in range(6)) + "}}", "lock"),
    10: ("r/vendors/h.py", OTHER + "\nprint(walk)\n", None),
    11: ("r/data.csv", "a,b,c\n" * 50, None),
    12: ("r/src/i.py", None, None),
    13: ("r/node_modules/j.js", None, "third-party"),
    14: ("r/src/k.py", "", None),
    15: ("r\\third_party\\l.ts", HAND + "export {};\n", "third-party"),
    16: ("r/src/query.rs", 'fn f() -> u8 { 1 }\nconst LONG: &str = "' + "Every answer names the file and the line. " * 40 + '";\n', None),
    17: ("r/src/dump.py", "".join(f"{i};name {i % 7};{BLOB.random():.3f};{BLOB.random()}\n" for i in range(40)), "data"),
    18: ("r/src/up.rs", "// Upstream copy of foo 1.2.3, imported unchanged; report problems there.\nfn f() {}\n", "third-party"),
}


def test_not_handwritten(spark):
    rows = [(i, p, c, "x") for i, (p, c, _) in FILES.items()] + [(2, *FILES[2][:2], "x"), (None, "r/vendor/x.py", "x", "x"), (99, None, "x", "x")]
    df = spark.createDataFrame(rows, "file_id long, path string, content string, mark string")
    got = {r["file_id"]: r["reason"] for r in handwritten.not_handwritten(df).collect()}
    assert got == {i: r for i, (_, _, r) in FILES.items() if r}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_comments_by_language():
    """// divides in Python and # is private in JavaScript; neither hides what follows."""
    mark = lambda p, t: handwritten.profile(p, t)[1]
    assert mark("r/a.py", "x = a // b\n") != mark("r/a.py", "x = a // (b * 7)\n") and mark("r/a.py", "x = a # b\n") == mark("r/a.py", "x = a # c\n")
    assert mark("r/a.js", "this.#x = 1\n") != mark("r/a.js", "this.#y = 1\n") and mark("r/a.js", "a // b\n") == mark("r/a.js", "a // c\n")
    assert mark("r/a.md", "see http://a\n") != mark("r/a.md", "see http://b\n")
    rows = ",".join(f'{{"id": {i}, "at": {i * 0.7:.2f}}}' for i in range(90))
    assert handwritten.profile("r/a.rs", f'pub const ROWS: &str = r#"[{rows}]"#;\n')[0] == ("data", "literals")


def test_edited_copies_share_rules(spark):
    """A vendored file with a changed token is found in another repository; files that share common lines are not."""
    words = "parse fold scan merge route split align emit store fetch".split()
    rng = random.Random(4)
    body = lambda k: "".join(f"def {rng.choice(words)}_{rng.choice(words)}{k}(rows, depth={rng.randint(2, 99)}):\n    total = {rng.choice(words)}(rows[{'abcdefghijk'[i]}{k}] + depth)\n    return total.{rng.choice(words)}(depth, {rng.choice(words)}{chr(97 + i)}{k}x)\n\n" for i in range(8))
    texts = [body(chr(97 + k) * 3) for k in range(26)]
    library = texts[0]
    rows = [(1, "a", "a/vendor/lib/x.py", library), (2, "b", "b/src/x.py", library.replace("rows[c", "lines[c", 1)), (3, "b", "b/src/y.py", library)]
    rows += [(10 + i, "c", f"c/src/f{i}.py", t) for i, t in enumerate(texts[1:])]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string")
    got = {r["file_id"]: (r["reason"], r["evidence"]) for r in handwritten.not_handwritten(df).collect()}
    assert got == {1: ("third-party", "folder"), 2: ("copy", "rules"), 3: ("copy", "rules")}


def test_copies_of_files_whose_rules_other_files_hold_too(spark):
    """An edited copy is found although each function of its source also stands in a third-party file that comes before it."""
    words = "parse fold scan merge route split align emit store fetch".split()
    rng = random.Random(6)
    part = lambda k: "".join(f"def {rng.choice(words)}_{k}{c}(rows, depth={rng.randint(2, 99)}):\n    total = {rng.choice(words)}(rows[{c}{k}] + depth)\n    return total.{rng.choice(words)}(depth, {rng.choice(words)}{c}{k}x)\n\n" for c in "ab")
    parts = [part(chr(97 + k) * 3) for k in range(6)]
    library = "".join(parts)
    rows = [(1, "m", "m/vendor/lib/x.py", library), (2, "z", "z/src/x.py", library.replace("rows[a", "lines[a", 1))]
    rows += [(10 + i, f"a{i}", f"a{i}/vendor/part/y.py", p + part(chr(110 + i) * 4)) for i, p in enumerate(parts)]
    rows += [(30 + i, "c", f"c/src/f{i}.py", part(chr(97 + i) * 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string")
    got = {r["file_id"]: (r["reason"], r["evidence"]) for r in handwritten.not_handwritten(df).collect()}
    assert got == {i: ("third-party", "folder") for i in (1, *range(10, 16))} | {2: ("copy", "rules")}


def test_edited_copies_by_brute_force(spark):
    """Every source counts with all that it holds, also where others hold the same and where one token sequence has two layouts."""
    rng = random.Random(8)
    rows, fresh = [], iter(range(10_000, 99_999))
    pool = [[next(fresh) for _ in range(12)] for _ in range(8)]
    for i in range(160):
        held = set(range(rng.randint(0, 3)))  # what everybody writes
        base = rng.choice(pool)
        held |= set(rng.sample(base, rng.randint(3, 12))) | set(rng.sample(rng.choice(pool), rng.randint(0, 4))) | {next(fresh) for _ in range(rng.randint(0, 2))}
        mark = rng.choice([r[2] for r in rows]) if rows and rng.random() < 0.15 else i
        rows.append((i, f"r{rng.randint(0, 5)}", mark, rng.random() < 0.4, sorted(held), None))
    df = spark.createDataFrame(rows, "file_id long, repo string, mark long, third boolean, phrases array<long>, reason string")
    for one_source in (0.45, 0.6):
        got = {tuple(r) for r in handwritten.edited_copies(df, one_source=one_source, amount=2.0).collect()}
        assert got == _edited_copies(rows, 0.75, one_source, 2.0) and 10 < len(got) < 90


def _edited_copies(rows, share, one_source, amount):
    classes, repos = {}, {}
    for _, repo, mark, third, phrases, _ in rows:
        classes.setdefault(mark, set()).update(phrases)
        if third:
            repos.setdefault(mark, set()).add(repo)
    count = Counter(x for c in classes.values() for x in c)
    weight = {x: (math.log(1 + len(classes) / n) / math.log(1 + len(classes))) ** 2 for x, n in count.items()}
    out = set()
    for _, repo, mark, third, phrases, _ in rows:
        others = [] if third else [classes[s] for s, r in repos.items() if r - {repo}]
        whole = sum(weight[x] for x in phrases)
        top = max((sum(weight[x] for x in phrases if x in o) for o in others), default=0)
        if top >= amount and top >= one_source * whole and sum(weight[x] for x in phrases if any(x in o for o in others)) >= share * whole:
            out.add((repo, mark))
    return out


def test_short_copies_count(spark):
    """A one-line copy is a copy; files of comments only have no tokens to share."""
    rows = [(1, "a/vendor/x/index.js", "export * from './y';\n"), (2, "b/src/index.js", "// y\nexport * from './y';\n"), (3, "b/src/z.js", "export * from './z';\n"), (4, "a/vendor/x/c.js", "// c\n"), (5, "b/src/d.js", "// d\n")]
    got = {r["file_id"]: r["reason"] for r in handwritten.not_handwritten(spark.createDataFrame(rows, "file_id long, path string, content string")).collect()}
    assert got == {1: "third-party", 2: "copy", 4: "third-party"}


def test_long_file_is_read_to_its_end():
    text = OTHER + "# filler line with words\n" * 20_000 + "x = 1\n"
    assert handwritten.profile("r/a.py", text)[1] != handwritten.profile("r/a.py", text + "y = 2\n")[1]


NOT_PYTHON = [
    'try:\n    pass\nexcept ValueError, e:\n    pass\n',
    'f(a=1, 2)\n',
    'def f(a=1, b): pass\n',
    '1 + not y\n',
    'x = y := 0\n',
    "'x' b'y'\n",
    'x := 1\n',
    'f(**a, *b)\n',
    'f(**a, b)\n',
    'def f(*): pass\n',
    'def f(*, **k): pass\n',
    'def f(**k, a): pass\n',
    'def f(/, a): pass\n',
    'def f(a, *b, *c): pass\n',
    'lambda a=1, b: 0\n',
    'a == not b\n',
    '[x for x in y if z := 1]\n',
    'f(x for x in y, 1)\n',
    'def f() -> a, b: pass\n',
    'return x := 1\n',
    'try:\n    pass\nexcept*:\n    pass\n',
    '-not x\n',
]
PYTHON = [
    'try:\n    pass\nexcept (A, B) as e:\n    pass\nexcept:\n    pass\n',
    'try:\n    pass\nexcept* A:\n    pass\n',
    'f(1, *a, b=2, *c, **d, e=3, **g)\n',
    'f(a:=1, 2, x=not y)\n',
    'def f(a, b: int = 1, /, c=2, *d: int, e, g=1, **h): pass\n',
    'def f(a, /, b, c=1, *, d): pass\n',
    'def f(a, /): pass\n',
    'def f(*, a): pass\n',
    'def f(a=1, /, b=2,): pass\n',
    'lambda a, /, b=1, *c, d, **e: 0\n',
    'lambda *a, b=1: 0\n',
    'lambda: 0\n',
    'not a == b and not c or not not d\n',
    '(y := f(x))\n',
    '[y := 1, *a]\n',
    'while x := f(): pass\n',
    'a[b:=1]\n',
    'a[1:2, *b]\n',
    "b'x' b'y'\n'x' f'y{z}' 'q'\n",
    'x = a if not b else not c\n',
    "{**a, 'b': not c}\n",
    'a not in b is not c\n',
    'await_ = 1\nx = -a ** -b\n',
    '[x for x in y if not z if w or v]\n',
    'f(x for x in y)\n',
    'def f() -> list[int]: pass\n',
    'match x, y:\n    case 1, 2: pass\n',
    "match x:\n    case b'a': pass\n",
    'class A(B, metaclass=C, **k): pass\n',
    'a < b + c | d\n',
    "print(*a, sep='')\n",
    'x: int = yield_\n',
    'def g():\n    x = yield 1\n    return *a, b\n',
    'f(**a)\n',
    'f(a, **b,)\n',
    'x = lambda a: not a\n',
    "assert not x, 'y'\n",
]


def test_python_agrees_with_ast():
    """Order of parameters and arguments, the places of 'not' and ':=', handlers, bytes beside text."""
    for text in NOT_PYTHON:
        with pytest.raises(SyntaxError):
            ast.parse(text)
        assert lexers.check_python(text) is not None, text
    for text in PYTHON:
        ast.parse(text)
        assert lexers.check_python(text) is None, text


# --- neighbours ---------------------------------------------------------------------------------


def brute(vectors, k):
    out = set()
    for i, (a, x) in enumerate(vectors):
        s = sorted(((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), b) for b, y in vectors if b != a))[:k]
        out |= {(a, b) for _, b in s}
    return out


def test_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(900, 24))
    rows = [(i, "m", base[i].tolist(), 24) for i in range(900)]
    rows += [(1000 + i, "m", (base[i % 60] + rng.normal(size=24) * 0.05).tolist(), 24) for i in range(180)]
    rows += [(2000 + i, "m", base[5].tolist(), 24) for i in range(400)]  # a third are copies
    rows += [(3000, "m", None, 24), (3001, "m", [], 24), (3002, "m", [1.0] * 23, 24), (3003, "m", [0.0] * 24, 24), (3004, "m", [float("nan")] * 24, 24), (3005, "m", [float("inf")] * 24, 24), (3006, "other", base[0].tolist(), 24), (3007, None, base[0].tolist(), 24)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:50]], "vec_id long, model string, embedding array<float>, dimension int, class string")
    got = {(r["vec_id"], r["other"]) for r in neighbours.most_similar(df, 5, shard_size=300).collect()}
    good = [(i, np.asarray(np.float32(e), float)) for i, m, e, d in rows if m == "m" and i < 3000]
    want = brute(good, 5)
    assert len(got & want) / len(want) > 0.9 and len(got) == len(want)
    pairs = neighbours.close_pairs(neighbours.most_similar(df, 5, 0.93, shard_size=300)).collect()
    assert all(r["vec_a"] < r["vec_b"] for r in pairs) and not any(r["vec_b"] >= 3000 for r in pairs)
    assert {(r["vec_a"], r["vec_b"]) for r in pairs if r["vec_a"] == 5} >= {(5, 2000), (5, 2399)}
    assert neighbours.most_similar(df.limit(0)).count() == 0


def test_rescaled_vectors_are_one_direction(spark):
    """A group of one direction and many norms: ties go by the smaller id for its members and for vectors near it."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 24)).astype(np.float32)
    twos = [(1000 + i, base[7] * np.float32(2.0) ** (i % 40 - 20)) for i in range(300)]  # exactly one direction
    any_ = [(2000 + i, base[9] * np.float32(rng.uniform(0.01, 90))) for i in range(300)]  # up to float rounding
    near = [(3000 + i, (base[7] + rng.normal(size=24) * 0.05).astype(np.float32)) for i in range(20)]
    few = [(4000 + i, base[20 + i % 30] * np.float32(rng.uniform(0.1, 9))) for i in range(60)]
    vectors = [*enumerate(base), *twos, *any_, *near, *few]
    df = spark.createDataFrame([(i, "m", x.tolist(), 24) for i, x in vectors], "vec_id long, model string, embedding array<float>, dimension int")
    got = neighbours.most_similar(df, 5, shard_size=400).collect()
    pairs, want = {(r["vec_id"], r["other"]) for r in got}, brute([(i, x.astype(float)) for i, x in vectors], 5)
    # A vector outside the second group, but nearest to it, may be given any of its members.
    sure = lambda ps: {(a, b) for a, b in ps if a in {7, 9} or a >= 1000}
    assert sure(pairs) == sure(want)
    assert len(pairs & want) / len(want) > 0.9 and len(pairs) == len(want) == 5 * len(vectors)
    assert sorted(r["rank"] for r in got if r["vec_id"] == 1200) == [1, 2, 3, 4, 5]


# --- the queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if name in queries.SQL:
        import os

        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
        t = con.execute(queries.SQL[name])
        names = [d[0] for d in t.description]
        other = [tuple(dict(zip(names, r))[c] for c in cols) for r in t.fetchall()]
        assert sorted(map(str, rows)) == sorted(map(str, other))
