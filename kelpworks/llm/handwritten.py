"""Telling hand-written source files from generated, minified, third-party and data files.

For each file of a programming language a Re-Pair grammar is inferred over its tokens: the most frequent pair of
neighbours becomes a rule, again and again, until no pair occurs twice. Names are taken without their counters and
literals by their kind, so code emitted in a loop collapses.

* A file of whose tokens the grammar saves most is generated, or data if it is mostly literals.
* Literals that fill a file are data if a grammar over them saves next to nothing (blobs), or if it
  saves nearly all and they are hardly words (rows in a string).
* The rules, as the token sequences that they stand for, and the lines of the grammar's start are compared across
  repositories, each weighted by its rarity. A file most of whose weight is found in third-party folders of other
  repositories, and half of it under one third-party file, is a copy, also if it was edited. A file with the whole token
  sequence of a third-party file, of whatever length, is one in any repository.

Where the grammar shows nothing, paths, file names, the shape of lines and the comments at the head of a file do.

Defined cases: null contents are judged by path alone; empty files are hand-written unless their folder
says otherwise; repeated rows are one file; both path separators count; null paths are not judged; a
null repo is that of the path's first folder; a null language or size changes nothing; ties do not occur; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut

#: Extensions of programming languages.
CODE = frozenset("rs ts tsx js jsx mjs cjs py go java c h cc cpp hpp cs rb php swift kt scala lua pl sh".split())
#: Folders that hold third-party copies, and those that hold a generator's output.
THIRD_PARTY = frozenset("vendor _vendor vendored node_modules bower_components third_party thirdparty third-party site-packages".split())
OUTPUT = frozenset("generated __generated__ autogen _generated auto_generated".split())
MAYBE_OUTPUT = frozenset("gen out dist build target codegen_out".split())

_NAME_GENERATED = re.compile(r"(_pb2?(_grpc)?\.(py|js|ts|rs)|\.pb\.\w+|\.(generated|gen|g|designer)\.\w+)$", re.I)
_NAME_MINIFIED = re.compile(r"[.-]min\.(js|css|mjs)$|\.(bundle|chunk)(\.[0-9a-f]{6,})?\.m?js$", re.I)
_NAME_LOCK = re.compile(r"^([\w.]+[-.])?lock(file)?\.(json|ya?ml|toml|lock)$|\.lock$|^(package-lock|npm-shrinkwrap)\.json$|^[\w-]+[.-]lock\.(json|ya?ml|toml)$|^go\.sum$", re.I)
_LOCK_ENTRY = re.compile(r"(?im)^\W*(integrity|checksum|sha\d+|resolution|resolved|hash)\W")
_LOCK_VERSION = re.compile(r"(?im)(^\W*version\W|@\d+\.\d+)")
_HEAD = re.compile(r"\A(?:\ufeff)?(?:\#![^\n]*\n)?(?:\s*(?://[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/|<!--.*?-->|--[^\n]*|(?:[rbu]?)(?:\"\"\".*?\"\"\"|'''.*?''')))+", re.S)
_GENERATED = re.compile(r"@generated|<auto-?generated|\bauto-?generated\b|\b(?:automatically|machine)[ -]generated|\b(?:file|code|source|module) (?:was |is |has been )?generated\b|\bdo not (?:edit|modify|change)\b|\bgenerated\b[^\n]{0,80}\b(?:any edit|edits? (?:is|are|will)|changes? will|overwritten)|\bany (?:edit|change)s? (?:is|are|will be) (?:overwritten|lost)", re.I)
_VENDORED = re.compile(r"\bvendored (?:from|copy)|\b(?:upstream|third[- ]party|verbatim) copy\b|\bimported unchanged\b|\bcopied (?:verbatim|unchanged) from\b|\bthird[- ]party (?:code|source|library|file)\b", re.I)
#: The extensions whose line comments begin with # or --; those of other code begin with //.
HASH_COMMENTS = frozenset("py rb pl sh yaml yml toml lock".split())
DASH_COMMENTS = frozenset("lua sql".split())


def _tokenizer(skip: str, strings: str) -> re.Pattern:
    return re.compile(rf"(?P<skip>[ \t\r\f]+|{skip})|(?P<nl>\n)|(?P<str>{strings})|(?P<num>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<op>.)", re.S)


_QUOTED = r"""\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"""
_TOKENS = {
    "slash": _tokenizer(r"//[^\n]*|/\*.*?(?:\*/|\Z)", _QUOTED + r"|`(?:[^`\\]|\\.)*`"),
    "rust": _tokenizer(r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"""b?r(?P<h>\#*)\".*?\"(?P=h)|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{1,8})'"""),
    "hash": _tokenizer(r"\#[^\n]*", r"""[a-zA-Z]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'\''.*?(?:'\''|\Z))|""".replace("'\\''", "'''") + _QUOTED),
    "dash": _tokenizer(r"--[^\n]*", _QUOTED),
    "plain": _tokenizer(r"(?!)", _QUOTED),
}


def family(ext: str) -> str:
    """How a file's comments and literals are written, by its extension."""
    return "rust" if ext == "rs" else "hash" if ext in HASH_COMMENTS else "dash" if ext in DASH_COMMENTS else "slash" if ext in CODE or ext in ("css", "scss", "less") else "plain"


_COUNTER = re.compile(r"\d+")
_DENSE = re.compile(r"[^\s\"'`]{40,}")
_ROW = re.compile(r"^[^(){}=<>\"'`:]*$")
#: Fixed value: bounds on sums of weights are lowered by it, as a sum depends on its order in the last digits.
_ROUNDING = 1 - 1e-9


def repair(seq: list) -> tuple[list, list]:
    """The Re-Pair grammar of seq: (last sequence, rules as pairs).

    Symbols are numbers: the distinct elements of seq in order of appearance, then the rules.
    """
    ids: dict = {}
    s = [ids.setdefault(x, len(ids)) for x in seq]
    n = len(s)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        where.setdefault((s[i], s[i + 1]), set()).add(i)
    heap = [(-len(v), k) for k, v in where.items() if len(v) > 1]
    heapq.heapify(heap)
    rules, fresh = [], len(ids)
    while heap:
        c, pair = heapq.heappop(heap)
        at = where.get(pair)
        if at is None or len(at) < 2:
            continue
        if -c != len(at):
            heapq.heappush(heap, (-len(at), pair))
            continue
        del where[pair]
        a, b = pair
        done, touched = 0, set()
        for i in sorted(at):
            j = nxt[i]
            if s[i] != a or j >= n or s[j] != b:  # overlaps with the one before, as in a a a
                continue
            p, q = prv[i], nxt[j]
            if p >= 0:
                old = where.get((s[p], a))
                if old is not None:
                    old.discard(p)
            if q < n:
                old = where.get((b, s[q]))
                if old is not None:
                    old.discard(j)
            s[i], s[j] = fresh, -1
            nxt[i] = q
            if q < n:
                prv[q] = i
                where.setdefault((fresh, s[q]), set()).add(i)
                touched.add((fresh, s[q]))
            if p >= 0:
                where.setdefault((s[p], fresh), set()).add(p)
                touched.add((s[p], fresh))
            done += 1
        if done:
            rules.append(pair)
            fresh += 1
        for t in touched:
            if len(where[t]) > 1:
                heapq.heappush(heap, (-len(where[t]), t))
    return [x for x in s if x >= 0], rules


def grammar_size(seq: list) -> float:
    """The size of the grammar against that of the sequence: near 0 for a repeated pattern, 1 if nothing repeats."""
    last, rules = repair(seq)
    return (len(last) + 2 * len(rules)) / max(1, len(seq))


def rule_phrases(loose: list, last: list, rules: list, least: int = 6, least_line: int = 5) -> set[int]:
    """Hashes of what a grammar's rules stand for (`least` tokens or more) and of the lines of the sequence."""
    names = list(dict.fromkeys(loose))
    spans: list[str | None] = list(names)
    sizes = [1] * len(names)
    out = set()
    for a, b in rules:
        sizes.append(sizes[a] + sizes[b])
        # What stands for more tokens than a screen of code is no phrase, but its parts are; so expansions stay linear.
        both = None if spans[a] is None or spans[b] is None or sizes[-1] > 400 else f"{spans[a]}\0{spans[b]}"
        spans.append(both)
        if both is not None and sizes[-1] >= least:
            out.add(both)
    line: list[str] = []
    for t in [*loose, "\n"]:
        if t != "\n":
            line.append(t)
            continue
        if len(line) >= least_line:
            out.add("\0".join(line))
        line = []
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in out}


def tokens(text: str, ext: str = "") -> tuple[list, list, list[str], int]:
    """(normalised tokens, exact tokens, literals, characters that are neither blank nor comment)."""
    loose, exact, literals, solid = [], [], [], 0
    for m in _TOKENS[family(ext)].finditer(text):
        kind, t = m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "nl":
            if loose and loose[-1] != "\n":
                loose.append("\n")
            continue
        solid += len(t)
        exact.append(t)
        if kind == "name":
            loose.append(_COUNTER.sub("#", t))
        elif kind == "op":
            loose.append(t)
        else:
            literals.append(t)
            loose.append("0" if kind == "num" else '""')
    return loose, exact, literals, solid


def profile(path: str, content: str | None) -> tuple[tuple[str, str] | None, int | None, bool, set[int]]:
    """((reason, evidence) or None, fingerprint of the token sequence, whether the folder is a third-party one, phrases of the rules)."""
    parts = path.replace("\\", "/").split("/")
    folders, name = {p.lower() for p in parts[:-1]}, parts[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    third = bool(folders & THIRD_PARTY)
    named = ("third-party", "folder") if third else ("minified", "name") if _NAME_MINIFIED.search(name) else ("generated", "folder") if folders & OUTPUT else ("generated", "name") if _NAME_GENERATED.search(name) else None
    if content is None or not content.strip():
        return named or (("lock", "name") if _NAME_LOCK.search(name) and content is None else None), None, third, set()
    loose, exact, literals, solid = tokens(content, ext)
    mark = xxhash.xxh64_intdigest("\0".join(exact)) - (1 << 63) if exact else None
    if ext not in CODE:
        return named or _by_entries(name, ext, content), mark, third, set()
    last, rules = repair(loose)
    phrases = rule_phrases(loose, last, rules)
    saved = 1 - (len(last) + 2 * len(rules)) / max(1, len(loose))
    shown = ("minified", "lines") if _minified(content, ext) else _by_grammar(loose, saved, literals, solid, folders)
    if shown is None and _delimited(content):
        shown = ("data", "lines")
    reason = named if third else shown or named or _by_head(content)
    return reason, mark, third, phrases


def _by_grammar(loose: list, saved: float, literals: list[str], solid: int, folders: set[str], most: float = 0.7, in_output: float = 0.6, worth: int = 40) -> tuple[str, str] | None:
    """What the grammars show. A grammar tells something if it saves the share `most` (`in_output` in folders
    that often hold output) and at least `worth` tokens: in a few lines anything may come again."""
    size = sum(map(len, literals))
    if saved >= (in_output if folders & MAYBE_OUTPUT else most) and saved * len(loose) >= worth:
        return ("data" if size > 0.45 * solid and size > 600 else "generated"), "grammar"
    dense = "".join(x for t in literals if len(t) > 40 for x in _DENSE.findall(t))
    if len(dense) > 600 and len(dense) > 0.6 * solid and _incompressible(dense):
        return "data", "literals"
    if size > 600 and size > 0.8 * solid:
        inner = [t for lit in literals if len(lit) > 200 for t in tokens(lit.strip("\"'`r#b"))[0]]
        words = sum(t[:1].isalpha() for t in inner)
        if 2 * words < len(inner) and grammar_size(inner) <= 1 - most:
            return "data", "literals"
    return None


def _by_head(content: str) -> tuple[str, str] | None:
    head = _HEAD.match(content)
    if head and _VENDORED.search(head.group()):
        return "third-party", "head"
    return ("generated", "head") if head and _GENERATED.search(head.group()) else None


def _by_entries(name: str, ext: str, content: str) -> tuple[str, str] | None:
    """Lock files: entries with checksums and versions."""
    if ext in ("json", "yaml", "yml", "toml", "lock", "sum"):
        entries = len(_LOCK_ENTRY.findall(content))
        if (_NAME_LOCK.search(name) and (entries or ext == "lock")) or (entries >= 3 and len(_LOCK_VERSION.findall(content)) >= entries > content.count("\n") / 12):
            return "lock", "entries"
    return None


def _minified(content: str, ext: str) -> bool:
    """Long lines of code (strings and comments aside) with hardly a blank."""
    code = re.sub(r"//[^\n]*|/\*.*?\*/" + (r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'" if ext != "rs" else r"|\"(?:[^\"\\]|\\.)*\""), "", content, flags=re.S)
    longest = max(code.split("\n"), key=len, default="")
    return len(longest) > 250 and len(longest) > 0.5 * len(code) and sum(c in " \t" for c in longest) < 0.12 * len(longest) and sum(c in "{}();=" for c in longest) > 0.08 * len(longest)


def _incompressible(dense: str) -> bool:
    """Whether the grammar over a literal's neighbouring characters, two at a time, saves next to nothing."""
    pieces = [dense[i : i + 2] for i in range(0, len(dense), 2)]
    return grammar_size(pieces) > 0.6


def _delimited(content: str) -> bool:
    """Rows of fields: nearly all lines have the same two or more delimiters and nothing else of code."""
    lines = [x for x in content.splitlines() if x.strip()]
    if len(lines) < 10:
        return False
    for mark in ";,|\t":
        n = lines[len(lines) // 2].count(mark)
        if n >= 2 and sum(x.count(mark) == n and bool(_ROW.match(x)) for x in lines) > 0.9 * len(lines):
            return True
    return False


def edited_copies(judged: DataFrame, share: float = 0.75, one_source: float = 0.45, amount: float = 3.0) -> DataFrame:
    """`repo, mark`: the classes of files that share their rules with third-party files of other repositories.

    judged has `file_id, repo, mark, third, reason, phrases`. Equal token sequences are one class; it holds the phrases of
    all of its files, which differ where lines are broken elsewhere. A phrase weighs
    (ln(1 + classes / its classes) / ln(1 + classes)) ** 2: 1 if only one class has it, next to nothing for what everybody
    writes. A class is a copy if third-party phrases have `share` of the weight of one of its files, those of one
    third-party class `one_source` of it and at least `amount`.

    Phrases are counted first, and each is put down to one of its third-party classes. That settles the files whose counts
    are too low and those that have enough under one class even so; the others meet every class that could do.
    """
    coded = judged.filter("mark IS NOT NULL AND size(phrases) > 0")
    sources = coded.filter("third").groupBy(F.col("mark").alias("source")).agg(F.min("repo").alias("first_repo"), F.max("repo").alias("last_repo"))
    total = coded.agg(F.count_distinct("mark").alias("classes"))  # one row
    weight = F.pow(F.log(1 + F.col("classes") / F.col("n")) / F.log(1 + F.col("classes")), 2)
    source = F.when(F.col("lo.first_repo") != F.col("repo"), F.col("lo.source")).when(F.col("hi.last_repo") != F.col("repo"), F.col("hi.source"))
    key = ["repo", "mark", "layout"]

    def asked(coded):
        open_ = coded.filter("NOT third AND (reason IS NULL OR reason = 'copy')").select("repo", "mark", F.array_sort("phrases").alias("phrases")).distinct()
        return open_.select("repo", "mark", F.xxhash64("repo", "mark", "phrases").alias("layout"), F.explode("phrases").alias("x"))

    def holders(held):
        return held.distinct().join(sources, F.col("mark") == F.col("source")).select(F.col("x").alias("k"), "source", "first_repo", "last_repo")

    def weighed(rows, held):
        third = holders(held).groupBy(F.col("k").alias("h")).agg(F.min(F.struct("first_repo", "source")).alias("lo"), F.max(F.struct("last_repo", "source")).alias("hi"), F.count(F.lit(1)).alias("held_by"))
        spread = held.distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n")).join(third, F.col("x") == F.col("h"), "left").select(F.col("x").alias("k"), "n", "lo", "hi", "held_by")
        return salted_join(rows, spread, "x", "k", spread_by="layout", how="inner").join(F.broadcast(total)).withColumns({"w": weight, "source": source})

    held = coded.select("mark", F.explode("phrases").alias("x"))
    by = weighed(asked(coded), held).groupBy(*key, "source").agg(F.sum("w").alias("w"))
    sums = by.groupBy(*key).agg(F.sum("w").alias("whole"), F.sum(F.when(F.col("source").isNotNull(), F.col("w"))).alias("shared"), F.max(F.when(F.col("source").isNotNull(), F.col("w"))).alias("top"))
    sums = sums.withColumn("least", F.greatest(one_source * F.col("whole"), F.lit(amount)))
    enough = cut(sums.filter((F.col("shared") >= share * F.col("whole")) & (F.col("shared") >= F.col("least") * _ROUNDING)).select(*key, "least", (F.col("top") >= F.col("least")).alias("sure")))
    sure, unsure = enough.filter("sure").select("repo", "mark"), enough.filter("NOT sure").drop("sure")
    if unsure.isEmpty():
        return sure.distinct()
    rows = cut(asked(coded.join(_sent(unsure.select("repo", "mark").distinct()), ["repo", "mark"], "left_semi")).join(_sent(unsure), key))
    held = held.join(_sent(rows.select("x").distinct()), "x", "left_semi").select("mark", "x")
    rows = cut(weighed(rows, held).filter("source IS NOT NULL").select(*key, "least", "x", "w", "held_by"))
    return sure.unionByName(_under_one_source(rows, holders(held), key)).distinct()


def _sent(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows, to be sent to all tasks if there are few; with more of them the join is the same, by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _under_one_source(rows: DataFrame, holders: DataFrame, key: list[str]) -> DataFrame:
    """`repo, mark` of those whose phrases under one holder of another repository weigh `least`.

    rows has the key, `least` and a phrase `x, w, held_by` each. The phrases of a key are ordered from the one with most
    holders. A holder that has enough has one whose weight and that of all before come to `least`, so only these are met
    with all holders, and the rest with the holders that could do with all of it.
    """
    before = Window.partitionBy(*key).orderBy(F.desc("held_by"), "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("up_to", F.sum("w").over(before)).withColumn("rare", F.col("up_to") >= F.col("least") * _ROUNDING)
    rows = rows.withColumn("common", F.coalesce(F.max(F.when(~F.col("rare"), F.col("up_to"))).over(Window.partitionBy(*key)), F.lit(0.0)))
    pairs = salted_join(rows.filter("rare"), holders, "x", "k", spread_by="layout", how="inner").filter("first_repo != repo OR last_repo != repo")
    pairs = pairs.groupBy(*key, "source", "least", "common").agg(F.sum("w").alias("got")).filter(F.col("got") + F.col("common") >= F.col("least") * _ROUNDING)
    rest = pairs.join(rows.filter("NOT rare").select(*key, "x", "w"), key, "left")
    held = holders.select("k", F.col("source").alias("holder"))
    met = rest.join(held, (F.col("x") == F.col("k")) & (F.col("source") == F.col("holder")), "left")
    tops = met.groupBy(*key, "source", "least", "got").agg(F.sum(F.when(F.col("holder").isNotNull(), F.col("w"))).alias("more"))
    return tops.filter(F.col("got") + F.coalesce("more", F.lit(0.0)) >= F.col("least")).select("repo", "mark").distinct()


def not_handwritten(files: DataFrame) -> DataFrame:
    """`file_id, reason, evidence`: generated, minified, lock, third-party, copy or data, and what shows it.

    evidence is grammar, literals, rules (shared with third-party files), tokens (the whole sequence is), lines, entries,
    head, name or folder.
    """
    folder = F.substring_index(F.translate("path", "\\", "/"), "/", 1)
    repo = F.coalesce("repo", folder) if "repo" in files.columns else folder
    rows = files.select("file_id", repo.alias("repo"), "path", "content").filter("file_id IS NOT NULL AND path IS NOT NULL")

    def run(batches):
        for pdf in batches:
            got = [profile(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({
                "file_id": pdf["file_id"], "repo": pdf["repo"], "reason": pd.Series([g[0] and g[0][0] for g in got], dtype="object"), "evidence": pd.Series([g[0] and g[0][1] for g in got], dtype="object"),
                "mark": pd.array([g[1] for g in got], dtype="Int64"), "third": [g[2] for g in got], "phrases": [list(g[3]) for g in got],
            })

    judged = cut(rows.mapInPandas(run, "file_id long, repo string, reason string, evidence string, mark long, third boolean, phrases array<long>"))
    marks = judged.filter("third AND mark IS NOT NULL").groupBy(F.col("mark").alias("third_mark")).agg(F.lit("tokens").alias("evidence"))
    open_ = judged.filter("reason IS NULL AND mark IS NOT NULL").select("file_id", "repo", "mark")
    whole = salted_join(open_, marks, "mark", "third_mark", spread_by="file_id", how="inner").select("file_id", "evidence")
    near = edited_copies(judged).withColumn("class", F.xxhash64("repo", "mark")).select("class", F.lit("rules").alias("evidence"))
    edited = salted_join(open_.withColumn("of", F.xxhash64("repo", "mark")), near, "of", "class", spread_by="file_id", how="inner").select("file_id", "evidence")
    copies = whole.unionByName(edited).groupBy("file_id").agg(F.min("evidence").alias("evidence")).select("file_id", F.lit("copy").alias("reason"), "evidence")
    return judged.filter("reason IS NOT NULL").select("file_id", "reason", "evidence").unionByName(copies).dropDuplicates(["file_id"])
