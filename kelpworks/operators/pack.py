"""Packing files of a repository into one text under a token budget."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, is_doc_file, is_test_file

#: Base names that come first, and documents that come next if they lie at the top.
ENTRY_NAMES = ("main.rs", "lib.rs", "index.ts", "index.tsx", "__main__.py", "main.py")
TOP_DOCS = ("README.md", "README.rst", "CONTRIBUTING.md", "ARCHITECTURE.md", "LICENSE")
#: The fence of each extension in Markdown.
FENCES = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "pyi": "python", "pyx": "python", "md": "markdown", "mdx": "markdown",
    "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "sql": "sql", "sh": "bash",
    "bash": "bash", "zsh": "bash", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "go": "go", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "swift": "swift", "rb": "ruby", "php": "php", "cs": "csharp", "fs": "fsharp", "fsx": "fsharp", "scala": "scala", "sc": "scala", "xml": "xml", "svg": "xml",
    "r": "r", "lua": "lua", "zig": "zig", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell", "ml": "ocaml", "mli": "ocaml",
    "dockerfile": "dockerfile", "makefile": "makefile", "mk": "makefile", "cmake": "cmake", "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "vue": "vue",
    "svelte": "svelte", "tf": "terraform", "tfvars": "terraform",
}
OVERHEAD = {"xml": 120, "markdown": 80}
RECENT_DAYS = 7
MARKER = "... [truncated]"


class EmptyScope(ValueError):
    """No file is left to pack."""


class BudgetTooSmall(ValueError):
    """The budget does not even pay for the files' frames."""


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def priority(path: Column, modified: Column, now: Column) -> Column:
    """1 entry points, 2 top documents, 3 changed within seven days, 4 the rest."""
    fresh = (modified <= now) & (modified >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
    top = ~path.contains("/") & path.isin(*TOP_DOCS)
    return F.when(basename(path).isin(*ENTRY_NAMES), 1).when(top, 2).when(fresh, 3).otherwise(4)


def prioritized(files: DataFrame, in_edges: DataFrame | None, now) -> DataFrame:
    """`files` with `rank` and `in_edges`; order by rank, then within 4 by in-edges (most first), then by path."""
    joined = files.withColumn("in_edges", F.lit(0).cast("long")) if in_edges is None else files.join(in_edges.select(F.col("file").alias("_e"), "in_edges"), F.col("path") == F.col("_e"), "left").drop("_e").fillna(0, ["in_edges"])
    return joined.withColumn("rank", priority(F.col("path"), F.col("modified"), F.lit(now)))


def pack_order() -> list[Column]:
    return [F.col("rank"), F.when(F.col("rank") == 4, -F.col("in_edges")).otherwise(0), F.col("path")]


def in_edge_counts(edges: DataFrame) -> DataFrame:
    """`file, in_edges`: edges that come from another file."""
    return edges.filter("to_file <> '' AND from_file <> to_file").groupBy(F.col("to_file").alias("file")).agg(F.count(F.lit(1)).alias("in_edges"))


def truncate_to(text: str, budget: int, tokens=None) -> tuple[str, int]:
    """Whole lines while their tokens (each with one for its end) and the marker's fit; then the marker."""
    count = tokens or (lambda t: -(-len(t.encode()) // 4))
    room = budget - count(MARKER)
    kept, used = [], 0
    for line in text.split("\n"):
        cost = count(line) + 1
        if used + cost > room:
            break
        kept.append(line)
        used += cost
    out = "\n".join([*kept, MARKER])
    return out, count(out)


def fit_budget(ordered: list[tuple[str, str]], budget: int, overhead: int, tokens=None) -> list[tuple[str, str, bool, int]]:
    """(path, text, truncated, tokens) in order: each file gets an equal share of what the ones before left.

    A sequential fold, so it runs in one place; the caller hands it no more files than the frames allow.
    """
    count = tokens or (lambda t: -(-len(t.encode()) // 4))
    n = len(ordered)
    if overhead * n >= budget:
        raise BudgetTooSmall(f"{n} files need more than {overhead * n} tokens")
    left, out = budget - overhead * n, []
    for i, (path, text) in enumerate(ordered):
        share = left // (n - i)
        cost = count(text)
        if cost <= share:
            out.append((path, text, False, cost))
        else:
            text, cost = truncate_to(text, share, tokens)
            if cost > share:
                continue
            out.append((path, text, True, cost))
        left -= cost
    return out


def budgeted(files: DataFrame, order: list[Column], budget: int, style: str = "xml") -> DataFrame:
    """`pos, path, content, truncated, tokens` of the files that fit.

    At most budget / overhead files can be framed at all, so only so many are brought together, by a top-k.
    """
    most = max(1, (budget - 1) // OVERHEAD[style])
    first = files.filter("content IS NOT NULL").orderBy(*order).limit(most)
    keyed = first.withColumn("pos", F.row_number().over(_one_window(order)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        got = fit_budget(list(zip(pdf["path"], pdf["content"])), budget, OVERHEAD[style])
        return pd.DataFrame([(i + 1, *g) for i, g in enumerate(got)], columns=["pos", "path", "content", "truncated", "tokens"])

    return keyed.select(F.lit(0).alias("one"), "pos", "path", "content").groupBy("one").applyInPandas(run, "pos int, path string, content string, truncated boolean, tokens long")


def _one_window(order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)


def xml_attribute(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def xml_element(path: Column, content: Column, truncated: Column, tokens: Column) -> Column:
    safe = F.replace(content, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit('  <file path="'), xml_attribute(path), F.lit('" tokens="'), tokens.cast("string"), F.lit('" truncated="'), truncated.cast("string"), F.lit('">\n<![CDATA['), safe, F.lit("]]>\n  </file>\n"))


def fence_of(path: Column) -> Column:
    from ..functions.paths import extension

    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FENCES.items() for x in kv)), extension(path)), F.lit(""))


def markdown_section(path: Column, content: Column, truncated: Column, tokens: Column) -> Column:
    return F.concat(F.lit("## File: "), path, F.lit(" (tokens: "), tokens.cast("string"), F.lit(", truncated: "), truncated.cast("string"), F.lit(")\n\n```"), fence_of(path), F.lit("\n"), content, F.lit("\n```\n\n"))


def render(packed: DataFrame, name: str, style: str = "xml") -> DataFrame:
    """`text`: the whole pack. Its size is bounded by the budget."""
    make = xml_element if style == "xml" else markdown_section
    part = make(F.col("path"), F.col("content"), F.col("truncated"), F.col("tokens"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "")
    if style == "xml":
        head, tail = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<repository name="'), xml_attribute(F.lit(name)), F.lit('">\n')), F.lit("</repository>\n")
    else:
        head, tail = F.lit(f"# Repository: {name}\n\n"), F.lit("")
    return packed.agg(F.concat(head, body, tail).alias("text"))


@dataclass
class PackResult:
    text: str
    included: list[str] = field(default_factory=list)
    truncated: list[str] = field(default_factory=list)
    omitted: int = 0


def scope_files(files: DataFrame, edges: DataFrame | None = None, symbols: DataFrame | None = None, paths: list[str] | None = None, symbol: str | None = None) -> DataFrame:
    """All files, those of the paths, or those of a symbol's definition, callees and referrers."""
    if paths is not None:
        return files.filter(F.col("path").isin(*paths))
    if symbol is not None:
        own = symbols.filter(F.col("name") == symbol).select("file")
        called = edges.filter((F.col("kind") == "Calls") & (F.col("from_name") == symbol)).select(F.col("to_file").alias("file"))
        users = edges.filter((F.col("kind") == "References") & (F.col("to_name") == symbol)).select(F.col("from_file").alias("file"))
        return files.join(own.unionByName(called).unionByName(users).distinct(), F.col("path") == F.col("file"), "left_semi")
    return files


def pack(files: DataFrame, now, budget: int = 100_000, style: str = "xml", name: str = "repository", in_edges: DataFrame | None = None, include_tests: bool = False, include_docs: bool = False) -> PackResult:
    """Scope is what is given; tests and documents are left out unless asked for; budget is clamped to 1,000 … 10,000,000."""
    budget = max(1_000, min(10_000_000, budget))
    keep = files
    if not include_tests:
        keep = keep.filter(~is_test_file(F.col("path")))
    if not include_docs:
        keep = keep.filter(~is_doc_file(F.col("path")))
    total = keep.count()
    if total == 0:
        raise EmptyScope("no file is left to pack")
    packed = budgeted(prioritized(keep, in_edges, now), pack_order(), budget, style).cache()
    rows = packed.select("path", "truncated").collect()  # bounded by the budget
    text = render(packed, name, style).first()["text"]
    packed.unpersist()
    return PackResult(text, [r["path"] for r in rows], [r["path"] for r in rows if r["truncated"]], total - len(rows))
