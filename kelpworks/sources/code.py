"""Chunks, symbols and imports of source texts.

Python is read with its own `ast`; Rust and TypeScript by a scanner that blanks out strings and comments
and follows braces. Everything else becomes chunks only. Ranges are half-open and count bytes.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .structural import _Bytes

MAX_CHUNK = 4096
CHUNK_SCHEMA = "chunk_id string, file string, range_start long, range_end long, text string, kind string, language string"
SYMBOL_SCHEMA = "symbol_id string, name string, kind string, file string, range_start long, range_end long, signature string, parent_id string"
IMPORT_SCHEMA = "file string, language string, raw string, range_start long, range_end long"
Symbol = tuple[str, str, int, int, int]  # name, kind, start, end, start of the body


def chunk_id(text: str) -> str:
    """The hash of the text with its white space collapsed."""
    return hashlib.sha256(" ".join(text.split()).encode("utf-8", "surrogatepass")).hexdigest()


def char_split(data: bytes, most: int = MAX_CHUNK) -> list[tuple[int, int]]:
    """Ranges of at most `most` bytes that tile the data.

    A window that is not the last ends after its last line end past its middle, else after its last blank
    past its middle, else at a character boundary.
    """
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            while end > at + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
            middle = at + (end - at) // 2 + 1
            for mark in (b"\n", b" "):
                found = data.rfind(mark, middle, end)
                if found >= 0:
                    end = found + 1
                    break
        out.append((at, end))
        at = end
    return out


# --- symbols ------------------------------------------------------------------------------------


def _python_symbols(text: str) -> tuple[list[Symbol], list[tuple[int, int]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    at = lambda line, col: starts[line - 1] + col
    symbols, imports = [], []

    def visit(node, nested: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if nested else "function"
                a, b = at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)
                body = at(child.body[0].lineno, child.body[0].col_offset)
                symbols.append((child.name, kind, a, b, body))
                visit(child, True)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                imports.append((at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)))
            elif isinstance(child, ast.stmt):
                visit(child, nested or isinstance(child, (ast.If, ast.Try, ast.With, ast.For, ast.While)))

    visit(tree, False)
    return symbols, imports


_BLANK = {
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]+?)'", re.S),
    "typescript": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
}
_NAME = r"([A-Za-z_$][\w$]*)"
_HEADS = {
    "rust": re.compile(
        rf"(?:^|(?<=[{{}};]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const(?=\s+(?:async|unsafe|extern|fn)\b)|extern(?:\s*\"[^\"]*\")?)\s+)*(fn|struct|enum|trait|mod|const|static|type)\s+(?:mut\s+)?{_NAME}|(?:^|(?<=[{{}};]))[ \t]*(?:unsafe\s+)?(impl)\b[^{{;]*|^[ \t]*(macro_rules)!\s*{_NAME}", re.M
    ),
    "typescript": re.compile(
        rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?:async\s+)?(function)\s*\*?|(class|interface|enum|type)|const\s+(enum))\s+{_NAME}|^[ \t]*(?:export\s+)?(const|let|var)\s+{_NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=function\b|\(|[\w$]+\s*=>)|^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*{_NAME}\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;\n]+)?(?=\{{)",
        re.M,
    ),
}
#: What the words at the head of a declaration stand for.
_KINDS = {
    "fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "constant", "static": "static", "type": "type",
    "impl": "impl", "macro_rules": "macro", "function": "function", "class": "class", "interface": "interface", "let": "variable", "var": "variable",
}
_NOT_METHODS = frozenset("if for while switch catch return function with constructor_ super".split())
_IMPORTS = {"rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;", re.M), "typescript": re.compile(r"^[ \t]*(?:import|export)\b[^;\n]*?(?:\{[^}]*\})?[^;\n]*?from\s*['\"][^'\"\n]+['\"];?|^[ \t]*import\s+['\"][^'\"\n]+['\"];?", re.M)}


def _scan_symbols(text: str, language: str) -> tuple[list[Symbol], list[tuple[int, int]]]:
    plain = _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    offsets, symbols = _Bytes(text), []

    def end_of(at: int) -> tuple[int, int]:
        """(end, start of the body) of a declaration whose head ends at `at`."""
        depth, p, body = 0, at, -1
        while p < len(plain):
            c = plain[p]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{":
                if body < 0 and depth == 0:
                    body = p
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0 and body >= 0:
                    return p + 1, body
                if depth < 0:
                    return p, p
            elif c == ";" and depth == 0:
                return p + 1, p + 1 if body < 0 else body
            p += 1
        return len(plain), len(plain) if body < 0 else body

    for m in _HEADS[language].finditer(plain):
        g = [x for x in m.groups() if x]
        lead = len(m.group()) - len(m.group().lstrip())
        start = m.start() + lead
        if language == "rust":
            word = g[0]
            if word == "impl":
                target = re.search(r"(?:\bfor\s+)?([A-Za-z_]\w*)(?:<[^{]*>)?\s*(?:where\b.*)?$", m.group().strip(), re.S)
                name = target.group(1) if target else "impl"
            else:
                name = g[1]
            kind = _KINDS[word]
        elif len(g) == 1:
            name, kind = g[0], "method"
            if name in _NOT_METHODS:
                continue
        else:
            name, kind = g[1], "variable" if g[0] == "const" else _KINDS[g[0]]
        end, body = end_of(m.end())
        symbols.append((name, kind, offsets.at(start), offsets.at(end), offsets.at(body)))
    imports = [(offsets.at(m.start() + len(m.group()) - len(m.group().lstrip())), offsets.at(m.end())) for m in _IMPORTS[language].finditer(text)]
    return symbols, imports


def extract(language: str, text: str) -> tuple[list[Symbol], list[tuple[int, int]]]:
    """(symbols, import ranges); neither for a language without an extractor."""
    if language == "python":
        return _python_symbols(text)
    return _scan_symbols(text, language) if language in _HEADS else ([], [])


Found = tuple[list[Symbol], list[tuple[int, int]]]


def symbol_rows(file: str, language: str, text: str, found: Found | None = None) -> list[tuple]:
    """The rows of SYMBOL_SCHEMA; the parent is the smallest other symbol that encloses one."""
    raw = text.encode("utf-8", "surrogatepass")
    ordered = sorted(set((found or extract(language, text))[0]), key=lambda s: (s[2], -s[3]))
    out, open_ = [], []
    for name, kind, a, b, body in ordered:
        while open_ and open_[-1][1] < b:
            open_.pop()
        sid = f"{file}::{name}::{a}"
        signature = raw[a:body].decode("utf-8", "replace").strip() or None
        out.append((sid, name, kind, file, a, b, signature, open_[-1][0] if open_ else None))
        open_.append((sid, b))
    return out


def chunk_rows(file: str, language: str, text: str, most: int = MAX_CHUNK, found: Found | None = None) -> list[tuple]:
    """The rows of CHUNK_SCHEMA: outermost symbols whole if they fit, the rest split; blank gaps give none."""
    raw = text.encode("utf-8", "surrogatepass")
    parts: list[tuple[int, int, str]] = []

    def split(a: int, b: int) -> None:
        parts.extend((a + s, a + e, "fallback") for s, e in char_split(raw[a:b], most))

    at = 0
    for name, kind, a, b, _ in sorted((found or extract(language, text))[0], key=lambda s: (s[2], -s[3])):
        if a < at:
            continue
        if raw[at:a].strip():
            split(at, a)
        if b - a <= most:
            parts.append((a, b, "function" if kind in ("function", "method") else "type"))
        else:
            split(a, b)
        at = b
    if raw[at:].strip():
        split(at, len(raw))
    return [(chunk_id(t := raw[a:b].decode("utf-8", "replace")), file, a, b, t, kind, language or "markdown") for a, b, kind in parts]


def import_rows(file: str, language: str, text: str, found: Found | None = None) -> list[tuple]:
    raw = text.encode("utf-8", "surrogatepass")
    return [(file, language, raw[a:b].decode("utf-8", "replace"), a, b) for a, b in (found or extract(language, text))[1]]


def _table(files: DataFrame, rows, schema: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    use = files.select("path", "language", "content").filter("content IS NOT NULL AND path IS NOT NULL")
    if languages:
        use = use.filter(F.col("language").isin(*languages))
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, l, c in zip(pdf["path"], pdf["language"], pdf["content"]) for r in rows(p, l, c)], columns=cols)

    return use.mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _table(files, symbol_rows, SYMBOL_SCHEMA, ("python", "rust", "typescript"))


def chunks(files: DataFrame, most: int = MAX_CHUNK) -> DataFrame:
    return _table(files, lambda p, l, c: chunk_rows(p, l, c, most), CHUNK_SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    return _table(files, import_rows, IMPORT_SCHEMA, ("python", "rust", "typescript"))


# --- everything by one reading ------------------------------------------------------------------

PARSED = "what string, id string, name string, kind string, file string, range_start long, range_end long, text string, parent_id string, language string"


def parsed_rows(file: str, language: str, text: str, most: int = MAX_CHUNK) -> list[tuple]:
    """The rows of PARSED of one file: its symbols, chunks and imports, for which it is read once."""
    found = extract(language, text)
    out = []
    if language in ("python", "rust", "typescript"):
        out += [("symbol", i, name, kind, f, a, b, signature, parent, language) for i, name, kind, f, a, b, signature, parent in symbol_rows(file, language, text, found)]
        out += [("import", None, None, None, f, a, b, raw, None, lang) for f, lang, raw, a, b in import_rows(file, language, text, found)]
    return out + [("chunk", i, None, kind, f, a, b, t, None, lang) for i, f, a, b, t, kind, lang in chunk_rows(file, language, text, most, found)]


def parse(files: DataFrame, most: int = MAX_CHUNK) -> DataFrame:
    """PARSED of all files; the tables are `parts_of` it."""
    return _table(files, lambda p, l, c: parsed_rows(p, l, c, most), PARSED)


def parts_of(parsed: DataFrame) -> dict[str, DataFrame]:
    """`symbols, chunks, imports` as the functions of these names give them."""
    of = lambda what: parsed.filter(F.col("what") == what)
    return {
        "symbols": of("symbol").select(F.col("id").alias("symbol_id"), "name", "kind", "file", "range_start", "range_end", F.col("text").alias("signature"), "parent_id"),
        "chunks": of("chunk").select(F.col("id").alias("chunk_id"), "file", "range_start", "range_end", "text", "kind", "language"),
        "imports": of("import").select("file", "language", F.col("text").alias("raw"), "range_start", "range_end"),
    }
