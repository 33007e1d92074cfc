"""Structural nodes of JSON, YAML, TOML, CSV and Markdown texts.

Each parser takes a text and gives nodes (kind, label, path, byte_start, byte_end, parent, depth), parent
being an index into the list or -1. `structural_nodes` runs them over a table of files in Arrow batches,
without a shuffle. Texts that are not valid in their language give no nodes (JSON, TOML) or those that can be made out.
"""

from __future__ import annotations

import bisect
import csv
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "id long, file_id long, kind string, label string, path_joined string, path array<string>, byte_start long, byte_end long, line_start int, line_end int, parent_id long, depth int"
MAX_ON_DEMAND = 10 * 1024 * 1024
Node = tuple[str, str, tuple[str, ...], int, int, int, int]


class _Bytes:
    """Byte offsets of character positions."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        if not self.ascii:
            self.sums = [0]
            for c in text:
                self.sums.append(self.sums[-1] + len(c.encode("utf-8", "surrogatepass")))

    def at(self, pos: int) -> int:
        return pos if self.ascii else self.sums[pos]


# --- JSON ---------------------------------------------------------------------------------------

_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_JSON_SKIP = re.compile(r"[ \t\r\n]*")
_JSON_SCALAR = re.compile(r"[^\s,\]}]+")


def parse_json(text: str) -> list[Node]:
    """A node per object member and array element; members in the order of their keys."""
    try:
        json.loads(text)
    except ValueError:
        return []
    offsets, nodes = _Bytes(text), []

    def value(at: int) -> tuple[int, list]:
        """(end, children as (sort key, label, start, end, children)) of the value at `at`."""
        c = text[at]
        if c == '"':
            return _JSON_STRING.match(text, at).end(), []
        if c not in "{[":
            return _JSON_SCALAR.match(text, at).end(), []
        at, kids, i = _JSON_SKIP.match(text, at + 1).end(), [], 0
        while text[at] not in "}]":
            start = at
            label = f"[{i}]"
            if c == "{":
                m = _JSON_STRING.match(text, at)
                label = json.loads(m.group())
                at = _JSON_SKIP.match(text, m.end()).end() + 1
                at = _JSON_SKIP.match(text, at).end()
            end, below = value(at)
            kids.append((label if c == "{" else i, label, start, end, below))
            at = _JSON_SKIP.match(text, end).end()
            if text[at] == ",":
                at = _JSON_SKIP.match(text, at + 1).end()
            i += 1
        return at + 1, kids

    def emit(kids: list, path: tuple, parent: int, depth: int) -> None:
        for _, label, start, end, below in sorted(kids, key=lambda k: k[0]):
            nodes.append(("JsonKey", label, (*path, label), offsets.at(start), offsets.at(end), parent, depth))
            emit(below, (*path, label), len(nodes) - 1, depth + 1)

    try:
        emit(value(_JSON_SKIP.match(text).end())[1], (), -1, 0)
    except RecursionError:
        return []
    return nodes


# --- YAML, TOML, CSV, Markdown: line by line ----------------------------------------------------


def _lines(text: str) -> list[tuple[str, int, int]]:
    """(line without its end, byte start, byte end with it)."""
    out, at = [], 0
    for line in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text and "\x85" not in text and " " not in text else re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        size = len(line.encode("utf-8", "surrogatepass"))
        out.append((line.rstrip("\r\n"), at, at + size))
        at += size
    return out


_YAML_KEY = re.compile(r"""( *)(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#\-?\[\]{},&*!|>'"%@`:][^#]*?|-[^\s#][^#]*?))[ \t]*:(?=[ \t]|$)""")


def parse_yaml(text: str) -> list[Node]:
    """A node per key of a mapping; sequences are not entered. A node ends where a line is not indented deeper."""
    lines, nodes = _lines(text), []
    open_: list[tuple[int, int]] = []  # (indent, node)
    skip_deeper = None  # indent of a block scalar's key or of a sequence

    def close(indent: int, at: int) -> None:
        while open_ and open_[-1][0] >= indent:
            i = open_.pop()[1]
            nodes[i] = (*nodes[i][:4], at, *nodes[i][5:])

    for line, start, _ in lines:
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        if skip_deeper is not None:
            if indent > skip_deeper:
                continue
            skip_deeper = None
        if body in ("---", "...") or body.startswith("%") or (indent == 0 and body.startswith("--- ")):
            close(0, start)
            continue
        if body == "-" or body.startswith("- "):
            close(indent + 1, start)
            skip_deeper = indent
            continue
        m = _YAML_KEY.match(line)
        if not m:
            continue
        close(indent, start)
        label = next(g for g in m.groups()[1:] if g is not None)
        parent = open_[-1][1] if open_ else -1
        path = (*nodes[parent][2], label) if parent >= 0 else (label,)
        nodes.append(("YamlKey", label, path, start, start, parent, len(path) - 1))
        open_.append((indent, len(nodes) - 1))
        if re.match(r"[|>][+\-\d]*\s*(#.*)?$", line[m.end() :].strip()):
            skip_deeper = indent
    close(0, lines[-1][2] if lines else 0)
    return nodes


_TOML_TABLE = re.compile(r"\s*\[\[?\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?$")
_TOML_PAIR = re.compile(r"""\s*((?:"(?:[^"\\]|\\.)*"|'[^']*'|[A-Za-z0-9_.\- ]+?))\s*=""")


def parse_toml(text: str) -> list[Node]:
    """A node per table and per key; a table ends after its last line that is not blank, a key at its line's end."""
    try:
        tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return []
    nodes, table, lines, used = [], -1, _lines(text), 0
    for line, start, end in lines:
        m = _TOML_TABLE.match(line)
        if m:
            if table >= 0:
                nodes[table] = (*nodes[table][:4], used, *nodes[table][5:])
            used = end
            label = m.group(1).strip()
            nodes.append(("TomlKey", label, (label,), start, end, -1, 0))
            table = len(nodes) - 1
            continue
        used = end if line.strip() else used
        m = _TOML_PAIR.match(line)
        if m:
            label = m.group(1).strip().strip("\"'")
            path = (*nodes[table][2], label) if table >= 0 else (label,)
            lead = len(line) - len(line.lstrip())
            nodes.append(("TomlKey", label, path, start + lead, start + len(line.encode()), table, len(path) - 1))
    if table >= 0:
        nodes[table] = (*nodes[table][:4], used, *nodes[table][5:])
    return nodes


def parse_csv(text: str) -> list[Node]:
    """The header and each row; labels are the first three fields, rows are counted from 1."""
    nodes = []
    records: list[tuple[str, int, int]] = []
    for line, start, end in _lines(text):
        if records and records[-1][0].count('"') % 2:
            head = records.pop()
            records.append((head[0] + "\n" + line, head[1], end))
        elif line:
            records.append((line, start, end))
    for i, (line, start, end) in enumerate(records):
        fields = next(csv.reader([line.replace("\n", " ")]), [])
        path = "header" if i == 0 else f"row_{i}"
        nodes.append(("CsvRow" if i else "CsvHeader", ", ".join(fields[:3]), (path,), start, end, -1, 0))
    return nodes


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")


def parse_markdown(text: str) -> list[Node]:
    """Sections, which end at the next heading of the same or a higher level, and code blocks."""
    lines, nodes = _lines(text), []
    open_: list[tuple[int, int]] = []
    fence = None  # (mark, node)
    before = ""
    end = lines[-1][2] if lines else 0

    def section(level: int, title: str, at: int) -> None:
        while open_ and open_[-1][0] >= level:
            i = open_.pop()[1]
            nodes[i] = (*nodes[i][:4], at, *nodes[i][5:])
        nodes.append(("MdSection", title, (title,), at, end, open_[-1][1] if open_ else -1, level))
        open_.append((level, len(nodes) - 1))

    def code(label: str, a: int, b: int) -> None:
        above = open_[-1][1] if open_ else -1
        nodes.append(("MdCodeBlock", label, (*(nodes[above][2] if open_ else ()), label), a, b, above, 7))

    for k, (line, start, stop) in enumerate(lines):
        if fence:
            if re.match(rf" {{0,3}}{fence[0][0]}{{{len(fence[0])},}}[ \t]*$", line):
                nodes[fence[1]] = (*nodes[fence[1]][:4], stop, *nodes[fence[1]][5:])
                fence = None
            before = ""
            continue
        m = _FENCE.match(line)
        if m:
            code(m.group(2) or "code", start, end)
            fence = (m.group(1), len(nodes) - 1)
            before = ""
            continue
        m = _ATX.match(line)
        if m:
            section(len(m.group(1)), (m.group(2) or "").strip(), start)
        elif before.strip() and re.match(r" {0,3}(=+|-+)[ \t]*$", line) and not before.lstrip().startswith(("-", "*", ">", "|")):
            section(1 if "=" in line else 2, before.strip(), lines[k - 1][1])
        elif line.startswith("    ") and line.strip() and not before.strip() and (not nodes or nodes[-1][4] != start):
            code("code", start, stop)
            continue
        elif line.startswith("    ") and nodes and nodes[-1][0] == "MdCodeBlock" and nodes[-1][4] == start and line.strip():
            nodes[-1] = (*nodes[-1][:4], stop, *nodes[-1][5:])
            continue
        before = "" if m else line
    return nodes


PARSERS = {"json": parse_json, "yaml": parse_yaml, "toml": parse_toml, "csv": parse_csv, "markdown": parse_markdown}


def markdown_headings(text: str) -> list[tuple[int, int, str, int | None]]:
    """(line, level, title, line of the next heading of the same or a higher level) of the sections."""
    starts = [start for _, start, _ in _lines(text)]
    out: list[tuple[int, int, str, int | None]] = []
    open_: list[int] = []
    for kind, title, _, start, _, _, level in parse_markdown(text):
        if kind != "MdSection":
            continue
        line = bisect.bisect_right(starts, start)
        while open_ and out[open_[-1]][1] >= level:
            i = open_.pop()
            out[i] = (*out[i][:3], line)
        open_.append(len(out))
        out.append((line, level, title, None))
    return out


def node_id(path: str, kind: str, node_path: tuple, start: int) -> int:
    """A positive id from file, kind, path and place, so equal headings of one file differ."""
    import xxhash

    return xxhash.xxh64_intdigest("\0".join((path, kind, *node_path, str(start)))) >> 1


def nodes_of(language: str, text: str, file_id: int, path: str) -> list[tuple]:
    """The rows of NODE_SCHEMA of one file."""
    found = PARSERS[language](text) if language in PARSERS else []
    raw = text.encode("utf-8", "surrogatepass")
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]
    ids = [node_id(path, n[0], n[2], n[3]) for n in found]
    line = lambda at: bisect.bisect_right(starts, at)
    return [
        (ids[i], file_id, kind, label, "/".join(p), list(p), a, b, line(a), max(line(a), line(max(a, b - 1))), ids[parent] if parent >= 0 else None, depth)
        for i, (kind, label, p, a, b, parent, depth) in enumerate(found)
    ]


def structural_nodes(files: DataFrame, max_bytes: int = MAX_ON_DEMAND) -> DataFrame:
    """The nodes of all files (file_id, path, language, content) whose language has a parser."""
    rows = files.select("file_id", "path", "language", "content").filter(F.col("content").isNotNull() & F.col("language").isin(*PARSERS) & (F.octet_length("content") <= max_bytes))

    def run(batches):
        cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for pdf in batches:
            out = [r for f, p, l, c in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["content"]) for r in nodes_of(l, c, f, p)]
            table = dict(zip(cols, zip(*out))) if out else {c: [] for c in cols}
            table["parent_id"] = pd.array(list(table["parent_id"]), dtype="Int64")  # by way of floats large ids would change
            yield pd.DataFrame(table)

    return rows.mapInPandas(run, NODE_SCHEMA)
