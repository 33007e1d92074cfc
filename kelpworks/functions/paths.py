"""Column expressions over paths: separators, parts, globs, languages and kinds of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each extension; the match is case-sensitive.
LANGUAGE_OF_EXTENSION = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv",
}
#: How names and folders of test files look.
TEST_NAME_ENDS = ("_test.rs", "_test.ts", "_test.tsx", "_test.js", "_test.jsx", "_test.py", "_spec.ts", "_spec.js", "test.py")
TEST_FOLDERS = ("/test/", "/tests/", "/__tests__/", "/spec/")
TEST_STARTS = ("test/", "tests/")


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The part before the last slash; empty where there is none."""
    return F.regexp_replace(path, r"(^[^/]*$)|(/[^/]*$)", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the base name; empty for none and for names that begin with their only dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_OF_EXTENSION.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))


def is_test_file(path: Column) -> Column:
    ends = "|".join(map(re.escape, TEST_NAME_ENDS))
    folders = "|".join(map(re.escape, TEST_FOLDERS))
    starts = "|".join(map(re.escape, TEST_STARTS))
    return path.rlike(f"({ends})$|{folders}|^({starts})")


def is_doc_file(path: Column) -> Column:
    return extension(path) == "md"


def sqlite_glob(pattern: str) -> str:
    """The regular expression of a GLOB in which * also crosses slashes; [...] is a set, [^...] its complement; an open [ matches nothing."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and close < 0:
            return "(?!)"
        if close > 0:
            out += "[" + pattern[i + 1 : close].replace("\\", "\\\\") + "]"
            i = close
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c))
        i += 1
    return out + "$"


def text_glob(pattern: str) -> str:
    """The regular expression of a search glob: ** crosses slashes, * and ? do not; a leading ! is ignored."""
    parts = re.split(r"(\*\*|\*|\?)", pattern.lstrip("!"))
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(p) or re.escape(p) for p in parts) + "$"


def literal_prefix(pattern: str) -> str:
    """What every match of a glob begins with; as a starts-with condition it reaches the parquet statistics."""
    return re.match(r"[^*?\[]*", pattern.lstrip("!")).group()


def glob_match(path: Column, pattern: str) -> Column:
    prefix = literal_prefix(pattern)
    match = path.rlike(text_glob(pattern))
    return path.startswith(prefix) & match if prefix else match


def path_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any include matches (no list: all pass) and no exclude does."""
    keep = F.lit(True) if include is None else reduce(lambda a, b: a | b, [glob_match(path, g) for g in include], F.lit(False))
    for g in exclude or []:
        keep = keep & ~glob_match(path, g)
    return keep


def normalize_path(path: Column) -> Column:
    """Slashes only, no empty or . parts, .. removes the part before it; a leading slash stays."""
    p = slashed(path)
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def safe_path(path: Column) -> Column:
    """Whether a path stays under its root: relative and without a .. part."""
    p = slashed(path)
    return ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..")


def same_module(a: Column, b: Column) -> Column:
    """Whether two files lie in the same folder, other than the root."""
    return (dirname(a) != "") & (dirname(a) == dirname(b))
