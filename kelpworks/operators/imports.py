"""Import statements as columns: module path, items, and the file they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import dirname, normalize_path


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def _parts(text: Column, by: str) -> Column:
    """The trimmed, non-empty parts of a text."""
    return F.filter(F.transform(F.split(text, by), lambda x: _trim(x)), lambda x: x != "")


def _before(text: Column, mark: str) -> Column:
    return _trim(F.substring_index(text, mark, 1))


def _no_items() -> Column:
    return F.array().cast("array<string>")


def rust_use(raw: Column) -> Column:
    """struct<module_path, items> of `use a::b::{c, d as e};` (no braces: no items; aliases keep the first name)."""
    body = F.regexp_replace(_trim(F.regexp_replace(raw, r"^\s*(pub(\([^)]*\))?\s+)?use\s+|;\s*$", "")), r"^(crate|self)::", "")
    brace = F.instr(body, "{")
    module = F.when(brace > 0, F.substring_index(body, "{", 1)).otherwise(body)
    inner = F.regexp_replace(F.substring(body, brace, F.length(body)), r"^\{|\}\s*$", "")
    items = F.transform(_parts(inner, ","), lambda x: F.when(x.contains(" as "), _before(x, " as ")).otherwise(_before(x, "::")))
    return F.struct(_parts(module, "::").alias("module_path"), F.when(brace > 0, items).otherwise(_no_items()).alias("items"))


def ts_import(raw: Column) -> Column:
    """struct<module_path, items> of `import {a as b} from './x'`, default imports, `export … from` and bare imports."""
    body = _trim(F.regexp_replace(raw, r";\s*$", ""))
    has_from = body.contains(" from ")
    quotes = r"^[\s'\"]+|[\s'\"]+$"
    module = F.regexp_replace(F.substring_index(body, " from ", -1), quotes, "")
    spec = _trim(F.regexp_replace(F.substring_index(body, " from ", 1), r"^(import|export)\s+(type\s+)?", ""))
    named = F.transform(_parts(F.regexp_replace(spec, r"^\{|\}$", ""), ","), lambda x: _before(F.regexp_replace(x, r"^type\s+", ""), " as "))
    items = F.when(spec.startswith("{"), named).when(spec != "", F.array(spec)).otherwise(_no_items())
    bare = F.filter(F.transform(F.split(F.regexp_replace(body, r"^import\s+", ""), ","), lambda x: F.regexp_replace(x, quotes, "")), lambda x: x != "")
    return F.struct(F.when(has_from, _parts(module, "/")).otherwise(bare).alias("module_path"), F.when(has_from, items).otherwise(_no_items()).alias("items"))


def py_import(raw: Column) -> Column:
    """struct<module_path, items> of `from .m import x as y` (items: x) and `import a as b` (items: b)."""
    body = _trim(raw)
    is_from = body.startswith("from ")
    rest = F.regexp_replace(body, r"^(from|import)\s+", "")
    names = F.regexp_replace(F.substring_index(rest, " import ", -1), r"[()]", "")
    from_path, from_items = _parts(F.substring_index(rest, " import ", 1), r"\."), F.transform(_parts(names, ","), lambda x: _before(x, " as "))
    plain = _parts(rest, ",")
    aliases = F.transform(F.filter(plain, lambda x: x.contains(" as ")), lambda x: _trim(F.substring_index(x, " as ", -1)))
    complete = body.contains(" import ")
    module = F.when(is_from & complete, from_path).when(is_from, _no_items()).otherwise(F.transform(plain, lambda x: _before(x, " as ")))
    items = F.when(is_from & complete, from_items).when(is_from, _no_items()).otherwise(aliases)
    return F.struct(module.alias("module_path"), items.alias("items"))


def resolve_rust(module_path: Column) -> Column:
    return F.when(F.size(module_path) > 0, F.concat(F.lit("src/"), F.regexp_replace(F.array_join(module_path, "/"), "^crate/", ""), F.lit(".rs")))


def _beside(file: Column, rest: Column) -> Column:
    folder = dirname(file)
    return normalize_path(F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest)))


def resolve_ts(file: Column, module_path: Column) -> Column:
    """Only relative imports: the importing file's folder, the path, .ts."""
    return F.when(F.get(module_path, 0).isin(".", ".."), _beside(file, F.concat(F.array_join(module_path, "/"), F.lit(".ts"))))


def resolve_py(file: Column, raw: Column) -> Column:
    """Only `from .`: n dots go n - 1 folders up; without a name the package's __init__."""
    dots = F.length(F.regexp_extract(raw, r"^\s*from\s+(\.+)", 1))
    name = F.regexp_extract(raw, r"^\s*from\s+\.+([\w.]*)", 1)
    target = F.when(name == "", F.lit("__init__")).otherwise(F.replace(name, F.lit("."), F.lit("/")))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int"))
    return F.when(dots > 0, _beside(file, F.concat(up, target, F.lit(".py"))))


def resolve(language: Column, file: Column, raw: Column, module_path: Column) -> Column:
    return F.when(language == "rust", resolve_rust(module_path)).when(language == "typescript", resolve_ts(file, module_path)).when(language == "python", resolve_py(file, raw))
