"""File trees as tables, honouring ignore files.

`FileTree` is a Python data source: the listing is one partition per top folder, so folders are read in parallel on
executors that share the storage. `scan_folder` is the plain form without ignore rules, on local folders and object stores.

Defined cases: hidden files and folders, files over MAX_BYTES (a fixed value of the engine this follows) and links that
leave the root are no files of the tree; a folder that cannot be listed has no files; a file that cannot be read has a
row without hash and content, one that is no UTF-8 a row without content.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import LANGUAGE_OF_EXTENSION

MAX_BYTES = 5 * 1024 * 1024
SCHEMA = "path string, hash string, language string, size long, modified timestamp, content string"
IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the path below the ignore file's folder, whether it re-includes, whether it is for folders only)."""
    line = line.rstrip("\n").rstrip("\r")
    if not line.strip() or line.startswith("#"):
        return None
    line = line.rstrip(" ") if not line.endswith("\\ ") else line
    again = line.startswith("!")
    line = line[1:] if again else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    parts = re.split(r"(/\*\*/|^\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\])", line)
    wild = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(wild.get(p) or (p.replace("[!", "[^") if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts)
    return re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), again, only_dirs


def is_ignored(rules: list[tuple[str, list]], path: str, is_dir: bool) -> bool:
    """The last matching rule decides; rules are (folder, rules of its ignore files), outermost first."""
    out = False
    for folder, own in rules:
        below = path[len(folder) + 1 :] if folder else path
        for pattern, again, only_dirs in own:
            if (is_dir or not only_dirs) and pattern.match(below):
                out = not again
    return out


def inside(path: str, root: str) -> bool:
    """Whether a path, with its links followed, stays below the root."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    return real == top or real.startswith(top + os.sep)


def _names(folder: str) -> list[str]:
    """What is in a folder and not hidden; nothing if it cannot be listed."""
    try:
        return sorted(n for n in os.listdir(folder) if not n.startswith("."))
    except OSError:
        return []


def walk(root: str, below: str = "", recurse: bool = True, extensions: tuple[str, ...] = (), ignore: bool = True):
    """(relative path, absolute path) of the regular files that are not hidden, ignored, too large or outside the root."""

    def rules_of(folder: str) -> list:
        out = []
        if not ignore:
            return out
        for name in IGNORE_FILES:
            p = os.path.join(root, folder, name)
            if os.path.isfile(p):
                with open(p, encoding="utf-8", errors="replace") as f:
                    out += [r for r in map(ignore_rule, f) if r]
        return out

    def visit(folder: str, rules: list):
        rules = [*rules, (folder, rules_of(folder))]
        for name in _names(os.path.join(root, folder)):
            rel = f"{folder}/{name}" if folder else name
            full = os.path.join(root, rel)
            is_dir = os.path.isdir(full)
            if is_ignored(rules, rel, is_dir) or not inside(full, root):
                continue
            if is_dir:
                if recurse and not os.path.islink(full):
                    yield from visit(rel, rules)
            elif os.path.isfile(full) and os.path.getsize(full) <= MAX_BYTES:
                ext = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
                if not extensions or ext in extensions:
                    yield rel, full

    above, folder = [], ""
    for part in below.split("/") if below else []:
        above.append((folder, rules_of(folder)))
        folder = f"{folder}/{part}" if folder else part
    yield from visit(below, above)


class _Folder(InputPartition):
    def __init__(self, below: str, recurse: bool):
        self.below, self.recurse = below, recurse


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        self.extensions = tuple(e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip())
        self.ignore = options.get("ignore", "true").lower() != "false"

    def partitions(self):
        rules = []
        for name in IGNORE_FILES if self.ignore else ():
            p = os.path.join(self.root, name)
            if os.path.isfile(p):
                with open(p, encoding="utf-8", errors="replace") as f:
                    rules += [r for r in map(ignore_rule, f) if r]
        tops = [d for d in _names(self.root) if os.path.isdir(os.path.join(self.root, d)) and not os.path.islink(os.path.join(self.root, d)) and not is_ignored([("", rules)], d, True)]
        return [_Folder("", False), *(_Folder(d, True) for d in tops)]

    def read(self, partition):
        for rel, full in walk(self.root, partition.below, partition.recurse, self.extensions, self.ignore):
            stat = os.stat(full)
            try:
                with open(full, "rb") as f:
                    data = f.read()
                digest, size, text = hashlib.sha256(data).hexdigest(), len(data), data.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            except OSError:
                digest, size, text = None, stat.st_size, None
            name = rel.rsplit("/", 1)[-1]
            ext = name.rsplit(".", 1)[-1] if "." in name[1:] else ""
            yield rel, digest, LANGUAGE_OF_EXTENSION.get(ext), size, datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc), text


class FileTree(DataSource):
    """spark.read.format("filetree").option("extensions", "rs,py").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("file_id", F.expr("xxhash64(path) & 9223372036854775807"))


def read_tree(spark: SparkSession, root: str, extensions: str = "", ignore: bool = True) -> DataFrame:
    spark.dataSource.register(FileTree)
    return _with_id(spark.read.format("filetree").option("extensions", extensions).option("ignore", str(ignore).lower()).load(root))


def scan_folder(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """The same columns without ignore rules.

    A local folder may hold links, so it is listed by the same careful walk; object stores, which have none, are read
    by Spark's own reader.
    """
    scheme = re.match(r"([a-z][a-z0-9+.-]*)://", root)
    if scheme is None or scheme.group(1) == "file":
        return read_tree(spark, root, ",".join(extensions or []), ignore=False)
    from ..functions.paths import language_of

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    text = F.col("content").cast("string")
    files = reader.load(root).filter(F.col("length") <= MAX_BYTES).filter(~rel.rlike(r"(^|/)\."))
    out = files.select(
        rel.alias("path"), F.sha2("content", 256).alias("hash"), language_of(rel).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.when(F.is_valid_utf8(text), text).alias("content"),
    )
    return _with_id(out)
