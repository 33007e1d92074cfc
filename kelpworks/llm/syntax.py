"""Source files that do not parse.

The language is the one that the path's extension stands for. Each text is read token by token by a
table-driven generalised LR parser whose tables are built from a bundled grammar; the first token after
which no continuation could be a sentence is the file's error. Parsing is linear for text without
ambiguity, and every text is read as a whole.

Defined cases: null contents and other extensions are not judged; an empty source file is valid, an
empty JSON document is not, as it has no value; repeated rows are one file; both path separators and
letter cases of the extension count; a null repo is a group of its own; further columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexers

#: Extension, language, parser.
LANGUAGES = {
    "rs": ("rust", lexers.check_rust),
    "ts": ("typescript", lexers.check_typescript),
    "js": ("javascript", lexers.check_javascript),
    "py": ("python", lexers.check_python),
    "json": ("json", lexers.check_json),
    "yaml": ("yaml", lexers.check_yaml),
    "yml": ("yaml", lexers.check_yaml),
    "toml": ("toml", lexers.check_toml),
}
SCHEMA = "file_id long, repo string, language string, valid boolean, line int, error string"


def first_error(ext: str, text: str) -> tuple[int, str] | None:
    """(line, what) of the first error, or None if the text is valid."""
    found = LANGUAGES[ext][1](text)
    return None if found is None else (text.count("\n", 0, found[0]) + 1, found[1])


def checked_files(files: DataFrame) -> DataFrame:
    """The rows of SCHEMA, one per file that can be judged."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = files.select("file_id", "repo", ext.alias("ext"), "content").filter(F.col("file_id").isNotNull() & F.col("content").isNotNull() & F.col("ext").isin(*LANGUAGES))

    def run(batches):
        for pdf in batches:
            found = [first_error(e, c) for e, c in zip(pdf["ext"], pdf["content"])]
            yield pd.DataFrame({
                "file_id": pdf["file_id"], "repo": pdf["repo"], "language": [LANGUAGES[e][0] for e in pdf["ext"]], "valid": [f is None for f in found],
                "line": pd.array([None if f is None else f[0] for f in found], dtype="Int32"), "error": [None if f is None else f[1] for f in found],
            })

    return rows.mapInPandas(run, SCHEMA).dropDuplicates(["file_id"])


def error_rates(checked: DataFrame) -> DataFrame:
    """`repo, language, files, flagged, share` per repository and language."""
    n, bad = F.count(F.lit(1)), F.sum((~F.col("valid")).cast("long"))
    return checked.groupBy("repo", "language").agg(n.alias("files"), bad.alias("flagged"), F.round(bad / n, 6).alias("share"))
