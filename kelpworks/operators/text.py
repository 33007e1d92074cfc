"""Line-oriented search and the shaping of text spans."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

HEAD_LINES, TAIL_LINES = 40, 20
MAX_SPAN_LINES, MAX_TOTAL_LINES = 80, 400


def search_pattern(pattern: str, regex: bool = False, case_sensitive: bool = False) -> str:
    """The Java pattern of a search: literal unless regex, ignoring case unless told otherwise."""
    body = pattern if regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    return body if case_sensitive else f"(?i){body}"


def lines_of(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """`keys, line, text, before, after`: a row per line, 1-based; a final line end begins no line.

    The neighbours come from the same array, so context costs no shuffle and no window.
    """
    parts = F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), "\r?\n")
    with_lines = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, parts.alias("_l"))
    rows = with_lines.select(*keys, F.posexplode("_l").alias("_p", "text"), "_l")
    at = lambda i: F.get(F.col("_l"), i)
    return rows.select(*keys, (F.col("_p") + 1).alias("line"), "text", at(F.col("_p") - 1).alias("before"), at(F.col("_p") + 1).alias("after"))


def search_lines(df: DataFrame, keys: list[str], pattern: str, text: str = "content", regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """The lines that match, with the number of matches in each and the lines around it."""
    p = search_pattern(pattern, regex, case_sensitive)
    hit = df.filter(F.col(text).rlike(p))  # whole texts without a match are dropped before they are split
    return lines_of(hit, keys, text).withColumn("matches", F.regexp_count("text", F.lit(p)).cast("long")).filter("matches > 0")


def match_columns(df: DataFrame, keys: list[str], pattern: str, text: str = "content", regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """`keys, line, column, match`: a row per match; columns count bytes from 1."""
    found = search_lines(df, keys, pattern, text, regex, case_sensitive)
    compiled = re.compile(pattern if regex else re.escape(pattern), 0 if case_sensitive else re.IGNORECASE)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}

    def run(batches):
        for pdf in batches:
            rows = [(*vals, line, len(t[: m.start()].encode()) + 1, m.group()) for *vals, line, t in pdf.itertuples(index=False) for m in compiled.finditer(t) if m.group()]
            yield pd.DataFrame(rows, columns=[*keys, "line", "column", "match"])

    return found.select(*keys, "line", "text").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", line int, column int, match string")


def total_matches(df: DataFrame, pattern: str, text: str = "content", regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """`total`: matches over whole texts, by one aggregate."""
    p = search_pattern(pattern, regex, case_sensitive)
    return df.agg(F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(p)).cast("long")), F.lit(0)).cast("long").alias("total"))


def raw_bytes_of(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of a text; what lies past its end is empty."""
    size = F.octet_length(text)
    first, stop = F.least(start, size), F.least(end, size)
    return F.substring(F.encode(text, "utf-8"), (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int"))


def bytes_of(text: Column, start: Column, end: Column) -> Column:
    """The text in bytes [start, end); a cut character becomes U+FFFD."""
    return F.make_valid_utf8(raw_bytes_of(text, start, end).cast("string"))


def line_range(text: Column, first: int, last: int) -> Column:
    """Lines first to last (1-based, inclusive), each with its line end where it has one."""
    parts = F.split(text, "\n")
    n = F.when(text.endswith("\n"), F.size(parts) - 1).otherwise(F.size(parts))
    cut = F.array_join(F.slice(parts, first, F.lit(last - first + 1)), "\n")
    return F.when(F.lit(first) > n, "").otherwise(F.concat(cut, F.when((F.lit(last) < n) | (text.endswith("\n") & (F.lit(last) == n)), "\n").otherwise("")))


def line_of_byte(text: Column, at: Column) -> Column:
    """1 + the line ends before byte `at`."""
    raw = F.substring(F.encode(text, "utf-8"), F.lit(1), F.least(at, F.octet_length(text)).cast("int"))
    # latin-1 maps each byte to one character, so no character is cut.
    return F.regexp_count(F.decode(raw, "iso-8859-1"), F.lit("\n")).cast("int") + 1


@F.pandas_udf(ArrayType(LongType()))
def _starts(texts: pd.Series) -> pd.Series:
    def one(t):
        data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        return np.concatenate([[0], np.flatnonzero(data == 10) + 1])

    return texts.map(one)


def start_bytes(text: Column) -> Column:
    """The byte at which each line of a text begins, in time linear in the text; lines end with LF."""
    return _starts(text)


def line_starts(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """`keys, line, byte_start` of each line, without a shuffle."""
    rows = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, F.posexplode(start_bytes(F.col(text))).alias("p", "byte_start"))
    return rows.select(*keys, (F.col("p") + 1).alias("line"), "byte_start")


def byte_lines(points: DataFrame, files: DataFrame, key: str = "file_id", text: str = "content", width: int = 4096) -> DataFrame:
    """`point_id, line`: the line that holds byte `at` of each point (point_id, key, at); past the end it is the last line.

    Line starts and points meet in bins of bytes; a bin without a start of its own is given the last one before it, so
    a file's text is read once, however many points it has.
    """
    f = files.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_f"), start_bytes(F.col(text)).alias("_s"))
    rows = f.select("_f", F.posexplode("_s").alias("_p", "_at"), F.get("_s", F.col("_p") + 1).alias("_next"), (F.size("_s") - 1).alias("_last"))
    first = F.floor(F.col("_at") / width)
    # The last line reaches to the end of the text and beyond; points there are clipped to its start.
    until = F.when(F.col("_next").isNull(), first).otherwise(F.floor((F.col("_next") - 1) / width))
    spans = rows.select("_f", (F.col("_p") + 1).alias("line"), "_at", "_next", F.explode(F.sequence(first, until)).alias("_bin"))
    ends = f.select("_f", F.get("_s", F.size("_s") - 1).alias("_end"))
    p = points.select("point_id", F.col(key).alias("_k"), "at").join(ends, F.col("_k") == F.col("_f")).select("point_id", "_k", F.least("at", "_end").alias("_x"))
    p = p.withColumn("_b", F.floor(F.col("_x") / width))
    hit = (F.col("_k") == F.col("_f")) & (F.col("_b") == F.col("_bin")) & (F.col("_at") <= F.col("_x")) & (F.col("_next").isNull() | (F.col("_x") < F.col("_next")))
    return p.join(spans, hit).select("point_id", "line")


def truncate_lines(text: Column, cap: int = MAX_SPAN_LINES) -> Column:
    """The text, or its first 40 and last 20 lines around a note of how many are left out."""
    parts = F.split(text, "\n")
    ends = text.endswith("\n")
    n = F.when(text == "", 0).when(ends, F.size(parts) - 1).otherwise(F.size(parts))
    note = lambda k: F.concat(F.lit("[..."), k.cast("string"), F.lit(" lines elided...]\n"))
    if cap <= 1:
        return F.when(n <= cap, text).otherwise(note(n))
    head = min(HEAD_LINES, cap - 1)
    tail = min(TAIL_LINES, max(0, cap - 1 - head))
    first = F.concat(F.array_join(F.slice(parts, 1, head), "\n"), F.lit("\n"))
    last = F.concat(F.array_join(F.slice(parts, n - tail + 1, F.lit(tail)), "\n"), F.when(ends, "\n").otherwise("")) if tail else F.lit("")
    return F.when(n <= cap, text).otherwise(F.concat(first, note(n - head - tail), last))


def count_lines(text: Column) -> Column:
    n = F.size(F.split(text, "\n"))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(text.endswith("\n"), 1).otherwise(0)))


def cap_total_lines(spans: DataFrame, order: list[Column], cap: int = MAX_TOTAL_LINES, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """The spans, in order, up to the first that would take more than `cap` lines in all.

    `spans` is a result list (a top-k), or has one per group in `by`.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("lines", count_lines(F.col(text)).cast("long")).withColumn("running", F.sum("lines").over(w)).filter(F.col("running") <= cap)
