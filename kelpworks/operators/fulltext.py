"""A stored full-text index and its match language.

The postings are written once, in order of term and key: a query's terms are equality or starts-with conditions that
parquet statistics answer with a few row groups, and no text is read. Beside them lies one row of statistics.

A query is words, all of which must occur; OR between words, "phrases in quotes", prefix* and NOT are understood, and
other marks separate words. Each word, phrase or prefix is one unit with a document frequency of its own.

Defined cases: null and empty texts count as texts without words; rows with a null key are left out; repeated keys are one
text (the smallest); a query without a positive unit finds nothing; case is folded, and accents unless the index is
built to keep them; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import B, IDF_FLOOR, K1


def _folding(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Letters with accents and their bases, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(first, last + 1)]
    pairs = [(c.lower(), b.lower()) for c, b in pairs if c != b and len(c.lower()) == 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASES = _folding()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), _ACCENTED, _BASES)


def folded(text: str) -> str:
    low = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn")
    return low.translate(str.maketrans(_ACCENTED, _BASES))


def words(text: Column, folds: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(fold(text) if folds else F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


@dataclass(frozen=True)
class Unit:
    """One word, the words of a phrase, or the beginning of a word."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Match:
    """Units of which all (or, in each inner tuple, any) must occur, and units that must not."""

    wanted: tuple[tuple[Unit, ...], ...]
    unwanted: tuple[Unit, ...] = ()


_PART = re.compile(r'"([^"]*)"\s*(\*?)|([^\s"]+)')


def parse_match(query: str, mode: str = "and", folds: bool = True) -> Match:
    """The units of a query; with mode "or" any of them is enough."""
    groups: list[list[Unit]] = []
    unwanted: list[Unit] = []
    negate = either = False
    for m in _PART.finditer(query):
        if m.group(3) in ("AND", "OR", "NOT"):
            either, negate = m.group(3) == "OR", m.group(3) == "NOT"
            continue
        raw = m.group(1) if m.group(1) is not None else m.group(3)
        terms = tuple(t for t in re.split(r"[\W_]+", folded(raw) if folds else raw.lower()) if t)
        if not terms:
            continue
        prefix = (m.group(2) or "") == "*" or (m.group(1) is None and raw.endswith("*"))
        # Marks inside a word part it; outside of quotes its parts are words of their own.
        units = [Unit(terms, prefix)] if m.group(1) is not None else [Unit((t,), prefix and i == len(terms) - 1) for i, t in enumerate(terms)]
        if negate:
            unwanted += units
        elif either and groups:
            groups[-1] += units
        else:
            groups += [[u] for u in units]
        negate = either = False
    if mode == "or" and groups:
        groups = [[u for g in groups for u in g]]
    return Match(tuple(tuple(dict.fromkeys(g)) for g in groups), tuple(dict.fromkeys(unwanted)))


class FullText:
    """The index in `folder`: `postings` (term, key, tf, dl, at) and `stats` (n, avgdl)."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "key", folds: bool = True):
        self.spark, self.folder, self.key, self.folds = spark, folder.rstrip("/"), key, folds

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, folder: str, folds: bool = True, unique: bool = False) -> FullText:
        """Writes the index of the texts of df. One shuffle puts the words in order; a frequent word lies in several parts.

        Keys known to be `unique` spare another one, of the texts.
        """
        texts = df.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("key IS NOT NULL")
        texts = texts if unique else texts.groupBy("key").agg(F.min("t").alias("t"))
        cut = texts.select("key", words(F.col("t"), folds).alias("w"))
        said = cut.select("key", F.size("w").alias("dl"), F.posexplode("w").alias("p", "term"))
        placed = said.repartitionByRange("term", "key").groupBy("term", "key").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("p")).alias("at"))
        placed.sortWithinPartitions("term", "key").write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(f"{folder}/postings")
        cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")
        return cls(df.sparkSession, folder, key, folds)

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/stats")

    def _hits(self, unit: Unit) -> DataFrame:
        """`key, tf, dl` of a unit; a phrase occurs where its words follow each other."""
        of = lambda t, prefix: self.postings.filter(F.col("term").startswith(t) if prefix else F.col("term") == t)
        if len(unit.terms) == 1:
            rows = of(unit.terms[0], unit.prefix)
            return rows.groupBy("key").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")) if unit.prefix else rows.select("key", "tf", "dl")
        out = None
        for i, t in enumerate(unit.terms):
            last = unit.prefix and i == len(unit.terms) - 1
            rows = of(t, last).select("key", "dl", F.transform("at", lambda x: x - i).alias("at"))
            if last:
                rows = rows.groupBy("key").agg(F.first("dl").alias("dl"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
            out = rows if out is None else out.join(rows.select("key", F.col("at").alias("next")), "key").select("key", "dl", F.array_intersect("at", "next").alias("at"))
        return out.select("key", F.size("at").alias("tf"), "dl").filter("tf > 0")

    def _all_hits(self, units: list[Unit]) -> DataFrame:
        """`unit, key, tf, dl`: plain words by one scan, the others by one each."""
        plain = {u.terms[0]: i for i, u in enumerate(units) if len(u.terms) == 1 and not u.prefix}
        parts = []
        if plain:
            number = F.element_at(F.create_map(*(F.lit(x) for kv in plain.items() for x in kv)), F.col("term"))
            parts.append(self.postings.filter(F.col("term").isin(*plain)).select(number.alias("unit"), "key", F.col("tf").cast("long").alias("tf"), "dl"))
        parts += [self._hits(u).select(F.lit(i).alias("unit"), "key", F.col("tf").cast("long").alias("tf"), "dl") for i, u in enumerate(units) if u.terms[0] not in plain or len(u.terms) > 1 or u.prefix]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def search(self, query: str, mode: str = "and", keep: DataFrame | None = None) -> DataFrame:
        """`<key>, score` of every matching text. keep (one column, the key) restricts what is ranked, not the statistics."""
        match = parse_match(query, mode, self.folds)
        units = list(dict.fromkeys([u for g in match.wanted for u in g] + list(match.unwanted)))
        if not match.wanted:
            return self.postings.select(F.col("key").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        hits = self._all_hits(units)
        counts = hits.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))  # one row per unit
        rows = hits if keep is None else hits.join(keep.select(F.col(keep.columns[0]).alias("key")).distinct(), "key", "left_semi")
        scored = rows.join(F.broadcast(counts), "unit").join(F.broadcast(self.stats))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        wanted = [units.index(u) for g in match.wanted for u in g]
        per = scored.groupBy("key").agg(F.sum(F.when(F.col("unit").isin(*wanted), part)).alias("score"), F.collect_set("unit").alias("has"))
        for g in match.wanted:
            per = per.filter(F.arrays_overlap("has", F.array(*(F.lit(units.index(u)) for u in g))))
        if match.unwanted:
            per = per.filter(~F.arrays_overlap("has", F.array(*(F.lit(units.index(u)) for u in match.unwanted))))
        return per.select(F.col("key").alias(self.key), "score")


def fingerprint(df: DataFrame) -> str:
    """What the files under df are: paths, sizes and times. Another state of the data has another one."""
    import hashlib

    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    h = hashlib.sha256()
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(conf).getFileStatus(path)
        h.update(f"{f}\0{s.getLen()}\0{s.getModificationTime()}\n".encode())
    return h.hexdigest()[:24]


def stored(df: DataFrame, key: str, text: str, name: str, folds: bool = True) -> FullText:
    """The index of df's texts in the shared folder, written if this state of the data has none there yet."""
    from ..session import shared_dir

    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/fulltext/{name}-{'folded' if folds else 'plain'}-{fingerprint(df)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/stats/_SUCCESS")  # written last
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        FullText.build(df, key, text, folder, folds)
    return FullText(spark, folder, key, folds)
