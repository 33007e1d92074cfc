"""The symbol graph: building edges, one-hop lookups and outlines.

Ids are file::name::start. Edges carry the parts as columns, so lookups are equality filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_ID = r"^(.*)::(.*)::(\d+)$"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def with_parts(edges: DataFrame) -> DataFrame:
    parts = [F.regexp_extract(f"{side}_id", _ID, i).alias(f"{side}_{name}") for side in ("from", "to") for i, name in ((1, "file"), (2, "name"))]
    starts = [F.expr(f"try_cast(regexp_extract({side}_id, '::([0-9]+)$', 1) AS bigint)").alias(f"{side}_start") for side in ("from", "to")]
    return edges.select(*edges.columns, *parts, *starts)


@dataclass(frozen=True)
class Selector:
    """One symbol by its id, all of a name in a file, or all whose id contains a qualified name."""

    symbol_id: str | None = None
    name: str | None = None
    file: str | None = None
    qualified: str | None = None

    def on(self, side: str) -> Column:
        if self.symbol_id is not None:
            return F.col(f"{side}_id") == self.symbol_id
        if self.qualified is not None:
            return F.col(f"{side}_id").contains(self.qualified)
        cond = F.col(f"{side}_name") == self.name
        return cond if self.file is None else cond & (F.col(f"{side}_file") == self.file)


def incoming(edges: DataFrame, sel: Selector, kind: str | None = None) -> DataFrame:
    rows = edges.filter(sel.on("to"))
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def outgoing(edges: DataFrame, sel: Selector, kind: str | None = None) -> DataFrame:
    rows = edges.filter(sel.on("from"))
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def grouped_sites(calls: DataFrame, side: str) -> DataFrame:
    """`file, name, symbol_id, sites`: the other ends of call edges by file and name, with the positions of the callers."""
    return calls.groupBy(F.col(f"{side}_file").alias("file"), F.col(f"{side}_name").alias("name")).agg(F.min(f"{side}_id").alias("symbol_id"), F.sort_array(F.collect_set("from_start")).alias("sites"))


def callers(edges: DataFrame, sel: Selector) -> DataFrame:
    return grouped_sites(incoming(edges, sel, "Calls"), "from")


def callees(edges: DataFrame, sel: Selector) -> DataFrame:
    return grouped_sites(outgoing(edges, sel, "Calls"), "to")


def imports_of(edges: DataFrame, file: str) -> DataFrame:
    return edges.filter((F.col("kind") == "Imports") & (F.col("from_file") == file)).select(F.col("to_file").alias("file")).distinct()


def imported_by(edges: DataFrame, file: str) -> DataFrame:
    return edges.filter((F.col("kind") == "Imports") & (F.col("to_file") == file)).select(F.col("from_file").alias("file")).distinct()


def import_neighbours(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files one import away from the changed ones in either direction, without those themselves."""
    imports = edges.filter("kind = 'Imports'").select("from_file", "to_file").distinct()
    c = changed.select(F.col("file").alias("c")).distinct()
    out = imports.join(c, F.col("from_file") == F.col("c")).select(F.col("to_file").alias("file"))
    back = imports.join(c, F.col("to_file") == F.col("c")).select(F.col("from_file").alias("file"))
    return out.unionByName(back).distinct().join(changed.select("file").distinct(), "file", "left_anti")


# --- building -----------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """The distinct ASCII identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def called_words(text: Column) -> Column:
    """The distinct identifiers directly followed by an opening parenthesis."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})\\("), F.lit(1)))


def _bins(start: str, end: str, width: int = 4096) -> Column:
    """A row per bin that a half-open range touches, so ranges of one file join within bins, not all with all."""
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))


def mentioned_words(text: Column) -> Column:
    """The distinct identifiers of a text; one that is called somewhere also comes with its parenthesis."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD + r"\(?"), F.lit(0)))


def reference_edges(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """References and calls within a file: a symbol overlaps a chunk that says (calls) the name of another symbol of the file.

    The words of the chunks are cut once, meet the symbols of their name first, so most of them end there, and then
    the symbols around them, within bins of offsets.
    """
    word = F.explode(mentioned_words(F.col("text")))
    said = chunks.filter("range_end > range_start").select(F.col("file").alias("c_file"), F.col("range_start").alias("c_start"), F.col("range_end").alias("c_end"), word.alias("said"))
    said = said.withColumn("called", F.col("said").endswith("(")).withColumn("word", F.rtrim("said", F.lit("(")))
    targets = symbols.select(F.col("symbol_id").alias("to_id"), F.col("file").alias("t_file"), "name", F.lower("kind").isin("function", "method").alias("callable"))
    said = said.join(targets, (F.col("c_file") == F.col("t_file")) & (F.col("word") == F.col("name"))).select("c_file", "c_start", "c_end", "to_id", (F.col("called") & F.col("callable")).alias("calls"))
    said = said.withColumn("c_bin", _bins("c_start", "c_end"))
    own = symbols.filter(~F.lower("kind").isin("variable", "constant") & (F.col("range_end") > F.col("range_start"))).select(F.col("symbol_id").alias("from_id"), "file", "range_start", "range_end", _bins("range_start", "range_end").alias("bin"))
    overlap = (F.col("file") == F.col("c_file")) & (F.col("bin") == F.col("c_bin")) & (F.col("range_start") < F.col("c_end")) & (F.col("c_start") < F.col("range_end")) & (F.col("from_id") != F.col("to_id"))
    met = own.join(said, overlap).groupBy("from_id", "to_id").agg(F.max("calls").alias("calls"))
    kinds = F.when(F.col("calls"), F.array(F.lit("References"), F.lit("Calls"))).otherwise(F.array(F.lit("References")))
    return met.select("from_id", "to_id", F.explode(kinds).alias("kind"), F.lit("Heuristic").alias("confidence"))


def define_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("symbol_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("Defines").alias("kind"), F.lit("Resolved").alias("confidence"))


def import_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports and their reverse: each symbol of the importing file to the first symbol of the item's name in the target.

    imports has `file, target_file, items`.
    """
    items = imports.filter("target_file IS NOT NULL").select("file", "target_file", F.explode("items").alias("item")).distinct()
    first = symbols.groupBy(F.col("file").alias("t_file"), F.col("name").alias("t_name")).agg(F.min(F.struct("range_start", "symbol_id")).alias("m"))
    found = items.join(first, (F.col("target_file") == F.col("t_file")) & (F.col("item") == F.col("t_name"))).select("file", F.col("m.symbol_id").alias("to_id"))
    pairs = symbols.select(F.col("symbol_id").alias("from_id"), "file").join(found, "file").select("from_id", "to_id")
    out = pairs.select("from_id", "to_id", F.lit("Imports").alias("kind"), F.lit("Heuristic").alias("confidence"))
    back = pairs.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("ImportedBy").alias("kind"), F.lit("Heuristic").alias("confidence"))
    return out.unionByName(back)


def build_edges(symbols: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    every = [define_edges(symbols), reference_edges(symbols, chunks), import_edges(symbols, imports)]
    return reduce(lambda a, b: a.unionByName(b), every).dropDuplicates(["from_id", "to_id", "kind"])


def refresh_edges(old: DataFrame, symbols: DataFrame, chunks: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges (with parts) after the files of `changed` (file) changed, as build_edges would give them.

    symbols, chunks and imports (file, target_file, items) are those of all present files. An edge depends on the
    files of its two ends only: those with an end in a changed file go, and what the changed files define and
    mention, what they import, and what others import from them is built anew.
    """
    c = changed.select(F.col("file").alias("_c")).distinct()
    of = lambda df, key, how="left_semi": df.join(c, F.col(key) == F.col("_c"), how)
    known = imports.filter("target_file IS NOT NULL").select("file", "target_file", "items")
    near = of(known, "file").unionByName(of(of(known, "file", "left_anti"), "target_file"))
    ends = near.select("file").union(near.select("target_file")).distinct()
    own = of(symbols, "file")
    fresh = [define_edges(own), reference_edges(own, of(chunks, "file")), import_edges(symbols.join(ends, "file", "left_semi"), near)]
    fresh = with_parts(reduce(lambda a, b: a.unionByName(b), fresh))
    kept = of(of(old, "from_file", "left_anti"), "to_file", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns)).dropDuplicates(["from_id", "to_id", "kind"])


# --- outlines -----------------------------------------------------------------------------------


def outline(symbols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`symbol_id, name, file, parent, depth, path`: each symbol below its parents of the same file, flat.

    A parent that is not in the file makes its child a root. One join per level, until a level is empty or
    max_depth is reached. A symbol is not put below itself; a cycle that no root leads to has no place.
    """
    s = symbols.select("symbol_id", "name", "file", "parent_id")
    p = s.select(F.col("symbol_id").alias("p_id"), F.col("file").alias("p_file"))
    s = cut(s.join(p, (F.col("parent_id") == F.col("p_id")) & (F.col("file") == F.col("p_file")), "left").select("symbol_id", "name", "file", F.col("p_id").alias("parent")))
    level = s.filter("parent IS NULL").select("symbol_id", "name", "file", "parent", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array("symbol_id").alias("above"))
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        up = level.select(F.col("symbol_id").alias("u_id"), (F.col("depth") + 1).alias("depth"), F.col("path").alias("u_path"), F.col("above").alias("u_above"))
        below = s.join(up, F.col("parent") == F.col("u_id")).filter(~F.coalesce(F.array_contains("u_above", F.col("symbol_id")), F.lit(False)))
        level = cut(below.select("symbol_id", "name", "file", "parent", "depth", F.concat_ws("/", "u_path", "name").alias("path"), F.concat("u_above", F.array("symbol_id")).alias("above")))
        if level.isEmpty():
            break
        out, depth = out.unionByName(level), depth + 1
        if depth % 32 == 0:  # else the plan of a very deep tree grows by a union a level
            out = cut(out)
    return out.drop("above")


# --- intervals ----------------------------------------------------------------------------------


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Pairs of half-open intervals `a_id, b_id` that overlap under one key.

    Both sides are put into bins of `width`, which join by equality, so one file with very many
    intervals still spreads; a pair is kept in the first bin that both have.
    """
    left = a.filter("a_end > a_start").withColumn("bin", _bins("a_start", "a_end", width))
    right = b.filter("b_end > b_start").withColumn("bin", _bins("b_start", "b_end", width))
    hit = left.join(right, [key, "bin"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return hit.filter(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("bin")


def enclosing_smallest(points: DataFrame, nodes: DataFrame, width: int = 4096) -> DataFrame:
    """`point_id, node_id`: for each point (file_id, at) the narrowest node with start <= at <= end (then the smallest id)."""
    bins = F.explode(F.sequence(F.floor(F.col("byte_start") / width), F.floor(F.col("byte_end") / width)))
    n = nodes.filter("byte_start >= 0 AND byte_end >= byte_start").select("file_id", F.col("id").alias("node_id"), "byte_start", "byte_end", bins.alias("bin"))
    p = points.withColumn("bin", F.floor(F.col("at") / width))
    hit = p.join(n, ["file_id", "bin"]).filter((F.col("byte_start") <= F.col("at")) & (F.col("at") <= F.col("byte_end")))
    best = F.min(F.struct((F.col("byte_end") - F.col("byte_start")).alias("w"), F.col("node_id")))
    return hit.groupBy("point_id").agg(best.alias("m")).select("point_id", F.col("m.node_id").alias("node_id"))


def nearest_parent(nodes: DataFrame) -> DataFrame:
    """`id, parent`: the narrowest other node of the file and family that contains the node's range and is less deep.

    Nodes meet only in the bin where the inner one begins; ties go to the later start and the larger id.
    """
    c = nodes.select("file_id", F.col("id").alias("id"), "byte_start", "byte_end", "depth").withColumn("bin", F.floor(F.col("byte_start") / 4096))
    p = nodes.select("file_id", F.col("id").alias("p_id"), F.col("byte_start").alias("p_start"), F.col("byte_end").alias("p_end"), F.col("depth").alias("p_depth"))
    p = p.filter("p_end >= p_start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("p_start") / 4096), F.floor(F.col("p_end") / 4096))))
    inside = (F.col("p_id") != F.col("id")) & (F.col("p_start") <= F.col("byte_start")) & (F.col("p_end") >= F.col("byte_end")) & (F.col("p_depth") < F.col("depth"))
    hit = c.join(p, ["file_id", "bin"]).filter(inside)
    best = F.max(F.struct("p_depth", "p_start", "p_id"))
    return hit.groupBy("id").agg(best.alias("m")).select("id", F.col("m.p_id").alias("parent"))
