"""The tool surface: an Engine over indexed tables, one method per tool.

`Engine.build` parses files once and stores every table and the full-text indexes as a version in the shared folder,
`Engine.open` reads the newest version, `refresh` stores the next one. An Engine can also be made from tables at hand.

Methods give DataFrames of spans or rows; only status counts, the router's emptiness test, a pack's
text and `deliver` run a job at once. Arguments are clamped as documented at each method.
"""

from __future__ import annotations

import datetime
import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Config
from .functions.paths import path_filter, safe_path
from .operators import fulltext as FT
from .operators import graph as G
from .operators import locate as L
from .operators import memory as M
from .operators import overview as O
from .operators import pack as P
from .operators import retrieval as R
from .operators import text as T
from .operators.routing import InvalidRequest, check_locate, choose_strategy, clamp, locate_plan, parse_locator
from .session import cut
from .sources.git import git_facts
from .sources.snapshots import SnapshotStore
from .streaming import changes as C

TIERS = ("offline", "files", "symbols", "structure", "vectors", "ready")


class NotReady(RuntimeError):
    """A tool needs a table that has not been built yet."""


class UnknownHandle(KeyError):
    """A handle that was never issued, or has expired."""


class HandleStore:
    """Handles of truncated spans: each lives ten minutes, and of more than 512 the oldest goes."""

    def __init__(self, ttl: float = 600.0, most: int = 512, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self._items: OrderedDict[str, tuple[float, tuple]] = OrderedDict()

    def issue(self, file: str, start: int, end: int) -> str:
        key = hashlib.sha256(f"{file}\0{start}\0{end}".encode()).hexdigest()[:24]
        self._items.pop(key, None)
        self._items[key] = (self.clock(), (file, start, end))
        while len(self._items) > self.most:
            self._items.popitem(last=False)
        return key

    def get(self, key: str) -> tuple[str, int, int]:
        born, target = self._items.get(key, (float("-inf"), None))
        if target is None or self.clock() - born >= self.ttl:
            self._items.pop(key, None)
            raise UnknownHandle(key)
        return target


@dataclass
class Engine:
    """Tables as streaming.changes.build_index makes them, with vectors and memories beside them."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    vectors: DataFrame | None = None
    memories: DataFrame | None = None
    embedder: Callable = R.hash_embedding
    dimension: int = 64
    handles: HandleStore = field(default_factory=HandleStore)
    config: Config = field(default_factory=Config)
    #: The files as they are now, where they may have changed since they were indexed; `locate` reads such files anew.
    current: DataFrame | None = None
    store: SnapshotStore | None = None
    version: int = 0
    indexes: dict[str, FT.FullText] = field(default_factory=dict)

    # --- the store

    @classmethod
    def build(cls, spark: SparkSession, folder: str, files: DataFrame, config: Config | None = None, **settings) -> Engine:
        """Parses the files that the settings let in and stores the next version of every table."""
        engine = cls(spark, {}, config=config or Config(), store=SnapshotStore(spark, folder), **settings)
        keep = path_filter(F.col("path"), None, engine.config.index.exclude)
        engine._write(C.build_index(files.filter(keep)))
        return engine

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config: Config | None = None, **settings) -> Engine:
        """The newest stored version, brought to the present schema."""
        engine = cls(spark, {}, config=config or Config(), store=SnapshotStore(spark, folder), **settings)
        versions = engine.store.versions("edges")  # written last
        if not versions:
            raise NotReady(f"{folder} holds no index")
        engine._read(versions[-1])
        return engine

    def _write(self, tables: dict[str, DataFrame]) -> None:
        version = max([self.version, *self.store.versions("edges")]) + 1
        for name in ("files", "nodes", "symbols", "chunks", "imports"):
            df = tables[name]
            self.store.write(name, schemas.conform(name, df), version)
            tables = tables | {name: self.store.read(name, version)}
        first = F.min(F.struct("file", "range_start", "range_end", "text", "language")).alias("m")
        self.store.write("unique_chunks", tables["chunks"].groupBy("chunk_id").agg(first).select("chunk_id", "m.*"), version)
        FT.FullText.build(self.store.read("unique_chunks", version), "chunk_id", "text", f"{self.store.folder}/fulltext/chunks-{version}", unique=True)
        FT.FullText.build(L.searchable(tables["nodes"]), "id", "text", f"{self.store.folder}/fulltext/nodes-{version}")
        # Edges are built from the stored tables, so no file is parsed twice.
        edges = tables["edges"] if self.version else G.with_parts(G.build_edges(tables["symbols"], tables["chunks"], tables["imports"]))
        # In order of what lookups ask for, so they read a few row groups.
        self.store.write("edges", schemas.conform("edges", edges).repartitionByRange("to_name", "to_id").sortWithinPartitions("to_name", "to_id"), version)
        self._read(version)

    def _read(self, version: int) -> None:
        names = ("files", "nodes", "symbols", "chunks", "imports", "edges")
        self.tables = {n: schemas.migrate(n, self.store.read(n, version), schemas.VERSION) for n in names}
        self.tables["unique_chunks"] = self.store.read("unique_chunks", version)
        self.indexes = {n: FT.FullText(self.spark, f"{self.store.folder}/fulltext/{n}-{version}", k) for n, k in (("chunks", "chunk_id"), ("nodes", "id"))}
        self.version = version
        vectors = self.store.read("vectors")
        self.vectors = self.vectors if vectors is None else vectors
        memories = self.store.read("memories")
        self.memories = self.memories if memories is None else memories

    def refresh(self, changes: DataFrame, current: DataFrame) -> None:
        """Stores the version after the changes (path, change); current has the present files."""
        self._write(C.refresh_index(self.tables, changes, current))
        self.current = None

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise NotReady(f"{name} has not been built")
        return self.tables[name]

    def _vector(self, query: str) -> list[float]:
        return [float(x) for x in self.embedder([query], self.dimension)[0]]

    def build_vectors(self, model: str = "feature-hash") -> DataFrame:
        """Embeds the chunks that have no vector of the model yet and adds them."""
        chunks = self._table("chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])
        todo = chunks if self.vectors is None else R.missing_vectors(chunks, self.vectors, model)
        fresh = R.embed(todo, "chunk_id", "text", self.dimension, self.embedder, model)
        self.vectors = fresh if self.vectors is None else self.vectors.unionByName(fresh)
        if self.store is not None:
            self.store.write("vectors", self.vectors, max(self.store.versions("vectors"), default=0) + 1)
            self.vectors = self.store.read("vectors")
        return self.vectors

    # --- status and overview

    def get_index_status(self) -> DataFrame:
        extra = {"vectors": self.vectors} if self.vectors is not None else {}
        return O.status(**self.tables, **extra)

    def tier(self) -> str:
        steps = [("files", "files"), ("symbols", "symbols"), ("structure", "nodes"), ("vectors", None)]
        have = [n for n, t in steps if (t in self.tables if t else self.vectors is not None)]
        return "ready" if len(have) == len(steps) else have[-1] if have else "offline"

    def get_repo_overview(self, depth: int = 3, root: str | None = None) -> dict:
        """Tables about the files; with the root of a working copy also its `git` facts (a dict, or None)."""
        files = self._table("files")
        facts = {} if root is None else {"git": git_facts(root)}
        return facts | {
            "languages": O.language_counts(files).orderBy(F.desc("files"), "language"), "totals": O.totals(files), "largest": O.largest(files),
            "entry_points": O.entry_points(files), "readme": O.readme_excerpt(files), "tree": O.tree(files, clamp(depth, 1, 6)).orderBy("pos"),
        }

    # --- text and meaning

    def search_text(self, pattern: str, regex: bool = False, case_sensitive: bool = False, max_results: int = 100, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """One row more than max_results (1 to 1,000) is asked for, so the caller sees whether there are more."""
        files = self._table("files").filter(path_filter(F.col("path"), include, exclude))
        return T.search_lines(files, ["path"], pattern, "content", regex, case_sensitive).orderBy("path", "line").limit(clamp(max_results, 1, 1000) + 1)

    def semantic_coverage(self) -> DataFrame:
        """`total, embedded, ratio`: how many of the chunks a semantic search can find by meaning."""
        chunks = self._chunks()
        return R.coverage(chunks, chunks.select("chunk_id").limit(0) if self.vectors is None else self.vectors)

    def search_semantic(self, query: str, k: int = 10, languages: list[str] | None = None, include: list[str] | None = None, focus: str | None = None, exclude: list[str] | None = None) -> DataFrame:
        if self.vectors is None:
            raise NotReady("vectors have not been built")
        keep = None
        if languages:
            keep = F.col("language").isin(*[x.lower() for x in languages])
        if include or exclude:
            paths = path_filter(F.col("file"), include, exclude)
            keep = paths if keep is None else keep & paths
        chunks = self._chunks()
        hits = R.hybrid(chunks, self.vectors, "chunk_id", query, self._vector(query), clamp(k, 1, 100), focus=None if focus is None else F.lit(focus), keep=keep, index=self.indexes.get("chunks"))
        long_ = T.count_lines(F.col("text")) > T.MAX_SPAN_LINES
        spans = chunks.join(F.broadcast(hits.select("chunk_id", "score", "source")), "chunk_id").select("file", "range_start", "range_end", T.truncate_lines(F.col("text")).alias("text"), "score", "source", "chunk_id", long_.alias("truncated"))
        return T.cap_total_lines(spans, [F.desc("score"), F.col("file"), F.col("chunk_id")])

    def _chunks(self) -> DataFrame:
        """One row per chunk id; equal texts share one, with their first place."""
        if "unique_chunks" in self.tables:
            return self.tables["unique_chunks"]
        c = self._table("chunks")
        first = F.min(F.struct("file", "range_start", "range_end", "text", "language")).alias("m")
        return c.groupBy("chunk_id").agg(first).select("chunk_id", "m.*")

    # --- the graph

    def _selector(self, name: str, file: str | None = None) -> G.Selector:
        if name.count("::") >= 2:
            return G.Selector(symbol_id=name)
        return G.Selector(qualified=name) if "::" in name else G.Selector(name=name, file=file)

    def find_definition(self, name: str, file: str | None = None) -> DataFrame:
        s = self._table("symbols").filter(F.col("name") == name)
        s = s if file is None else s.filter(F.col("file") == file)
        f = self._table("files").select("path", "content")
        text = T.bytes_of(F.col("content"), F.col("range_start"), F.col("range_end"))
        j = s.join(f, F.col("file") == F.col("path"))
        return j.select("symbol_id", "file", "kind", "signature", T.line_of_byte(F.col("content"), F.col("range_start")).alias("start_line"), T.line_of_byte(F.col("content"), F.col("range_end") - 1).alias("end_line"), T.truncate_lines(text).alias("text"), "range_start", "range_end", (T.count_lines(text) > T.MAX_SPAN_LINES).alias("truncated")).orderBy("file", "start_line")

    def find_references(self, name: str, file: str | None = None, max_results: int = 100) -> DataFrame:
        hits = G.incoming(self._table("edges"), self._selector(name, file), "References")
        f = self._table("files").select("path", "content")
        line = T.line_of_byte(F.col("content"), F.coalesce("from_start", F.lit(0).cast("long")))
        return hits.join(f, F.col("from_file") == F.col("path"), "left").select("from_id", F.col("from_file").alias("file"), line.alias("line"), "confidence").orderBy("file", "line", "from_id").limit(clamp(max_results, 1, 1000) + 1)

    def get_callers(self, name: str, file: str | None = None) -> DataFrame:
        return G.callers(self._table("edges"), self._selector(name, file)).orderBy("file", "name")

    def get_callees(self, name: str, file: str | None = None) -> DataFrame:
        return G.callees(self._table("edges"), self._selector(name, file)).orderBy("file", "name")

    def get_imports(self, file: str) -> dict[str, DataFrame]:
        e = self._table("edges")
        return {"imports": G.imports_of(e, file).orderBy("file"), "imported_by": G.imported_by(e, file).orderBy("file")}

    def get_symbol_outline(self, file: str) -> DataFrame:
        return G.outline(self._table("symbols").filter(F.col("file") == file)).orderBy("path", "symbol_id")

    # --- locating and reading

    def locate(self, path: str | None = None, query: str | None = None, file: str | None = None, max_results: int = 5, max_bytes: int = 4096) -> DataFrame:
        check_locate(query, path, file)
        most = clamp(max_results, 1, 10)
        nodes, files = self._table("nodes"), self._table("files")
        if self.current is not None:
            nodes, files = L.fresh_nodes(nodes, self.current, files), self.current
        every = nodes
        if file is not None:
            nodes = nodes.join(files.filter(F.col("path") == file).select("file_id"), "file_id", "left_semi")
        plan = locate_plan(query, path, self.vectors is not None)
        if plan == "structural_path":
            return L.spans(L.resolve_locator(nodes, files, path, most), files, max_bytes, every).orderBy(F.desc("score"), "file", "byte_start")
        placed = self._chunks().join(files.select("file_id", F.col("path").alias("_p")), F.col("file") == F.col("_p")).drop("_p")
        if plan == "structural_search":
            ids = L.structural_hits(nodes, query, most, index=self._node_index(file))
            return L.spans(nodes.join(F.broadcast(ids), "id"), files, max_bytes, every).orderBy(F.desc("score"), "file", "byte_start")
        if plan == "scoped_semantic":
            return L.scoped(placed, self.vectors, L.resolve_locator(nodes, files, parse_locator(path), 1), query, self._vector(query), most)
        hits = L.hybrid_locate(nodes, placed, self.vectors, query, self._vector(query), most, self._node_index(file), self.indexes.get("chunks") if file is None else None)
        return L.spans(L.hit_nodes(hits, nodes), files, max_bytes, every).orderBy(F.desc("score"), "file", "byte_start")

    def _node_index(self, file: str | None) -> FT.FullText | None:
        """The stored index, unless the nodes asked are others than those indexed."""
        return self.indexes.get("nodes") if self.current is None and file is None else None

    def read_file_range(self, file: str, start: int, end: int, most: int = 16_384) -> DataFrame:
        stop = min(end, start + most)
        f = self._table("files").filter((F.col("path") == file) & safe_path(F.col("path")))
        return f.select(T.bytes_of(F.col("content"), F.lit(start), F.lit(stop)).alias("text"), F.lit(end - start > most).alias("truncated"))

    def deliver(self, rows: DataFrame, most: int = 1_000) -> list[dict]:
        """The rows of a tool's result (at most `most`, as every tool limits its own) with a `handle` for each truncated span, which expand_span takes."""
        out = []
        for r in rows.limit(most).collect():
            d = r.asDict()
            start, end = d.get("byte_start", d.get("range_start")), d.get("byte_end", d.get("range_end"))
            d["handle"] = self.handles.issue(d["file"], start, end) if d.get("truncated") and d.get("file") is not None and None not in (start, end) else None
            out.append(d)
        return out

    def expand_span(self, handle: str) -> DataFrame:
        file, start, end = self.handles.get(handle)
        return self._table("files").filter(F.col("path") == file).select(F.col("path").alias("file"), T.bytes_of(F.col("content"), F.lit(start), F.lit(end)).alias("text"))

    def locate_smart(self, query: str, model: Callable[[list[dict]], dict], max_steps: int = 6, budget: int = 20_000) -> list[str]:
        """A loop in which `model` asks for sub-tools or ends with node ids; only ids that a tool has shown count.

        model takes the messages so far and gives {"tool": name, "args": {...}} or {"final": [ids]}. Tokens are
        estimated as a quarter of the bytes. No network model is included; tests use a scripted one.
        """
        overview = lambda depth=3: self.get_repo_overview(depth)["tree"]
        tools = {"locate": self.locate, "read_file_range": self.read_file_range, "get_symbol_outline": self.get_symbol_outline, "get_repo_overview": overview}
        messages, seen, used = [{"role": "user", "content": query}], set(), len(query.encode()) // 4
        for _ in range(max_steps):
            step = model(messages)
            if "final" in step:
                return [i for i in step["final"] if i in seen]
            if step.get("tool") not in tools:
                raise InvalidRequest(f"no such tool: {step.get('tool')}")
            rows = [r.asDict() for r in tools[step["tool"]](**step.get("args", {})).limit(10).collect()]
            seen |= {r["node_id"] for r in rows if r.get("node_id")}
            used += -(-len(str(rows).encode()) // 4)
            if used > budget:
                break
            messages.append({"role": "tool", "content": rows})
        return []

    # --- ask, pack, memories

    def ask(self, query: str, mode: str = "auto", limit: int = 8, model: Callable | None = None) -> tuple[str, DataFrame]:
        """(strategy used, rows): definition, locate or semantic; an empty definition and a smart mode without model fall back to semantic."""
        strategy = choose_strategy(query, mode)
        if strategy == "definition":
            rows = self.find_definition(query.strip()).limit(limit)
            if not rows.isEmpty():
                return "definition", rows
        elif strategy == "locate":
            return "locate", self.locate(path=query, max_results=limit)
        elif strategy == "smart" and model is not None:
            ids = self.locate_smart(query, model)
            return "smart", self.spark.createDataFrame([(i,) for i in ids], "node_id string")
        return "semantic", self.search_semantic(query, limit)

    def pack_repo(self, budget: int | None = None, style: str = "xml", paths: list[str] | None = None, symbol: str | None = None, include_tests: bool = False, include_docs: bool = False, name: str = "repository", now: datetime.datetime | None = None) -> P.PackResult:
        files = P.scope_files(self._table("files"), self.tables.get("edges"), self.tables.get("symbols"), paths, symbol)
        counts = P.in_edge_counts(self.tables["edges"]) if "edges" in self.tables else None
        budget = self.config.pack.default_token_budget if budget is None else budget
        return P.pack(files, now or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), budget, style, name, counts, include_tests, include_docs)

    def _memories(self) -> DataFrame:
        if self.memories is None:
            self.memories = self.spark.createDataFrame([], "id string, scope string, content string, metadata map<string,string>, created_at timestamp, updated_at timestamp")
        return self.memories

    def memory_save(self, scope: str, content: str, metadata: dict[str, str] | None = None, now: datetime.datetime | None = None) -> DataFrame:
        """uuid() is drawn anew whenever a plan runs, so the row is fixed by a checkpoint before it joins the store."""
        one = M.save(self._memories().limit(0), scope, content, metadata, now or datetime.datetime.now())
        self._keep_memories(self._memories().unionByName(cut(one)))
        return self.memories

    def _keep_memories(self, memories: DataFrame) -> None:
        self.memories = memories
        if self.store is not None:
            self.store.write("memories", memories, max(self.store.versions("memories"), default=0) + 1)
            self.memories = self.store.read("memories")
            self.store.drop_before("memories", 2)

    def memory_search(self, query: str, scope: str | None = None, k: int = 10) -> DataFrame:
        return M.search(self._memories(), query, scope, k)

    def memory_list(self, scope: str | None = None) -> DataFrame:
        return M.listing(self._memories(), scope)

    def memory_forget(self, memory_id: str) -> DataFrame:
        self._keep_memories(M.forget(self._memories(), memory_id))
        return self.memories
