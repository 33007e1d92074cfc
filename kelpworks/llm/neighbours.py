"""Most similar vectors for every vector, by robust-pruned directed graphs.

Vectors of one direction (copies, and copies of another length) are one class, represented by the
smallest id, so a group of any size is one vector of the index. A model of more vectors than a shard holds is cut into
cells around centres, which are fitted on a sample of about `SAMPLE` vectors; every vector is counted and placed. Runs of
neighbouring cells make the shards, and a cell that is larger than a shard is spread over several by a hash.

For each shard a directed graph is built: a greedy search over the graph so far proposes neighbours for a batch of
vectors, pruning keeps a neighbour only if no kept one is nearer to it by the factor alpha, edges are
made mutual and pruned again. Then every vector searches, with a beam, the shards that hold its `PROBES` nearest cells; the
found candidates and the first ids of their classes get exact cosines, and each vector keeps the best of all its shards. So
the work grows with the vectors, not with vectors x shards, and each shard's index is sent to its queries about once.

Defined cases: null, empty, too short, too long, all-zero embeddings and those with null, NaN or
infinite elements are not usable and have no neighbours; repeated rows are one vector; equal cosines
(to 9 places) go by the smaller id; of a class of more than k + 1 vectors, which differ from each other only
as rounding does, vectors outside it are given those with the smallest ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut

SHARD = 32_768
DEGREE = 24
BEAM = 64
BUILD_BEAM = 40
ALPHA = 1.2
ENTRIES = 48
#: Cells of a full shard, those that a vector's search goes to, and vectors that it goes on to reach.
CELLS, PROBES, REACH = 64, 6, 512
#: Vectors of a model that its centres are fitted on, and the most centres of a model.
SAMPLE, MOST_CELLS = 32_768, 4_096
#: Models of several shards whose centres are broadcast, and the numbers in all those centres together; beyond that, shards are larger runs of fewer cells.
MODELS, CENTRE_FLOATS = 100_000, 1 << 24
#: Bytes of vectors that meet an index in one task.
BLOCK = 1 << 27
MOST_PARTS = 20_000
#: Unit vectors in one cell differ by up to CELL, those of two linked cells by NOISE in each of MARKS projections: float
#: rounding of a rescaled vector moves it by 1.2e-7 at most, and at 3e-5 the cosine is still 1 to 9 places.
CELL, NOISE, MARKS, BIN = 4e-6, 2.5e-7, 6, 1e-4


# --- the graph of one shard ---------------------------------------------------------------------


def beam_search(unit: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int = BEAM, starts: np.ndarray | None = None, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the beam of each query, best first; -1 pads. All queries advance together.

    graph holds -1 where a vector has fewer neighbours. starts adds one entry per query (-1: none).
    """
    b, n = len(queries), len(unit)
    first = np.broadcast_to(entries, (b, len(entries)))
    if starts is not None:
        first = np.concatenate([np.where(np.isin(starts, entries), -1, starts)[:, None], first], axis=1)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(b)[:, None]
    ids = first.copy()
    sims = np.matmul(unit[ids], queries[:, :, None])[:, :, 0]
    sims[ids < 0] = -np.inf
    seen[rows, np.where(ids < 0, n, ids)] = True
    if ids.shape[1] > beam:
        top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    elif ids.shape[1] < beam:
        pad = beam - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
    open_ = np.isfinite(sims)
    out_ids, out_sims = np.full((b, beam), -1, ids.dtype), np.full((b, beam), -np.inf, np.float32)
    live = np.arange(b)
    while len(live):
        masked = np.where(open_, sims, -np.inf)
        w = min(width, beam)
        pick = np.argpartition(-masked, w - 1, axis=1)[:, :w]
        good = np.isfinite(np.take_along_axis(masked, pick, 1))
        done = ~good.any(axis=1)
        if done.any():
            out_ids[live[done]], out_sims[live[done]] = ids[done], sims[done]
            keep = ~done
            live, ids, sims, open_, pick, good, seen, queries = live[keep], ids[keep], sims[keep], open_[keep], pick[keep], good[keep], seen[keep], queries[keep]
            if not len(live):
                break
        np.put_along_axis(open_, pick, False, 1)
        rows = np.arange(len(live))[:, None]
        cur = np.where(good, np.take_along_axis(ids, pick, 1), -1)
        near = np.where(cur[:, :, None] < 0, -1, graph[cur]).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)  # two expanded vectors may share a neighbour
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[rows, near], n, near)
        seen[rows, near] = True
        fresh = near < n
        most = int(fresh.sum(axis=1).max())
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        s = np.matmul(unit[np.where(fresh, near, 0)], queries[:, :, None])[:, :, 0]
        s[~fresh] = -np.inf
        all_ids = np.concatenate([ids, np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims, s], axis=1)
        all_open = np.concatenate([open_, fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids, sims, open_ = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_open))
    order = np.argsort(-out_sims, axis=1, kind="stable")
    return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_sims, order, 1)


def robust_prune(unit: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point, at most `degree` of its nearest 2 * degree candidates (-1: none), nearest first and spread in direction."""
    own = np.where(cand == points[:, None], -1, cand)
    own.sort(axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    dist = 2 - 2 * np.matmul(unit[own], unit[points][:, :, None])[:, :, 0]
    dist[own < 0] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * degree]
    own, dist = np.take_along_axis(own, order, 1), np.take_along_axis(dist, order, 1)
    vec = unit[own]
    between = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    alive = own >= 0
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        if not alive.any():
            break
        star = alive.argmax(axis=1)
        some = alive[rows, star]
        out[some, k] = own[rows[some], star[some]]
        alive &= ~((alpha * alpha * between[rows, star] <= dist) & some[:, None])
        alive[rows, star] = False
    return out


def _add_back_edges(unit: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    src = np.repeat(points, degree)
    dst = graph[points].reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    while len(dst):  # rounds of at most `degree` new edges per target
        begin = np.r_[0, np.flatnonzero(dst[1:] != dst[:-1]) + 1]
        place = np.arange(len(dst)) - np.repeat(begin, np.diff(np.r_[begin, len(dst)]))
        now = place < degree
        target, group = np.unique(dst[now], return_inverse=True)
        extra = np.full((len(target), degree), -1, np.int32)
        extra[group, place[now]] = src[now]
        for a in range(0, len(target), 1024):
            t, e = target[a : a + 1024], extra[a : a + 1024]
            both = np.concatenate([graph[t], e], axis=1)
            uniq = np.sort(both, axis=1)
            room = ((uniq >= 0) & np.c_[np.ones(len(t), bool), uniq[:, 1:] != uniq[:, :-1]]).sum(axis=1) <= degree
            if room.any():  # all fit: no pruning
                r = uniq[room]
                r[:, 1:][r[:, 1:] == r[:, :-1]] = -1
                graph[t[room]] = -np.sort(-r, axis=1)[:, :degree]
            if not room.all():
                graph[t[~room]] = robust_prune(unit, t[~room], both[~room], degree, alpha)
        src, dst = src[~now], dst[~now]


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, passes: int = 1, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over unit vectors. The order of the rows must not depend on their content."""
    n = len(unit)
    graph = np.full((n, degree), -1, np.int32)
    if n == 0:
        return graph, np.zeros(0, np.int32)
    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int32))
    centre = np.int32((unit @ unit.mean(axis=0)).argmax())
    entries = np.union1d(entries, [centre]).astype(np.int32)
    order = np.concatenate([entries, np.setdiff1d(np.arange(n, dtype=np.int32), entries)]).astype(np.int32)
    for p in range(passes):
        at, size = 0, max(len(entries), 64) if p == 0 else batch
        while at < n:
            pts = order[at : at + size]
            inside = unit[pts] @ unit[pts].T  # vectors of one batch cannot meet in the graph yet
            k = min(len(pts), 16)
            mates = pts[np.argpartition(-inside, k - 1, axis=1)[:, :k]]
            cands = [mates, graph[pts]]
            if at or p:
                cands.append(beam_search(unit, graph, entries, unit[pts], beam, starts=pts if p else None)[0])
            graph[pts] = robust_prune(unit, pts, np.concatenate(cands, axis=1).astype(np.int32), degree, alpha)
            _add_back_edges(unit, graph, pts, degree, alpha)
            at += len(pts)
            if p == 0:
                size = min(batch, 2 * size)
    return graph, entries


# --- the collection -----------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """`model, vec_id, embedding` of the embeddings that can be compared, one row per vec_id."""
    ok = "vec_id IS NOT NULL AND model IS NOT NULL AND embedding IS NOT NULL AND dimension > 0 AND size(embedding) = dimension AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity')) AND exists(embedding, x -> x <> 0)"
    return vectors.filter(ok).select("model", "vec_id", "embedding").dropDuplicates(["vec_id"])


def _pack(**arrays) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _unit(raw: np.ndarray, kind=np.float32) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large elements under- or overflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _direction(embedding: pd.Series) -> pd.DataFrame:
    """The cell of a grid over unit vectors, and projections on fixed directions."""
    cells, marks = np.empty(len(embedding), object), np.empty(len(embedding), object)
    sizes = embedding.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        unit = _unit(np.stack(embedding.iloc[at].to_numpy()), np.float64)
        axes = np.random.default_rng(int(size)).normal(size=(size, MARKS))
        grid = np.rint(unit * (size**0.5 / CELL)).astype(np.int64)
        cells[at] = [xxhash.xxh128_hexdigest(g.tobytes()) for g in grid]
        for i, m in zip(at, unit @ (axes / np.linalg.norm(axes, axis=0))):
            marks[i] = m
    return pd.DataFrame({"cell": cells, "marks": marks})


def with_cells(rows: DataFrame) -> DataFrame:
    """Adds `cell`, which most vectors of one direction and model share, and `marks`."""
    d = rows.withColumn("d", F.pandas_udf(_direction, "cell string, marks array<double>")("embedding"))
    return d.select(*rows.columns, F.concat_ws(":", F.xxhash64("model"), "d.cell").alias("cell"), F.col("d.marks").alias("marks"))


def linked_cells(cells: DataFrame) -> DataFrame:
    """`cell, class`: cells (`model, vec_id, cell, marks`) which rounding parted have one class, the smallest vec_id.

    A cell's first vector meets others only in its bins of two of the projections.
    """
    own = lambda i: F.floor(F.col("marks")[i] / BIN)
    around = lambda i: F.explode(F.array_distinct(F.array(F.floor((F.col("marks")[i] - NOISE) / BIN), F.floor((F.col("marks")[i] + NOISE) / BIN))))
    a = cells.select(F.col("model").alias("a_model"), F.col("vec_id").alias("first"), F.col("marks").alias("a_marks"), "marks", around(0).alias("a0")).withColumn("a1", around(1)).drop("marks")
    b = cells.select("model", "vec_id", "marks", own(0).alias("b0"), own(1).alias("b1"))
    close = [F.abs(F.col("marks")[i] - F.col("a_marks")[i]) <= NOISE for i in range(MARKS)]
    met = a.join(b, (F.col("a_model") == F.col("model")) & (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))).filter(F.col("first") < F.col("vec_id"))
    for c in close:
        met = met.filter(c)
    links = met.groupBy("vec_id").agg(F.min("first").alias("first"))
    return cells.select("vec_id", "cell").join(links, "vec_id", "left").select("cell", F.coalesce("first", "vec_id").alias("class"))


class Routes:
    """Where the vectors of the models of several shards lie: centres of cells, the first shard of each cell, its shards and size."""

    def __init__(self):
        self.models: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def shards(self, model: str) -> int:
        if model not in self.models:
            return 1
        _, first, subs, _ = self.models[model]
        return int((first + subs).max())

    def place(self, model: str, unit: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home shard of each vector, the shards that its search goes to)."""
        if model not in self.models:
            return np.zeros(len(unit), np.int32), [np.zeros(1, np.int32)] * len(unit)
        centres, first, subs, sizes = self.models[model]
        near = unit @ centres.T
        most = min(len(centres), 8 * PROBES)
        top = np.argpartition(-near, most - 1, axis=1)[:, :most]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        home = top[:, 0]
        spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % subs[home]
        reached = np.cumsum(sizes[top], axis=1)
        count = np.maximum(PROBES, 1 + (reached < REACH).sum(axis=1))
        visit = [np.unique(np.concatenate([np.arange(first[c], first[c] + subs[c]) for c in row[:n]])).astype(np.int32) for row, n in zip(top, count)]
        return (first[home] + spread).astype(np.int32), visit


def fit_centres(unit: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of spherical k-means."""
    rng = np.random.default_rng(len(unit))
    centres = unit[np.sort(rng.choice(len(unit), min(cells, len(unit)), replace=False))].copy()
    for _ in range(rounds):
        of = np.concatenate([(unit[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres).astype(np.float32)
    return centres


def routes_of(reps: DataFrame, shard_size: int = SHARD) -> Routes:
    """The routes of the models of `model, rep, embedding` that need more than one shard.

    The driver gets one row per such model and cell: at most CENTRE_FLOATS numbers, whatever the vectors.
    """
    routes = Routes()
    big = reps.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).filter(F.col("n") > shard_size)
    found = big.limit(MODELS + 1).collect()
    if not found:
        return routes
    if len(found) > MODELS:
        raise ValueError(f"more than {MODELS} models of more than {shard_size} vectors")
    wish = {r["model"]: max(2, min(MOST_CELLS, r["n"] * CELLS // shard_size)) for r in found}
    part = min(1.0, CENTRE_FLOATS / sum(wish[r["model"]] * r["dim"] for r in found))
    plan = reps.sparkSession.createDataFrame([(r["model"], max(2, int(wish[r["model"]] * part)), max(1, r["n"] // SAMPLE)) for r in found], "s_model string, cells int, one_in long")
    sample = reps.join(F.broadcast(plan), F.col("model") == F.col("s_model")).filter(F.pmod(F.xxhash64("rep", F.lit(17)), F.col("one_in")) == 0).select("model", "cells", "rep", "embedding")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        centres = fit_centres(_unit(np.stack(pdf["embedding"].to_numpy())), int(pdf["cells"].iloc[0]))
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "dim": [centres.shape[1]], "centres": [centres.tobytes()]})

    for r in sample.groupBy("model").applyInPandas(fit, "model string, dim int, centres binary").collect():
        centres = np.frombuffer(bytes(r["centres"]), np.float32).reshape(-1, r["dim"])
        none = np.zeros(len(centres), np.int64)
        routes.models[r["model"]] = (centres, np.arange(len(centres)), none + 1, none + REACH)
    shared = reps.sparkSession.sparkContext.broadcast(routes)
    cell_of = F.pandas_udf(lambda model, rep, embedding: _routed(shared.value, model, rep, embedding)["home"], "int")
    within = reps.join(F.broadcast(plan.select("s_model")), F.col("model") == F.col("s_model"))
    sizes = {m: np.zeros(len(r[0]), np.int64) for m, r in routes.models.items()}
    for r in within.groupBy("model", cell_of("model", "rep", "embedding").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["model"]][r["cell"]] = r["n"]
    routes.models = {m: (r[0], *_runs(r[0], sizes[m], shard_size), sizes[m]) for m, r in routes.models.items()}
    shared.unpersist()
    return routes


def _runs(centres: np.ndarray, sizes: np.ndarray, shard_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: cells in a chain of nearest centres, cut into runs of equal weight."""
    left, chain = np.ones(len(centres), bool), [int(sizes.argmax())]
    left[chain[0]] = False
    while left.any():
        chain.append(int(np.where(left, centres @ centres[chain[-1]], -np.inf).argmax()))
        left[chain[-1]] = False
    even = sizes.sum() / -(-int(sizes.sum()) // shard_size)  # as full as the number of shards allows
    first, subs, shard, fill = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0, 0
    for c in chain:
        if fill and fill + sizes[c] > 1.1 * even:
            shard, fill = shard + 1, 0
        first[c], subs[c] = shard, max(1, -(-int(sizes[c]) // shard_size))
        fill += sizes[c]
        if subs[c] > 1:
            shard, fill = shard + int(subs[c]), 0
    # Shards are numbered without gaps.
    used = np.unique(np.concatenate([np.arange(f, f + n) for f, n in zip(first, subs)]))
    return np.searchsorted(used, first), subs


def _routed(routes: Routes, model: pd.Series, rep: pd.Series, embedding: pd.Series) -> pd.DataFrame:
    home, visit = np.zeros(len(model), np.int32), np.empty(len(model), object)
    for m in model.unique():
        at = np.flatnonzero(model.to_numpy() == m)
        h, v = routes.place(m, _unit(np.stack(embedding.iloc[at].to_numpy())), rep.iloc[at].to_numpy(np.int64))
        home[at] = h
        for i, x in zip(at, v):
            visit[i] = x
    return pd.DataFrame({"home": home, "visit": visit})


def shard_graphs(placed: DataFrame, parts: int, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """`model, shard, vectors binary, graph binary`, written to the shared folder once.

    placed has `model, shard, rep, vec_id, embedding`; the graph is over the reps, their other vectors lie beside it.
    parts is a number of tasks in which few shards meet: a shard is much work and few bytes.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        more, pdf = pdf[pdf["vec_id"] != pdf["rep"]], pdf[pdf["vec_id"] == pdf["rep"]]
        pdf = pdf.iloc[np.random.default_rng(len(pdf)).permutation(len(pdf))]
        ids, raw = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
        graph, entries = build_graph(_unit(raw), degree, beam, alpha)
        more_of = pd.Series(np.arange(len(ids)), ids)[more["rep"]].to_numpy(np.int32)
        more_raw = np.stack(more["embedding"].to_numpy()).astype(np.float32) if len(more) else raw[:0]
        row = (pdf["model"].iloc[0], int(pdf["shard"].iloc[0]), _pack(ids=ids, raw=raw, more_ids=more["vec_id"].to_numpy(np.int64), more_raw=more_raw, more_of=more_of), _pack(graph=graph, entries=entries))
        return pd.DataFrame([row], columns=["model", "shard", "vectors", "graph"])

    return cut(placed.repartition(parts, "model", "shard").groupBy("model", "shard").applyInPandas(build, "model string, shard int, vectors binary, graph binary"))


def search_shards(shards: DataFrame, queries: DataFrame, parts: int, k: int, min_cosine: float = -2.0, beam: int = BEAM, shard_size: int = SHARD) -> DataFrame:
    """`query, found, cosine`: of each shard that a query (`model, visit, rep, vec_id, embedding`) visits its best k, without itself.

    Pairs below min_cosine are left out after the k were chosen. The queries of a shard meet it in blocks of about BLOCK bytes.
    """
    none = pd.DataFrame({"query": pd.Series(dtype="int64"), "found": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        x, g = (np.load(io.BytesIO(v)) for v in (right["vectors"].iloc[0], right["graph"].iloc[0]))
        graph, entries, ids = g["graph"], g["entries"], x["ids"]
        unit, exact = _unit(x["raw"]), _unit(x["raw"], np.float64)
        qid, rep, qraw = left["vec_id"].to_numpy(np.int64), left["rep"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()).astype(np.float32)
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[order], rep), len(ids) - 1)
        known = np.where(ids[order][at] == rep, order[at], -1).astype(np.int32)  # where the query itself lies, if here
        more, more_ids = _unit(x["more_raw"], np.float64) if len(x["more_ids"]) else exact[:0], x["more_ids"]
        by = np.argsort(x["more_of"], kind="stable")
        begin, count = np.searchsorted(x["more_of"][by], np.arange(len(ids))), np.bincount(x["more_of"], minlength=len(ids))
        out = []
        for a in range(0, len(qid), 1024):
            mine, raw = qid[a : a + 1024], qraw[a : a + 1024]
            near, _ = beam_search(unit, graph, entries, _unit(raw), beam, known[a : a + 1024])
            near = near[:, : max(4 * k, 24)]
            unit_q = _unit(raw, np.float64)
            cos = np.matmul(exact[near], unit_q[:, :, None])[:, :, 0].clip(-1, 1)
            r, c = np.nonzero(near >= 0)
            found, cos = ids[near[r, c]], cos[r, c]
            n = count[near[r, c]]
            if n.any():  # the other vectors of the found classes
                m_r, m = np.repeat(r, n), by[np.repeat(begin[near[r, c]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                m_cos = [np.einsum("ij,ij->i", more[m[i : i + 16384]], unit_q[m_r[i : i + 16384]]).clip(-1, 1) for i in range(0, len(m), 16384)]
                r, found, cos = np.r_[r, m_r], np.r_[found, more_ids[m]], np.concatenate([cos, *m_cos])
            keep = (found != mine[r]) & (cos >= max(min_cosine, -1.5))
            r, found, cos = r[keep], found[keep], cos[keep]
            order_ = np.lexsort((found, -np.round(cos, 9), r))
            r, found, cos = r[order_], found[order_], cos[order_]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"query": mine[r[best]], "found": found[best], "cosine": cos[best]}))
        return pd.concat(out)

    blocks = F.greatest(F.lit(1), F.ceil(F.size("embedding") * 4 * shard_size * 4 / BLOCK)).cast("int")
    asked = queries.select(F.col("model").alias("q_model"), F.explode("visit").alias("b"), F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), "vec_id", "rep", "embedding")
    some = queries.groupBy(F.col("model").alias("b_model")).agg(F.max(blocks).alias("blocks"))  # one row per model
    indexes = shards.join(some, F.col("model") == F.col("b_model")).select("model", F.col("shard").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vectors", "graph")
    left = asked.repartition(parts, "q_model", "b", "block").groupBy("q_model", "b", "block")
    right = indexes.repartition(parts, "model", "b", "block").groupBy("model", "b", "block")
    return left.cogroup(right).applyInPandas(run, "query long, found long, cosine double")


def most_similar(vectors: DataFrame, k: int = 5, min_cosine: float = -2.0, every: int = 1, shard_size: int = SHARD, beam: int = BEAM) -> DataFrame:
    """`vec_id, rank, other, cosine`: the k most similar vectors of the same model, of those at min_cosine or more."""
    rows = with_cells(usable(vectors))
    # The k + 1 smallest ids of each cell; the limit is applied before the shuffle, so a huge cell stays small.
    in_cell = Window.partitionBy("cell").orderBy("vec_id")
    starts = cut(rows.withColumn("n", F.row_number().over(in_cell)).filter(f"n <= {k + 1}"))
    classes = cut(linked_cells(starts.filter("n = 1").select("model", "vec_id", "cell", "marks")))
    in_class = Window.partitionBy("class").orderBy("vec_id")
    ranked = starts.select("model", "vec_id", "embedding", "cell").join(classes, "cell").withColumn("n", F.row_number().over(in_class)).filter(f"n <= {k + 1}")
    firsts = cut(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("class"))).select("model", "class", "rep", "n", "vec_id", "embedding"))
    # Every first vector has a home, its class's, and the shards that its search goes to.
    routes = routes_of(firsts.filter("vec_id = rep").select("model", "rep", "embedding"), shard_size)
    if routes.models:
        shared = vectors.sparkSession.sparkContext.broadcast(routes)
        route = F.pandas_udf(lambda model, rep, embedding: _routed(shared.value, model, rep, embedding), "home int, visit array<int>")
        routed = cut(firsts.withColumn("r", route("model", "rep", "embedding")).select(*firsts.columns, F.col("r.home").alias("home"), F.col("r.visit").alias("visit")))
        homes = routed.filter("vec_id = rep").select(F.col("rep").alias("h_rep"), F.col("home").alias("shard"))
        own = routed.filter("vec_id = rep").withColumn("shard", F.col("home"))
        placed = own.unionByName(routed.filter("vec_id <> rep").join(homes, F.col("rep") == F.col("h_rep")).drop("h_rep"))
    else:
        routed = firsts.withColumn("visit", F.array(F.lit(0)))
        placed = firsts.withColumn("shard", F.lit(0))
    parts = min(MOST_PARTS, 4 * (firsts.select("model").distinct().count() + sum(map(routes.shards, routes.models))))
    shards = shard_graphs(placed.select("model", "shard", "rep", "vec_id", "embedding"), max(1, parts))
    full = firsts.filter(f"n = {k + 1}").select("class", "rep")
    # Asked are the wanted vectors, and the first of each class that is larger than what is listed of it.
    asking = routed if every == 1 else routed.join(full.select(F.col("rep").alias("f_rep")), F.col("vec_id") == F.col("f_rep"), "left").filter((F.col("vec_id") % every == 0) | F.col("f_rep").isNotNull()).drop("f_rep")
    hits = search_shards(shards, asking.select("model", "visit", "rep", "vec_id", "embedding"), max(1, parts), k + 1, min_cosine, beam, shard_size)
    # Candidates of a first vector: those found in each shard and the first ids of its class.
    members = firsts.select("class", F.col("vec_id").alias("member"))
    own = firsts.select("class", F.col("vec_id").alias("query")).join(members, "class").filter("query <> member").select("query", "member", F.lit(1.0).alias("cosine"))
    near = hits.select("query", F.col("found").alias("member"), F.round("cosine", 9).alias("cosine")).unionByName(own).groupBy("query", "member").agg(F.max("cosine").alias("cosine"))
    pick = Window.partitionBy("query").orderBy(F.desc("cosine"), "member")
    best = cut(near.withColumn("n", F.row_number().over(pick)).filter(f"n <= {k}"))
    mine = best.filter(F.col("query") % every == 0).select(F.col("query").alias("vec_id"), F.col("n").alias("rank"), F.col("member").alias("other"), "cosine")
    # The others are in classes of more than k + 1: theirs are the class's first ids, or those found for the first vector with cosine 1, too.
    ones = members.join(full, "class").select("class", "member").unionByName(full.join(best.filter("cosine = 1"), F.col("query") == F.col("rep")).select("class", "member")).distinct()
    lists = ones.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("member")), 1, k).alias("near"))
    known = members.join(full, "class").groupBy("class").agg(F.collect_list("member").alias("firsts"))
    by_cell = classes.withColumnRenamed("cell", "at_cell").join(lists, "class").join(known, "class").select("at_cell", "near", "firsts")
    asked = rows.select("vec_id", "cell").filter(F.col("vec_id") % every == 0)
    joined = salted_join(asked, by_cell, "cell", "at_cell", spread_by="vec_id", how="inner").filter(~F.array_contains("firsts", F.col("vec_id")))
    rest = joined.select("vec_id", F.posexplode(F.slice(F.filter("near", lambda x: x != F.col("vec_id")), 1, k)).alias("p", "other")).select("vec_id", (F.col("p") + 1).alias("rank"), "other", F.lit(1.0).alias("cosine"))
    return mine.unionByName(rest).filter(F.col("cosine") >= min_cosine)


def close_pairs(similar: DataFrame) -> DataFrame:
    """`vec_a < vec_b`, once each, of the pairs of most_similar."""
    return similar.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
