"""Embedding near-dedup by hierarchical navigable small-world graphs, one for each shard of the vectors.

Equal vectors are one node with a count. Nodes are dealt to shards by hash; each shard's graph is built in one task, which writes it as a file of the shared folder, in
layers: a layer is a small-world graph over a prefix of the shard's nodes, each layer ``BRANCH`` times the one above it,
and the top one is small enough to be searched whole. Every node is then searched in every shard: nodes are also written as files, in blocks of about ``QUERIES``, and a
task opens one graph and ``RUN`` blocks, so neither graphs nor queries are shuffled. Files of lost or repeated tasks are never opened, as the rows that name them are lost too. A search descends the layers with a beam and, where it meets
links, follows them through the graph until no further link is next to one, so a large group is found whole. An audit in
each task compares a sample of queries, and of noisy copies of the shard's own vectors just above the threshold, with a
search of the whole shard, and doubles the beam until ``RECALL`` of the links are found, on the mean over the queries that have any, so no
large group speaks for the rest. A query that meets a crowd of links is compared with the whole shard. Where even a beam as large as the shard does not reach that, the shard is searched whole by products. Cosines of links are verified in double precision. Links are counted, and united inside the task before components are found,
so a group of copies sends on as many rows as it has members.

The number of shards is the larger of ``SHARDS`` and what keeps a shard under ``SHARD_BYTES``. Searching every shard makes
the cost of the method rows times shards; below ``SHARDS * SHARD_BYTES`` of vectors it is in proportion to the rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither do
vectors of different lengths; a row with a null vec_id links with nothing and has a null component_id. Rows with equal
vec_id and equal vector are one vector; rows with equal vec_id and different vectors are different ones. Extra columns
are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mix64, new_path, written
from .files import make_folder, open_input, open_output

LEAST, RECALL, SHARDS, SHARD_BYTES = 0.95, 0.995, 4, 32_000_000
DEGREE, BRANCH, TOP, BEAM, BUILD_BEAM, BATCH, QUERIES, RUN, AUDIT = 16, 8, 32, 16, 32, 512, 4096, 4, 64
#: So many links in one shard are a crowd.
CROWD = 2 * DEGREE
#: Links that a step of searches holds, about.
STEP_LINKS = 4_000_000
_SLACK = 1e-3  # of float32 cosines against the double ones


def _choose(sims: np.ndarray, pairs: np.ndarray, degree: int) -> np.ndarray:
    """Which candidates (columns, best first) become neighbours: those nearer to the node than to any chosen one, then the best of the rest."""
    n, c = sims.shape
    chosen = np.zeros((n, c), bool)
    closest = np.full((n, c), -2.0, np.float32)  # of each candidate to the chosen ones
    count = np.zeros(n, np.int64)
    for k in range(c):
        take = (sims[:, k] > -2) & (closest[:, k] < sims[:, k]) & (count < degree)
        chosen[take, k] = True
        count += take
        closest[take] = np.maximum(closest[take], pairs[take, k])
    rank = np.where(chosen, 0, 1) * 4.0 - sims
    rank[sims <= -2] = 9
    return np.argsort(rank, axis=1, kind="stable")[:, :degree]


class Graph:
    """Layers of neighbour lists over unit vectors; nodes of upper layers come first."""

    def __init__(self, vectors: np.ndarray):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        sizes = [n]
        while sizes[-1] > TOP:
            sizes.append(sizes[-1] // BRANCH)
        self.top, self.layers = sizes[-1], []
        for size in reversed(sizes[:-1]):
            self._grow(size)

    def _grow(self, size: int) -> None:
        upper = len(self.layers)
        links = np.full((size, 2 * DEGREE), -1, np.int32)
        done = min(BATCH, size)
        self._link(links, np.arange(done), np.empty((done, 0), np.int64), np.empty((done, 0), np.float32))
        while done < size:
            new = np.arange(done, min(size, done + min(done, BATCH)))
            # Nodes of the layers above may not be in this one yet; the top layer's always are.
            entry = np.concatenate([self._entries(self.v[new], upper, BEAM), self._entries(self.v[new], 0, BEAM)], axis=1)
            entry[entry >= done] = -1
            ids, sims, _ = search(links, self.v, self.v[new], entry, BUILD_BEAM)
            self._link(links, new, ids, sims)
            done = int(new[-1]) + 1
        self.layers.append(links)

    def _entries(self, queries: np.ndarray, layers: int, beam: int) -> np.ndarray:
        """Where to enter the layer under the first ``layers`` ones."""
        sims = queries @ self.v[: self.top].T
        k = min(4, self.top)
        entry = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for links in self.layers[:layers]:
            entry = search(links, self.v, queries, entry, beam)[0][:, :4]
        return entry

    def _link(self, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Gives new nodes their neighbours among ``ids`` and each other, and those the way back."""
        own = self.v[new] @ self.v[new].T
        np.fill_diagonal(own, -2)
        k = min(BUILD_BEAM, len(new))
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, new[near]], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
        self._set(links, new, ids, sims, DEGREE)
        targets, sources = links[new].ravel(), np.repeat(new, links.shape[1])
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        order = np.lexsort((mix64(sources.astype(np.uint64)), targets))
        sources, targets = sources[order], targets[order]
        back, start, counts = np.unique(targets, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        place = np.arange(len(targets)) - np.repeat(start, counts)
        for low in range(0, width, DEGREE):  # all ways back, some at a time
            part = (place >= low) & (place < low + DEGREE)
            which = np.searchsorted(back, targets[part])
            fresh = np.full((len(back), DEGREE), -1, np.int64)
            fresh[which, place[part] - low] = sources[part]
            some = np.flatnonzero((fresh >= 0).any(axis=1))
            for at in range(0, len(some), BATCH):
                rows = back[some[at : at + BATCH]]
                ids = np.concatenate([links[rows].astype(np.int64), fresh[some[at : at + BATCH]]], axis=1)
                twice = (ids[:, None, : links.shape[1]] == ids[:, links.shape[1] :, None]).any(axis=2)
                ids[:, links.shape[1] :][twice] = -1
                sims = np.einsum("nkd,nd->nk", self.v[ids], self.v[rows])
                sims[ids < 0] = -2
                self._set(links, rows, ids, sims, links.shape[1])

    def _set(self, links: np.ndarray, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> None:
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(BUILD_BEAM, degree + DEGREE)]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        near = self.v[ids]
        chosen = _choose(sims, near @ near.transpose(0, 2, 1), degree)
        out = np.take_along_axis(ids, chosen, axis=1)
        out[np.take_along_axis(sims, chosen, axis=1) <= -2] = -1
        links[rows] = -1
        links[rows, : out.shape[1]] = out

    def links(self, queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node): all pairs found with a float32 cosine of about ``least`` or more; a beam as large as the graph compares all.

        Within a crowd, lists of neighbours do not lead everywhere, so a query that meets one is then compared with the whole shard, which costs little beside its links.
        """
        if not self.layers or beam >= len(self.v):
            return self._compared(queries, np.arange(len(queries)), least)
        entry = self._entries(queries, len(self.layers) - 1, beam)
        q, x = search(self.layers[-1], self.v, queries, entry, beam, least)[2]
        crowd = np.bincount(q, minlength=len(queries)) >= CROWD
        alone = ~crowd[q]
        return _joined([(q[alone], x[alone]), self._compared(queries, np.flatnonzero(crowd), least)])

    def _compared(self, queries: np.ndarray, which: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some queries with all nodes, by products of bounded size."""
        rows = max(1, 4_000_000 // max(len(self.v), 1))
        hits = []
        for at in range(0, len(which), rows):
            some = which[at : at + rows]
            q, x = np.nonzero(queries[some] @ self.v.T >= least)
            hits.append((some[q], x))
        return _joined(hits)


def search(links: np.ndarray, v: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, least: float = 2.0):
    """Best-first searches of many queries at once: ids and cosines of their beams, best first, and the pairs of ``least`` or more."""
    q, n = len(queries), len(links)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -2.0, np.float32)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def fresh(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Cosines of nodes that ``who`` has not seen (else -2); they count as seen now."""
        good = nodes >= 0
        good &= ~seen[who[:, None], nodes]
        w, at = np.nonzero(good)
        found = nodes[w, at]
        seen[who[w], found] = True
        out = np.full(nodes.shape, -2.0, np.float32)
        out[w, at] = np.einsum("kd,kd->k", v[found], queries[who[w]])
        close = out[w, at] >= least
        if close.any():
            hits.append((who[w[close]], found[close]))
        return out

    k = min(entry.shape[1], beam)
    entry = np.sort(entry, axis=1)[:, ::-1]
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
    entry = np.sort(entry, axis=1)[:, ::-1][:, :k]
    ids[:, :k], sims[:, :k] = entry, fresh(rows, entry)
    open_ = sims > -2
    active = rows
    while len(active):
        waiting = np.where(open_[active], sims[active], -3)
        best = waiting.argmax(axis=1)
        alive = waiting[np.arange(len(active)), best] > -2
        active, best = active[alive], best[alive]
        if not len(active):
            break
        open_[active, best] = False
        nodes = links[ids[active, best]].astype(np.int64)
        new = fresh(active, nodes)
        all_sims = np.concatenate([sims[active], new], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], nodes], axis=1), top, axis=1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new > -2], axis=1), top, axis=1)
    frontier = _joined(hits)
    while len(frontier[0]):  # links next to links
        hits, size, before = [], 4096, hits
        for at in range(0, len(frontier[0]), size):
            who, nodes = frontier[0][at : at + size], links[frontier[1][at : at + size]].astype(np.int64)
            pairs = np.unique(np.repeat(who, nodes.shape[1])[nodes.ravel() >= 0] * n + nodes.ravel()[nodes.ravel() >= 0])
            fresh(pairs // n, (pairs % n)[:, None])
        frontier = _joined(hits)
        hits = before + hits
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), _joined(hits)


def _joined(hits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def audited_beam(graph: Graph, queries: np.ndarray, least: float, seed: int = 11) -> int:
    """The beam at which searches find ``RECALL`` of each query's links on the mean; the size of the shard if none below it does."""
    n, d = graph.v.shape
    if not graph.layers:
        return BEAM
    draw = np.random.default_rng(seed)
    own = graph.v[draw.integers(0, n, AUDIT)]
    noise = draw.standard_normal((AUDIT, d)).astype(np.float32)
    noise -= (noise * own).sum(axis=1, keepdims=True) * own
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    cos = min(least + 0.005, 1.0)
    noisy = cos * own + math.sqrt(1 - cos * cos) * noise / np.where(norm > 0, norm, 1)
    sample = np.concatenate([queries[draw.integers(0, len(queries), AUDIT)], noisy])
    wanted = (sample @ graph.v.T >= least).sum(axis=1)
    some = wanted > 0
    beam = BEAM
    while beam < n and some.any():
        found = np.bincount(graph.links(sample, beam, least)[0], minlength=len(sample))
        if np.minimum(found[some] / wanted[some], 1).mean() >= RECALL:
            break
        beam *= 2
    return min(beam, n)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _saved(path: str, **arrays: np.ndarray) -> None:
    whole = io.BytesIO()
    np.savez(whole, **arrays)
    with open_output(path) as f:
        f.write(whole.getbuffer())


def _opened(path: str) -> dict[str, np.ndarray]:
    with open_input(path) as f:
        held = np.load(io.BytesIO(f.read()))
        return {k: held[k] for k in held.files}


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in pdf.vector])


def _built(folder: str):
    """Writes a shard's graph: its nodes in the order of their layers, their vectors and neighbour lists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(mix64(pdf.node.to_numpy().astype(np.uint64)), kind="stable")]
        vectors = _vectors(pdf)
        graph, path = Graph(_unit(vectors)), f"{folder}/{uuid.uuid4().hex}.npz"
        layers = {f"layer{k}": x for k, x in enumerate(graph.layers)}
        _saved(path, top=np.array(graph.top), nodes=pdf.node.to_numpy(), copies=pdf.copies.to_numpy(), vectors=vectors, **layers)
        return pd.DataFrame({"length": [pdf.length.iloc[0]], "graph": [path]})

    return run


def _each(part: str, write):
    """``write`` over the groups of equal length and ``part`` of a partition; vectors are dealt so that a partition holds one part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            for _, group in pd.concat(held).groupby(["length", part]):
                yield write(group)

    return run


def _blocked(folder: str):
    """Writes a block of query nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        _saved(path, nodes=pdf.node.to_numpy(), vectors=_vectors(pdf))
        return pd.DataFrame({"length": [pdf.length.iloc[0]], "path": [path]})

    return run


def _loaded(path: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    held = _opened(path)
    exact = _unit(held["vectors"])
    graph = Graph.__new__(Graph)
    graph.v, graph.top = exact.astype(np.float32), int(held["top"])
    graph.layers = [held[f"layer{k}"] for k in range(len(held) - 4)]
    return graph, held["nodes"], held["copies"], exact


_FOUND = "node long, links long, other long"


def _search_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of rows that name a graph and some blocks."""
    for batch in batches:
        for path, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = _loaded(path)
            for block in blocks:
                held = _opened(block)
                yield pa.RecordBatch.from_pandas(_searched(shard, held["nodes"], _unit(held["vectors"])), preserve_index=False)


def _searched(shard: tuple[Graph, np.ndarray, np.ndarray, np.ndarray], asked: np.ndarray, unit: np.ndarray) -> pd.DataFrame:
    """For each query node its count of links in the shard, and edges that join what the links join."""
    graph, nodes, copies, exact = shard
    single = unit.astype(np.float32)
    beam = audited_beam(graph, single, LEAST)
    most = int(max(16, min(1024, 64_000_000 // max(len(nodes), 1))))
    at, step = 0, 16
    count = np.zeros(len(asked), np.int64)
    label, held = asked.copy(), nodes.copy()  # the smallest node that a query, or a node of the shard, is joined with
    moved = [np.empty((0, 2), np.int64)]  # each change of a shard node's label is an edge
    while at < len(asked):
        q, x = graph.links(single[at : at + step], beam, LEAST - _SLACK)
        q, at = q + at, at + step
        step = int(min(most, 4 * step, max(1, step * STEP_LINKS // max(len(q), 1))))  # what a step holds follows what the last one found
        good = np.empty(len(q), bool)
        for k in range(0, len(q), 1 << 16):
            good[k : k + (1 << 16)] = np.einsum("kd,kd->k", unit[q[k : k + (1 << 16)]], exact[x[k : k + (1 << 16)]]) >= LEAST
        good &= asked[q] != nodes[x]
        q, x = q[good], x[good]
        np.add.at(count, q, copies[x])
        start = held.copy()
        while len(q):  # min-labels along this step's links
            before = label[q], held[x]
            np.minimum.at(label, q, held[x])
            np.minimum.at(held, x, label[q])
            if np.array_equal(before[0], label[q]) and np.array_equal(before[1], held[x]):
                break
        changed = start != held
        moved.append(np.stack([start[changed], held[changed]], axis=1))
    edges = np.unique(np.concatenate(moved), axis=0)
    out = pd.DataFrame({"node": np.r_[asked, edges[:, 0]], "links": np.r_[count, np.zeros(len(edges), np.int64)], "other": np.r_[label, edges[:, 1]]})
    return out[(out.links > 0) | (out.node != out.other)]


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row for each row of ``embeddings``: vec_id, n_links, component_id, kept."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    keys = [F.when(F.col("usable"), F.xxhash64(*salt, "vector")).alias(name) for name, salt in (("h1", []), ("h2", [F.lit(2)]))]  # 128 bits tell vectors apart
    rows = embeddings.select("vec_id", vector.alias("vector"), usable.alias("usable")).select("*", *keys)
    distinct = rows.where("usable").groupBy("h1", "h2", "vec_id").agg(F.any_value("vector").alias("vector"))
    equal = distinct.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
    nodes = written(equal.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "vectors")
    total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0))).first()
    shards, blocks = max(SHARDS, math.ceil(total[1] * 4 / SHARD_BYTES)), max(1, math.ceil(total[0] / QUERIES))
    folder = new_path(embeddings.sparkSession, "graphs")
    make_folder(folder)
    named = nodes.select("length", "node", "copies", "vector", F.pmod("h1", F.lit(shards)).alias("shard"), F.pmod("h2", F.lit(blocks)).alias("block"))
    graphs = written(named.repartitionById(shards, F.col("shard").cast("int")).mapInPandas(_each("shard", _built(folder)), "length int, graph string"), "graphs")
    queries = written(named.repartitionById(blocks, F.col("block").cast("int")).mapInPandas(_each("block", _blocked(folder)), "length int, path string"), "queries")
    paths = queries.select("length", "path", F.floor(F.row_number().over(Window.partitionBy("length").orderBy("path")) / RUN).alias("run"))
    runs = paths.groupBy("length", "run").agg(F.collect_list("path").alias("paths"))  # at most ``RUN`` names
    work = written(graphs.join(runs, "length").select("graph", "paths"), "work")
    results = written(work.repartition(max(1, work.count())).mapInArrow(_search_runs, _FOUND), "found")
    roots = components(results.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = results.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("h1", "h2", "node", "copies", "smallest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component"))
    labels = written(
        rooted.join(named, "root").join(counts, "node", "left")
        .select("h1", "h2", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "labels",
    )
    return (
        rows.select("vec_id", "h1", "h2").join(labels, ["h1", "h2"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
