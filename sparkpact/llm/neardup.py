"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are compared only within a label. Equal vectors count once with their copies. A label is cut
into shards of bounded size, each with its own graph; blocks of queries visit every shard of their
label. A graph's links are chosen among exact products of blocks. In a shard, a beam search finds the nearest vectors, and from those in range the search goes on
along links in range until nothing new turns up. In every shard a block's links to a sample of vectors,
and all links of a sample of its queries, are held against brute force, and the beam is widened until the audit passes. Cosine is verified in double
precision. Components are united from spanning forests, never from all pairs."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_facts, join_spread, tidy
from .components import Union, components, tree_edges


def search(x: np.ndarray, links: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the beam of every query, best first; -1 where there is none.

    All queries move in step: each round they expand their `step` best unexpanded beam members."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, "i4")
    sims = np.full((n, beam), -np.inf, "f4")
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("ij,ij->i", q, x[entry])
    seen[rows[:, 0], entry] = True
    marks = seen.ravel()
    open_ = ids >= 0
    live = np.arange(n)
    while len(live):
        s = np.where(open_[live], sims[live], -np.inf)
        pick = np.argpartition(-s, min(step, beam - 1) - 1, axis=1)[:, :step] if beam > step else np.tile(np.arange(beam), (len(live), 1))
        r = np.arange(len(live))[:, None]
        ok = open_[live][r, pick]
        alive = ok.any(1)
        if not alive.all():
            live, pick, ok = live[alive], pick[alive], ok[alive]
            if not len(live):
                break
        open_[live[:, None], pick] = False
        near = np.where(ok[:, :, None], links.take(ids[live[:, None], pick], 0), -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        # places in the flat arrays: `take` of them is several times faster than two indices
        flat = np.flatnonzero(near >= 0)
        mark = live[flat // near.shape[1]] * len(x) + near.ravel().take(flat)
        fresh = ~marks.take(mark)
        near.ravel()[flat[~fresh]] = -1
        flat, mark = flat[fresh], mark[fresh]
        if not len(flat):
            continue
        marks[mark] = True
        sim = np.full(near.shape, -np.inf, "f4")
        sim.ravel()[flat] = np.einsum("ij,ij->i", q.take(live[flat // near.shape[1]], 0), x.take(near.ravel().take(flat), 0))
        all_s = np.concatenate([sims[live], sim], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        sims[live] = kept = np.take_along_axis(all_s, top, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], near >= 0], 1), top, 1) & np.isfinite(kept)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, q: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """For each row up to `keep` of its candidates (best first, -1: none), taking one only if it is closer
    to the row's vector than to any taken before; the rest of the room goes to the closest left."""
    ok = cand >= 0
    v = x[np.where(ok, cand, 0)]
    sim = np.where(ok, np.matmul(v, q[:, :, None])[:, :, 0], -np.inf)
    between = np.matmul(v, v.transpose(0, 2, 1))
    worst = np.full(cand.shape, -np.inf, "f4")
    taken = np.zeros(cand.shape, bool)
    for c in range(cand.shape[1]):
        take = ok[:, c] & (sim[:, c] > worst[:, c]) & (taken.sum(1) < keep)
        taken[:, c] = take
        worst = np.where(take[:, None], np.maximum(worst, between[:, c]), worst)
    rank = np.where(taken, 0, np.where(ok, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, keep - out.shape[1]))), constant_values=-1)


def best(sims: np.ndarray, k: int, group: int = 16) -> np.ndarray:
    """Columns of the k largest of each row, in no order. Each of them lies in one of the k groups of columns
    with the largest maxima, so only those are looked into."""
    n, m = sims.shape
    if m <= 4 * k * group:
        return np.argpartition(-sims, k - 1, axis=1)[:, :k] if m > k else np.tile(np.arange(m), (n, 1))
    sims = np.pad(sims, ((0, 0), (0, -m % group)), constant_values=-np.inf)
    groups = sims.reshape(n, -1, group)
    top = np.argpartition(-groups.max(2), k - 1, axis=1)[:, :k]
    cols = (top[:, :, None] * group + np.arange(group)).reshape(n, -1)
    inner = np.argpartition(-np.take_along_axis(sims, cols, 1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(cols, inner, 1)


class Graph:
    """Layers of links over unit vectors; layer k holds the vectors of level k and above. A vector's links are
    chosen among the nearest of those put in before it, which products of blocks give exactly."""

    def __init__(self, x: np.ndarray, links: int = 12, beam: int = 48, seed: int = 3):
        self.x, n = x, len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(int), 8)
        self.layers: list[np.ndarray] = []
        order = np.argsort(-level, kind="stable")
        self.entry = int(order[0])
        for k in range(int(level.max()), -1, -1):
            own = order[level[order] >= k]
            graph = np.full((n, 2 * links), -1, "i4")
            self.layers.append(graph)
            done = 0
            while done < len(own):
                new = own[done : done + max(64, min(512, done))]
                cand = np.zeros((len(new), 0), "i4")
                sims = np.zeros((len(new), 0), "f4")
                if done:
                    before = x[new] @ x[own[:done]].T
                    at = best(before, beam)
                    cand, sims = own[at].astype("i4"), np.take_along_axis(before, at, 1)
                among = x[new] @ x[new].T
                np.fill_diagonal(among, -np.inf)
                few = min(16, len(new) - 1)
                if few > 0:
                    top = np.argpartition(-among, few - 1, axis=1)[:, :few]
                    cand = np.concatenate([cand, new[top].astype("i4")], 1)
                    sims = np.concatenate([sims, np.take_along_axis(among, top, 1)], 1)
                if cand.shape[1]:
                    cand = np.take_along_axis(cand, np.argsort(-sims, axis=1), 1)
                    graph[new, :links] = diverse(x, x[new], cand, links)
                    self._back(graph, new, links)
                done += len(new)

    def __getstate__(self) -> tuple:
        """Without the vectors, and of each layer only the rows that have links."""
        own = [np.flatnonzero((layer >= 0).any(1)) for layer in self.layers]
        return len(self.x), self.entry, [(at, layer[at]) for at, layer in zip(own, self.layers)]

    def __setstate__(self, state: tuple) -> None:
        n, self.entry, layers = state
        self.layers = []
        for at, rows in layers:
            self.layers.append(np.full((n, rows.shape[1]), -1, "i4"))
            self.layers[-1][at] = rows

    def of(self, x: np.ndarray) -> Graph:
        """A graph that was packed, with its vectors again."""
        self.x = x
        return self

    def _back(self, graph: np.ndarray, new: np.ndarray, links: int) -> None:
        """Links back from the chosen neighbours; a full list is thinned to diverse ones."""
        x = self.x
        a = np.repeat(new, links)
        b = graph[new, :links].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        sim = np.einsum("id,id->i", x[a], x[b])
        order = np.lexsort((-sim, b))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        nth = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
        a, b, nth = a[nth < 32], b[nth < 32], nth[nth < 32]
        to = np.unique(b)
        row = np.searchsorted(to, b)
        cand = np.full((len(to), 2 * links + 32), -1, "i4")
        cand[:, : 2 * links] = graph[to]
        cand[row, 2 * links + nth] = a
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        for s in range(0, len(to), 256):
            c = cand[s : s + 256]
            own = np.where(c >= 0, np.matmul(x[np.maximum(c, 0)], x[to[s : s + 256]][:, :, None])[:, :, 0], -np.inf)
            c = np.take_along_axis(c, np.argsort(-own, axis=1), 1)
            graph[to[s : s + 256]] = diverse(x, x[to[s : s + 256]], c, 2 * links)

    def descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Where to enter the layer below the first `layers`."""
        at = np.full(len(q), self.entry, "i4")
        for graph in self.layers[:layers]:
            at = search(self.x, graph, at, q, 4)[0][:, 0]
        return at

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) of the vectors found with similarity >= least."""
        ids, sims = search(self.x, self.layers[-1], self.descend(q, len(self.layers) - 1), q, beam)
        row, col = np.nonzero((sims >= least) & (ids >= 0))
        cols, at_col = np.unique(ids[row, col], return_inverse=True)
        rows, at_row = np.unique(row, return_inverse=True)
        place = np.full(len(self.x), -1)
        place[cols] = np.arange(len(cols))
        hit = np.zeros((len(rows), len(cols)), bool)  # only queries and vectors that are in range of any
        hit[at_row, at_col] = True
        fresh, done = np.arange(len(cols)), np.zeros(len(cols), bool)
        while len(fresh):  # along links in range, for all queries together
            done[fresh] = True
            near = np.unique(np.append(self.layers[-1][cols[fresh]].reshape(-1), cols[fresh]))
            near = near[near >= 0]
            at = np.flatnonzero(hit[:, fresh].any(1))
            found = q[rows[at]] @ self.x[near].T >= least
            near, found = near[found.any(0)], found[:, found.any(0)]
            new = near[place[near] < 0]
            place[new] = len(cols) + np.arange(len(new))
            cols, done = np.append(cols, new), np.append(done, np.zeros(len(new), bool))
            hit = np.pad(hit, ((0, 0), (0, len(new))))
            hit[np.ix_(at, place[near])] |= found
            fresh = place[near][~done[place[near]]]
        row, col = np.nonzero(hit)
        return rows[row], cols[col]


NOTHING = pa.table({n: pa.array([], pa.int64()) for n in ("key", "links", "a", "b")})


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def narrow(v: np.ndarray) -> np.ndarray:
    """In single precision where that is exact."""
    with np.errstate(over="ignore"):
        single = v.astype("f4")
    return single if (single == v).all() else v


def pack_arrays(*arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def usable(column) -> F.Column:
    """Not null, not empty, all components finite, not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard: int = 16384, block: int = 1024, beam: int = 48, recall: float = 0.98, audit: int = 24, together: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    link with nothing; so do vectors of different lengths. Repeated rows are equal vectors and link.
    Null vec_ids are kept; a component is named by its smallest id that is not null, so ties in similarity
    make no difference. An empty table gives no rows. Other columns, of whatever name, are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull()).withColumn("key", F.xxhash64("label", "v"))
    own = scratch.save(good.groupBy("label", "v", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "own")
    cuts = own.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = scratch.save(join_facts(own, scratch.save(cuts, "cuts"), ["label", "dim"], ["key"]), "dealt")

    @tidy
    def build(group: pa.Table) -> pa.Table:
        key, copies = group.column("key").to_numpy(), group.column("copies").to_numpy()
        x = np.stack(group.column("v").to_numpy())
        blob = pack_arrays(key, copies, narrow(x), Graph(unit(x).astype("f4")))
        first = lambda c: [group.column(c)[0].as_py()]
        return pa.table({"label": first("label"), "dim": pa.array(first("dim"), pa.int32()), "shard": pa.array(first("shard"), pa.int32()), "blocks": pa.array(first("blocks"), pa.int32()), "graph": pa.array([blob], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        blob = pack_arrays(group.column("key").to_numpy(), narrow(np.stack(group.column("v").to_numpy())))
        first = lambda c: [group.column(c)[0].as_py()]
        return pa.table({"label": first("label"), "dim": pa.array(first("dim"), pa.int32()), "block": pa.array(first("block"), pa.int32()), "shards": pa.array(first("shards"), pa.int32()), "queries": pa.array([blob], pa.binary())})

    salt = F.xxhash64("key", F.lit(1))
    graphs = dealt.withColumn("shard", F.pmod(salt, F.col("shards")).cast("int")).groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard int, blocks int, graph binary")
    graphs = scratch.save(graphs, "graphs")
    asked = dealt.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")).groupBy("label", "dim", "block").applyInArrow(gather, "label string, dim int, block int, shards int, queries binary")
    asked = scratch.save(asked, "asked")

    @tidy
    def visit(graphs_: pa.Table, asks: pa.Table) -> pa.Table:
        key, copies, x, graph = pickle.loads(graphs_.column("graph")[0].as_py())
        ux = unit(x.astype("f8"))
        own = key, copies, ux, graph.of(ux.astype("f4"))
        return pa.concat_tables([visit_block(*own, *pickle.loads(q.as_py())) for q in asks.column("queries")])

    def visit_block(key, copies, ux, graph, ask, q) -> pa.Table:
        uq = unit(q.astype("f8"))
        fast = uq.astype("f4")
        slack = np.float32(least - 1e-5)
        # held against brute force: some queries with all vectors of the shard, and all queries with some
        # vectors; a vector's match with itself, which is always found, doesn't count
        rng = np.random.default_rng(len(q))
        test, some = rng.permutation(len(q))[:audit], rng.permutation(len(ux))[: 8 * audit]
        i, j = np.nonzero(uq[test] @ ux.T >= least)
        m, n = np.nonzero(uq @ ux[some].T >= least)
        i, j = np.append(test[i], m), np.append(j, some[n])
        sampled = np.unique((i * len(ux) + j)[ask[i] != key[j]])  # pairs by number
        width = beam
        while True:
            a, b = (np.concatenate(p) for p in zip(*((s + i, j) for s in range(0, len(q), 512) for i, j in [graph.within(fast[s : s + 512], slack, width)])))
            cos = np.concatenate([np.einsum("id,id->i", uq[a[s : s + 65536]], ux[b[s : s + 65536]]) for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
            a, b = a[cos >= least], b[cos >= least]
            if np.isin(sampled, a * len(ux) + b).sum() >= recall * len(sampled) or width >= len(ux):
                break
            width *= 2
        other = ask[a] != key[b]
        a, b = a[other], b[other]
        nodes, at = np.unique(np.concatenate([ask[a], key[b]]), return_inverse=True)
        union = Union(len(nodes))
        pairs = np.stack([at[: len(a)], at[len(a) :]], 1)
        for i, j in pairs.tolist():
            union.join(i, j)
        ea, eb = tree_edges(nodes, union.roots())
        n = np.bincount(a, copies[b], len(ask)).astype("i8")
        none, zero = [None] * len(ea), [None] * len(ask)
        return pa.table({"key": pa.array([*ask.tolist(), *none], pa.int64()), "links": pa.array([*n.tolist(), *none], pa.int64()), "a": pa.array([*zero, *ea.tolist()], pa.int64()), "b": pa.array([*zero, *eb.tolist()], pa.int64())})

    # every block of queries visits every shard of its label: a graph goes once to `together` blocks of queries
    meet = ["label", "dim", "shard", "group"]
    graphs = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / together).cast("int"))))
    asked = asked.withColumns({"group": F.floor(F.col("block") / together).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1))})
    asked = asked.groupBy(*meet)
    visits = graphs.groupBy(*meet).cogroup(asked).applyInArrow(lambda g, q: visit(g, q) if len(g) and len(q) else NOTHING, "key long, links long, a long, b long")
    visits = scratch.save(visits, "visits")
    counts = visits.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(visits.where("a is not null").select("a", "b"), scratch, "components").withColumnRenamed("node", "key")
    reps = own.select("key", "rep", "copies")
    names = reps.join(roots, "key").groupBy("root").agg(F.min("rep").alias("name"))
    named = roots.join(names, "root").select("key", "name")
    of_key = reps.join(counts, "key").join(named, "key", "left").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "rep").alias("component"))
    of_key = scratch.save(of_key, "of-key")
    with_key = join_spread(good.select("vec_id", "key"), of_key, "key", ["vec_id"])
    alone = rows.where(~(usable(F.col("v")) & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = with_key.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component").unionByName(alone)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
