"""Nearest neighbours by largest inner product, with collision-counting hashing.

Vectors are lifted by one component so that all have the same length; the nearest vector is then the
one of largest inner product. Each of `lines` random lines holds the vectors of a shard sorted by their
projection; lines are at right angles to each other, as far as there are dimensions, so that no two tell
the same. A query opens a window around its own projection on every line and counts, for each
vector, on how many lines it lies inside. Virtual rehashing widens all windows by a factor, walking the
sorted arrays outward over the new stretches only, until enough vectors reach the collision threshold;
those are verified on the original vectors in double precision. Every block of queries holds a sample against brute force in the shard and asks for
more verified vectors until its recall suffices."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_facts, tidy
from .neardup import pack_arrays, usable


def lines_of(dim: int, lines: int, seed: int = 11) -> np.ndarray:
    """Random directions, the same on every executor: as many bases at right angles as are needed."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dim, min(lines, dim))))[0].T for _ in range(-(-lines // dim))]
    return (np.concatenate(bases)[:lines] * np.sqrt(dim)).astype("f4")


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length at most `longest`, scaled and lifted onto the unit sphere."""
    y = x / longest
    return np.append(y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))[:, None], 1)


NOTHING = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


class Index:
    """Sorted projections of a shard's vectors on every line."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, lines: int):
        self.ids, self.x, self.longest = ids, x, longest
        self.a = lines_of(x.shape[1] + 1, lines)
        p = (lift(x, longest) @ self.a.T).astype("f4")
        order = np.argsort(p, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)
        small = "u2" if len(ids) < 1 << 16 else "u4"
        self.order = np.ascontiguousarray(order.T).astype(small)  # on every line: whose place it is
        self.rank = np.empty(self.sorted.shape, small)  # on every line: a vector's place
        np.put_along_axis(self.rank, order.T, np.arange(len(ids), dtype=small)[None, :], 1)

    def window(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(first place inside, first place beyond) of every query on every line."""
        lo = np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, (at - half).T)], 1)
        return lo, np.stack([np.searchsorted(s, v, "right") for s, v in zip(self.sorted, (at + half).T)], 1)

    def inside(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """On how many lines each vector lies in one query's windows, by its places."""
        offset = self.rank - lo.astype(self.rank.dtype)[:, None]  # below `lo` it wraps round
        return np.add.reduce(offset < (hi - lo).astype(self.rank.dtype)[:, None], axis=0, dtype="i2")

    def stretches(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often each vector stands between `lo` and `hi` of the sorted arrays."""
        some = [o[i:j] for o, i, j in zip(self.order, lo.tolist(), hi.tolist()) if i < j]
        return np.bincount(np.concatenate(some), minlength=len(self.ids)).astype("i2") if some else np.zeros(len(self.ids), "i2")

    def candidates(self, q: np.ndarray, threshold: float, wanted: int, width: float = 0.7, growth: float = 1.1) -> tuple[list[np.ndarray], np.ndarray]:
        """(for every query the vectors that collide on at least threshold * lines lines, at the first
        width at which there are `wanted` of them or all are inside; those widths).

        The first windows are counted by places, which is the faster way for wide ones; from there on
        the sorted arrays are walked outward and counts grow by the new stretches."""
        n, lines = len(self.ids), len(self.a)
        least, wanted = int(np.ceil(threshold * lines)), min(wanted, n)
        lifted = np.append(q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1)), 1)
        at = (lifted @ self.a.T).astype("f4")
        out: list = [None] * len(q)
        widths = np.empty(len(q))
        left, half = np.arange(len(q)), width
        counts: dict[int, np.ndarray] = {}
        lo, hi = self.window(at, half)
        while len(left):
            for i in left.tolist():
                if i not in counts:
                    counts[i] = self.inside(lo[i], hi[i])
                found = np.flatnonzero(counts[i] >= least)
                if len(found) >= wanted or (lo[i].max() == 0 and hi[i].min() == n):
                    out[i], widths[i] = found, half
                    del counts[i]
            left, half = np.array(sorted(counts), int), half * growth
            below, beyond = self.window(at[left], half)
            for k, i in enumerate(left.tolist()):
                counts[i] += self.stretches(below[k], lo[i]) + self.stretches(hi[i], beyond[k])
            lo[left], hi[left] = below, beyond
        return out, widths


def best(index: Index, own: int, q: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k largest inner products among rows, ties to the smaller id; not the query's own."""
    among = among[index.ids[among] != own]
    scores = index.x[among] @ q
    if len(among) > 4 * k:
        few = scores >= np.partition(scores, -k)[-k]
        among, scores = among[few], scores[few]
    order = np.lexsort((index.ids[among], -scores))[:k]
    return index.ids[among[order]], scores[order]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, lines: int = 64, threshold: float = 0.65, share: float = 0.12, recall: float = 0.96, shard: int = 8192, block: int = 1024, audit: int = 24, together: int = 8) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every` its k nearest.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
    no part; vectors of different lengths aren't compared. A query's own rows are those with its id;
    repeated queries are asked once. Ties go to the smaller id. An empty table gives no rows. Other
    columns are ignored."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = scratch.save(rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumns({"dim": F.size("v"), "norm": norm}), "good")
    sizes = good.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"),
        F.ceil(F.count(F.when(F.col("vec_id") % every == 0, 1)) / block).cast("int").alias("blocks"),
        F.max("norm").alias("longest"),
    )
    dealt = scratch.save(join_facts(good, scratch.save(sizes, "sizes"), ["dim"], ["vec_id"]), "dealt")
    first = lambda t, c: [t.column(c)[0].as_py()]

    @tidy
    def build(group: pa.Table) -> pa.Table:
        index = Index(group.column("vec_id").to_numpy(), np.stack(group.column("v").to_numpy()), first(group, "longest")[0], lines)
        return pa.table({"dim": pa.array(first(group, "dim"), pa.int32()), "shard": pa.array(first(group, "shard"), pa.int32()), "blocks": pa.array(first(group, "blocks"), pa.int32()), "index": pa.array([pack_arrays(index)], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        ids, at = np.unique(group.column("vec_id").to_numpy(), return_index=True)
        blob = pack_arrays(ids, np.stack(group.column("v").to_numpy())[at])
        return pa.table({"dim": pa.array(first(group, "dim"), pa.int32()), "block": pa.array(first(group, "block"), pa.int32()), "shards": pa.array(first(group, "shards"), pa.int32()), "queries": pa.array([blob], pa.binary())})

    indexed = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int")).groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, blocks int, index binary")
    indexed = scratch.save(indexed, "index")
    asked = dealt.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")).groupBy("dim", "block").applyInArrow(gather, "dim int, block int, shards int, queries binary")
    asked = scratch.save(asked, "asked")

    @tidy
    def visit(indexes: pa.Table, asks: pa.Table) -> pa.Table:
        (index,) = pickle.loads(indexes.column("index")[0].as_py())
        return pa.concat_tables([visit_block(index, *pickle.loads(q.as_py())) for q in asks.column("queries")])

    def visit_block(index: Index, ids: np.ndarray, q: np.ndarray) -> pa.Table:
        test = np.random.default_rng(len(ids)).permutation(len(ids))[:audit]
        everything = np.arange(len(index.ids))
        wanted = k + int(share * len(index.ids))
        truth = [set(best(index, int(ids[t]), q[t], everything, k)[0].tolist()) for t in test]
        while True:  # ask for more until the sample's recall suffices
            found, widths = index.candidates(q[test], threshold, wanted)
            hits = sum(len(w & set(index.ids[f].tolist())) for w, f in zip(truth, found))
            if hits >= recall * sum(map(len, truth)) or wanted >= len(index.ids):
                break
            wanted = int(wanted * 1.5)
        # the others' windows begin at a width that the sample's queries have mostly needed
        found, _ = index.candidates(q, threshold, wanted, float(np.quantile(widths, 0.25)))
        out = [best(index, int(i), x, f, k) for i, x, f in zip(ids, q, found)]
        n = [len(o[0]) for o in out]
        return pa.table({"query_id": np.repeat(ids, n), "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})

    # every block of queries visits every shard: an index goes once to `together` blocks of queries
    meet = ["dim", "shard", "group"]
    indexed = indexed.where("blocks > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / together).cast("int"))))
    asked = asked.withColumns({"group": F.floor(F.col("block") / together).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1))})
    asked = asked.groupBy(*meet)
    hits = indexed.groupBy(*meet).cogroup(asked).applyInArrow(lambda x, q: visit(x, q) if len(x) and len(q) else NOTHING, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
