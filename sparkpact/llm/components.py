"""Connected components of link tables, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Union:
    """Union-find over 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], "i8")


def tree_edges(nodes: np.ndarray, roots: np.ndarray, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep every group of `roots` connected, as a tree in which no node has more than
    fan + 1 neighbours: a hub would gather its links in one task later on."""
    order = np.lexsort((nodes, roots))
    nodes, roots = nodes[order], roots[order]
    first = np.append(True, roots[1:] != roots[:-1]) if len(roots) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    start = np.repeat(begin, np.diff(np.append(begin, len(nodes))))
    nth = np.arange(len(nodes)) - start
    child = nth > 0
    return nodes[child], nodes[(start + (nth - 1) // fan)[child]]


def components(links: DataFrame, scratch: Scratch, name: str, most: int = 100_000) -> DataFrame:
    """(node, root): every node of `links` (a, b) with the smallest node reachable from it.

    While there are more than `most` links, a round hooks every node to its least neighbour and that
    one's least neighbour, and the links are drawn between what they were hooked to; this at
    least halves the nodes that have links. `most` links or fewer are united in one task."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = scratch.save(edges, f"{name}-0")
    hooks: list[DataFrame] = []
    while edges.count() > most:
        both = edges.union(edges.select("b", "a"))
        near = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")), f"{name}-near-{len(hooks)}")
        up = near.select(F.col("node").alias("up"), F.col("up").alias("root"))
        hooks.append(scratch.save(near.join(up, "up").select("node", "root"), f"{name}-hooks-{len(hooks)}"))
        to_a, to_b = (hooks[-1].select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        drawn = edges.join(to_a, "a").join(to_b, "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        edges = scratch.save(drawn.where("a < b").distinct(), f"{name}-{len(hooks)}")

    def unite(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        union = Union(len(nodes))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            union.join(i, j)
        return pa.table({"node": nodes, "root": nodes[union.roots()]})

    last = edges.groupBy(F.lit(0).alias("all")).applyInArrow(unite, "node long, root long")
    last = scratch.save(last, f"{name}-last")
    found = None
    for step in [*hooks, last]:
        if found is None:
            found = step
            continue
        then = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = found.join(then, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return scratch.save(found, f"{name}-roots")
