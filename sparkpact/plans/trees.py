"""Recursive contracts over JSON of any depth, level by level.

A lazy decoder leaves its node as a row for the next level instead of being unrolled in the plan: the plan of a
level is that of one node, however deep the data is, and all nodes of a level are decoded together. The loop
ends with the first level that leaves nothing. As Spark has no recursive types, the value of a lazy member is a
reference, and nodes are rows of their own. Issues go in the order in which a decoder that
recurses would tell them: a level tells the places of its nodes among its issues, and rows are ordered by the
places of all levels above."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.core import Decoder, published, same_as
from ..sources.nodes import Json, Node
from .issues import issue_columns, pointer
from .outcome import PENDING, Outcome, Path, deferring, issue, let, path_column

REF = "ref"


def saved(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder that the cluster shares; a folder of our own only where the driver
    runs all tasks itself and none is set."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkpact-"))
    return df.checkpoint(eager=True)


class Left:
    """The lazy decoders met, and how many nodes expressions leave to them."""

    def __init__(self):
        self.keys: list[tuple] = []
        self.makers: list[Callable[[], Decoder]] = []
        self.count = 0

    def leave(self, make: Callable[[], Decoder], node: Node, path: Path) -> Outcome:
        key = same_as(make)
        if key not in self.keys:
            self.keys.append(key)
            self.makers.append(make)
        self.count += 1
        text = F.to_json(node.v) if isinstance(node, Json) else F.lit(None).cast("string")
        mark = issue(PENDING, path, {"node": text}, str(self.keys.index(key)))
        return Outcome(F.struct(path_column(path).alias(REF)), [("one", mark)])


@dataclass(frozen=True)
class Tree:
    """`roots`: the input's columns, row (a number of each input row) and the root's value. `nodes`: for each lazy
    decoder, in the order met, a row per node that it read: row, level, parent and path (segments from the
    root), value. Values are null where the node itself has issues; the value of a lazy member is
    struct(ref), its path from the node that holds it."""

    roots: DataFrame
    told: DataFrame
    nodes: list[DataFrame] = field(default_factory=list)

    def issues(self, *keys: str) -> DataFrame:
        """A row per issue in order, with the key columns of its input row."""
        order = Window.partitionBy("row").orderBy("place")
        rows = self.told.join(self.roots.select("row", *keys), "row").withColumn("position", F.row_number().over(order) - 1)
        return rows.select(*keys, "position", *(e.alias(n) for n, e in issue_columns(F.col("issue")).items()), "issue")

    def valid(self) -> DataFrame:
        """Roots of rows without any issue, at whatever depth."""
        return self.roots.join(self.told.select("row").distinct(), "row", "left_anti")


def _outcome(decoder: Decoder, tree: Column, lossless: bool, left: Left, at_root: bool) -> Column:
    """Value and issues of the node that `tree` holds."""
    def judged(root: Json) -> Column:
        made = decoder.compile(root)
        if not at_root:
            return made.packed()
        not_json = F.array(issue("invalid_format", (), {}, "invalid_format.json"))
        return let(made.packed(), lambda p: F.struct(F.when(~root.missing, p.getField("value")).alias("value"), F.when(root.missing, not_json).otherwise(p.getField("issues")).alias("issues")))

    with deferring(left):
        return Json(tree, lossless).bound(judged)


def _level(rows: DataFrame, outcome: Column) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "_text"]
    return saved(rows.select(*kept, F.inline(F.array(outcome)).alias("_value", "_issues")))


def decode_tree(df: DataFrame, decoder: Decoder, column: str, lossless: bool = False) -> Tree:
    """Decodes a column of JSON text by a decoder in which `lazy` may go to any depth. Text that is not JSON is one
    issue at the root. What decides by whether a node decodes (`one_of`, `fallback`) cannot hold a lazy decoder
    here; functions over a value that holds references run before what they refer to is decoded. Input columns
    named row or value give way."""
    from ..sources import json as json_source

    left = Left()
    text = F.col(column).cast("string")
    own = [c for c in df.columns if c not in ("row", "value")]
    rows = df.select(*(F.col(f"`{c}`") for c in own), text.alias("_text")).withColumn("row", F.monotonically_increasing_id())
    tree = (json_source.lossless if lossless else json_source.fast)(F.col("_text"))
    first = _level(rows, _outcome(decoder, tree, lossless, left, True))
    roots = first.select(*(F.col(f"`{c}`") for c in own), "row", F.col("_value").alias("value"))
    empty = F.expr("cast(array() as array<int>)")
    nowhere = F.expr("cast(array() as array<string>)")
    done = [first.select("row", empty.alias("place"), nowhere.alias("path"), "_issues")]
    nodes: dict[int, list[DataFrame]] = {}
    outcomes: dict[int, Column] = {}
    open_, depth = done, 0
    while True:
        told = reduce(DataFrame.union, open_).select("row", "place", "path", F.posexplode("_issues").alias("_at", "_issue")).where(F.col("_issue.code") == PENDING)
        todo = told.select(
            "row", F.concat("place", F.array("_at")).alias("place"), F.concat("path", F.col("_issue.path")).alias("path"), F.col("path").alias("parent"),
            F.col("_issue.message_key").cast("int").alias("_which"), F.try_element_at("_issue.meta", F.lit("node")).alias("_text"),
        )
        kinds = sorted(r[0] for r in todo.select("_which").distinct().collect())  # at most as many as there are lazy decoders
        if not kinds:
            break
        open_, depth = [], depth + 1
        for k in kinds:
            mine = todo.where(F.col("_which") == k).drop("_which")
            if k not in outcomes:
                outcomes[k] = _outcome(left.makers[k](), F.try_parse_json("_text"), lossless, left, False)
            made = _level(mine, outcomes[k])
            open_.append(made.select("row", "place", "path", "_issues"))
            nodes.setdefault(k, []).append(made.select("row", F.lit(depth).alias("level"), "parent", "path", F.col("_value").alias("value")))
        done += open_
    all_ = reduce(DataFrame.union, done).select("row", "place", "path", F.posexplode(published(F.col("_issues"))).alias("_at", "_issue")).where(F.col("_issue.code") != PENDING)
    told = all_.select("row", F.concat("place", F.array("_at")).alias("place"), F.col("_issue").withField("path", F.concat("path", F.col("_issue.path"))).alias("issue"))
    return Tree(roots, told, [reduce(DataFrame.union, nodes[k]) for k in sorted(nodes)])


_children: ContextVar[Column | None] = ContextVar("children", default=None)


def children() -> Column | None:
    return _children.get()


@contextmanager
def _held(texts: Column):
    token = _children.set(texts)
    try:
        yield
    finally:
        _children.reset(token)


def encode_tree(tree: Tree, encoder, node_encoder=None) -> DataFrame:
    """JSON text of each row of a tree of one lazy decoder: (row, text). From the deepest level up every node is
    written around the texts of the nodes below it, so no plan is deeper than one node. `encoder` writes roots,
    `node_encoder` nodes (the same, if none is given); `encode.lazy` stands where a reference is."""
    below = F.expr("cast(map() as map<string,string>)")
    if len(tree.nodes) > 1:
        raise ValueError("a tree of several lazy decoders is not written as one")
    root = F.expr("cast(array() as array<string>)")
    texts = None
    if tree.nodes:
        rows = tree.nodes[0]
        for level in range(rows.agg(F.max("level")).first()[0] or 0, 0, -1):
            texts = saved(_written(rows.where(F.col("level") == level), texts, node_encoder or encoder, below))
    found = _written(tree.roots.select("row", "value", root.alias("path"), root.alias("parent")), texts, encoder, below)
    return found.select("row", F.col("_text").alias("text"))


def _written(rows: DataFrame, texts: DataFrame | None, encoder, below: Column) -> DataFrame:
    if texts is None:
        rows = rows.withColumn("_below", below)
    else:
        ref = pointer(F.slice("path", F.size("parent") + 1, F.greatest(F.lit(1), F.size("path") - F.size("parent"))))
        held = texts.groupBy("row", F.col("parent").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct(ref, "_text"))).alias("_below"))
        rows = rows.join(held, ["row", "path"], "left").withColumn("_below", F.coalesce("_below", below))
    with _held(F.col("_below")):
        text = encoder.encode(F.col("value"))
    return rows.select("row", "path", "parent", text.alias("_text"))
