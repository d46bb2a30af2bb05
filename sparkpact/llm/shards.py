"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Groups are equal texts. The packing runs on a histogram: for every group size one row with its count. Since
sizes differ, there are fewer than sqrt(2 x all bytes) such rows. They stream to the driver by descending
size and the plan streams back in batches; open bins lie in a balanced tree by remaining room, and the
groups of one size go to the tightest bin that takes them, as many at once as fit.

A group larger than a whole shard would leave the shards far from equal. It is split into as few parts as
fit, unless `whole` asks for groups to stay whole; then its shard is as large as the group. A single text that is larger
than an even share has a shard of its own, and the others share what is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_spread, numbered, small_table, split_count


class Bins:
    """Bins by (remaining room, number) in a treap: a search tree that random priorities keep balanced, so
    that the tightest bin is found, taken out and put back in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.turn = 0

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Bins._split(node[3], key)
            node[3] = low
            return node, high
        low, high = Bins._split(node[2], key)
        node[2] = high
        return low, node

    @staticmethod
    def _merge(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = Bins._merge(low[3], high)
            return low
        high[2] = Bins._merge(low, high[2])
        return high

    def add(self, room: int, k: int) -> None:
        self.turn += 1
        node = [(room, k), self.turn * 0x9E3779B97F4A7C15 % 2**64, None, None]
        low, high = self._split(self.root, node[0])
        self.root = self._merge(self._merge(low, node), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with least room that still has room for `size`; None if there is none."""
        low, high = self._split(self.root, (size, -1))
        first = high
        while first is not None and first[2] is not None:
            first = first[2]
        if first is not None:
            _, high = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._merge(low, high)
        return first and first[0]

    def roomiest(self) -> tuple[int, int]:
        last = self.root
        while last[3] is not None:
            last = last[3]
        low, _ = self._split(self.root, last[0])
        self.root = low
        return last[0]


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, shards: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(size, first rank, count, bin) for (size, count) in descending order of size. With `shards` there are
    so many bins, and what fits nowhere goes to the roomiest; else a bin is opened when nothing fits."""
    bins = Bins()
    opened = shards or 0
    for k in range(opened):
        bins.add(capacity, k)
    for size, count in sizes:
        first = 0
        while first < count:
            found = bins.take(size)
            if found is None and shards is None:
                found, opened = (capacity, opened), opened + 1
            room, k = found or bins.roomiest()
            n = min(count - first, max(1, room // max(size, 1)))
            yield size, first, n, k
            first += n
            bins.add(room - n * size, k)


def room_of(total: int, shards: int, largest: list[int]) -> int:
    """Bytes of a shard, when what is larger than its even share of the rest (`largest`, falling) has one alone."""
    for size in largest:
        if shards == 1 or size * shards <= total:
            break
        total, shards = total - size, shards - 1
    return max(1, -(-total // shards))


def shard_by_bytes(docs: DataFrame, shards: int | None = 40, overhead: int = 16, capacity: int | None = None, whole: bool = False, piece_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Size is the text's UTF-8 bytes (null: none) plus `overhead`. Equal texts are one group; null and
    the empty text are equal here, as both have no bytes. Very long texts are groups as any other. Repeated
    rows count each; null doc_ids are kept. An empty table gives no rows; other columns are ignored. Ties
    go by the text's hash, then doc_id. Without `shards`, as few shards of `capacity` as the packing finds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),  # parts rows that are alike
        ),
        "rows",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = split_count(n, piece_rows, 64)
    group = rows.groupBy("text_sha256", "size").agg(F.count(F.lit(1)).alias("rows"))
    if capacity is None:  # at most `shards` of them are larger than an even share
        units = group.select((F.col("size") * F.col("rows")).alias("size")) if whole else rows.select("size")
        capacity = room_of(total, shards, [r[0] for r in units.orderBy(F.desc("size")).limit(shards).collect()])
    # a group over the capacity is cut into parts of `per` rows, the others are one part
    per = F.greatest(F.lit(1), F.floor(F.lit(capacity) / F.col("size"))).cast("long")
    group = group.withColumn("per", F.when((F.col("rows") * F.col("size") > capacity) & F.lit(not whole), per).otherwise(F.col("rows")))
    large = scratch.save(group.where(F.col("rows") > F.col("per")), "large")  # fewer than `shards` groups
    # the groups' own sizes; large ones by part
    parts = group.select("text_sha256", "size", "rows", "per", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / F.col("per")).cast("int"))).alias("part"))
    parts = scratch.save(
        parts.select("text_sha256", "part", (F.col("size") * F.least(F.col("per"), F.col("rows") - F.col("part") * F.col("per"))).alias("group_size")), "parts"
    )
    sizes = parts.groupBy("group_size").count().orderBy(F.desc("group_size"))
    made = best_fit_decreasing(((r[0], r[1]) for r in sizes.toLocalIterator()), capacity, shards)
    batch = list(islice(made, 200_000))
    while True:  # at least once, for the schema
        runs = small_table(spark, batch, **dict.fromkeys(("size", "first", "count", "shard"), pa.int64()))
        runs.write.mode("append").parquet(scratch.path("runs"))
        if not (batch := list(islice(made, 200_000))):
            break
    runs = scratch.load("runs", runs)
    ranked = numbered(parts, ["group_size"], ["text_sha256", "part"], "rank", pieces)
    # ranks and runs meet by blocks of ranks, so that a size that many groups share is dealt out
    block = 4096
    cut = runs.select("size", "first", "count", "shard", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("count") - 1) / block))).alias("block"))
    placed = (
        ranked.withColumn("block", F.floor(F.col("rank") / block))
        .join(cut.withColumnRenamed("size", "group_size"), ["group_size", "block"])
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
        .select("text_sha256", "part", F.col("shard").cast("int").alias("shard"))
    )
    marked = join_spread(rows, large.select("text_sha256", "per"), "text_sha256", ["row"], pieces, "left")
    many = numbered(marked.where("per is not null"), ["text_sha256"], ["doc_id", "row"], "nth", pieces)
    many = many.withColumn("part", F.floor(F.col("nth") / F.col("per")).cast("int")).drop("nth", "per")
    few = marked.where("per is null").drop("per").withColumn("part", F.lit(0))
    dealt = scratch.save(few.unionByName(many).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(pieces))), "dealt")
    # rows join their group's place; a group of many copies is spread over the salts it has
    keys = dealt.select("text_sha256", "part", "salt").distinct()
    spread = keys.join(placed, ["text_sha256", "part"])
    settled = scratch.save(dealt.join(spread, ["text_sha256", "part", "salt"]).select("doc_id", "size", "text_crc32", "text_sha256", "row", "shard"), "settled")
    return numbered(settled, ["shard"], ["doc_id", "text_sha256", "row"], "slot", pieces).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
