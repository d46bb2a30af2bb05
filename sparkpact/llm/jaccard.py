"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles. Sets that could link are brought together exactly (no link
can be missed): hash space is cut into parts, more than two linked sets can differ in, so that
they agree on a number of parts. A set that agrees with others on fewer parts than any link needs is
dropped, and of the rest only the rarest parts count, as many as a link cannot do without; so a
passage that many documents share brings none of them together. Sets joined by what is left form a
cluster. Inside a cluster, signature trees hold OR-combined token bitmaps and size ranges; a dual traversal drops node
pairs by the largest overlap they could have, and exact intersections decide what is left.

Clusters over a block are dealt out as pairs of blocks, so no task holds a large cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, join_spread, split_count, tidy, whole_row
from .components import Union, components, tree_edges
from .tokens import blocks

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BITS = 2048
BELOW = 0x5A5A5A5A5A5A5A5A


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in a row, words of each text); A-Z are lower-cased."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", "u1")
    space = SPACE[data]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return np.zeros(0, "u8"), np.zeros(len(texts), "i8")
    ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
    sizes = ends - starts
    powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, K1, "u8"))
    chars = data[~space].astype("u8") + np.uint64(1)
    at = np.cumsum(sizes) - sizes
    chars *= powers[np.arange(len(chars)) - np.repeat(at, sizes)]
    hashes = mix(np.add.reduceat(chars, at) + sizes.astype("u8"))
    edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.diff(np.searchsorted(starts, edges))


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than n words is one shingle."""
    words, counts = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - n + 1), "u8")
    for k in range(n):
        grams = grams * K1 + words[k : k + len(grams)]
    grams = mix(grams)
    at = 0
    for m in counts.tolist():
        if m >= n:
            yield np.unique(grams[at : at + m - n + 1])
        elif m:
            whole = np.uint64(m)
            for w in words[at : at + m]:
                whole = np.uint64((int(whole) * int(K1) + int(w)) % 2**64)
            yield mix(np.array([whole], "u8"))
        else:
            yield np.zeros(0, "u8")
        at += m


class Parts:
    """Which parts two linked sets must agree on.

    Sets of level e have sizes low[e]..high[e] and meet the sets of the next level as well, as
    high[e + 1] >= high[e] / share. Sets of a level's pair differ in at most `differ` shingles, so of
    differ + 1 + spare parts at least spare + 1 agree. Parts with fewer than `weak` shingles say little; a
    set with at most `spare` of them leaves them out, any other gives all its parts that hold any. If a pair
    agrees on weak parts only, these are more than `spare`, and both give them. Empty parts, in which very many
    sets agree, count only for a set with shingles in so few parts that a link could differ in all of these."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        # the lower the share, the more parts there are and the smaller they get
        self.weak, self.tenths = (3, 4) if percent >= 85 else (2, 6) if percent >= 75 else (1, 6)
        self.high = [1]
        while self.high[-1] < largest:
            self.high.append(self.high[-1] * 100 // percent + (self.high[-1] * 100 % percent > 0))
            if self.high[-1] <= self.high[-2]:
                self.high[-1] = self.high[-2] + 1
        self.bounds = np.array(self.high)

    def differ(self, level: int) -> int:
        a = self.high[level]
        b = a * 100 // self.percent
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, needs) of a sorted distinct set, at its own level and the one below. A need is
        the least number of signatures of that level that any linked set shares; below, it is negative."""
        found, needs = [], []
        level = int(np.searchsorted(self.bounds, len(own))) if len(own) else -1
        for e in (level, level - 1):
            if e < 0 or not (d := self.differ(e)):
                continue  # sets that may differ in nothing are equal, and equal sets are one
            spare = d * self.tenths // 10 + 2
            m = d + 1 + spare
            part = ((own >> np.uint64(20)) % np.uint64(m)).astype("i8")
            order = np.argsort(part, kind="stable")
            part = part[order]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(begin, len(part)))
            sums = np.add.reduceat(mix(own[order] ^ K3), begin)
            strong = size >= self.weak
            which = part[begin]
            left_out = m - int(strong.sum())
            largest = len(own) * 100 // self.percent if e == level else self.high[e]
            most = (len(own) + largest) * (100 - self.percent) // (100 + self.percent)
            need = m - most - left_out
            if left_out <= spare:
                which, sums = which[strong], sums[strong]
            else:
                need = m - most - spare  # the other set may leave out as many
                if len(which) > most:  # some part that holds shingles agrees with any linked set
                    need = min(need, len(which) - most)
                else:  # so few parts hold any that a link may agree on empty ones alone
                    empty = np.setdiff1d(np.arange(m), which, assume_unique=True)
                    which, sums = np.append(which, empty), np.append(sums, np.zeros(len(empty), "u8"))
            need = min(max(1, need), 32_000)
            salt = np.array([e + 1], "u8") * K2
            found.append(mix(sums + mix(which.astype("u8") * K1 + salt)))
            needs.append(np.full(len(which), need if e == level else -need, "i2"))
        if not found:
            return np.zeros(0, "u8"), np.zeros(0, "i2")
        return np.concatenate(found), np.concatenate(needs)


def set_key(own: np.ndarray) -> int:
    """One 64-bit number for a set."""
    folded = np.bitwise_xor.reduce(own * K1, keepdims=True) + np.add.reduce(mix(own), keepdims=True) * K2 + np.uint64(len(own))
    return int(mix(folded).view("i8")[0])


def dealt(bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row per bucket with the bytes of each column's entries."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, "i8")
    cuts = list(zip(at.tolist(), np.append(at[1:], len(bucket)).tolist()))
    made = {"bucket": pa.array(bucket[at].astype("i4"), pa.int32())}
    for name, x in columns.items():
        x = x[order]
        made[name] = pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
    return pa.table(made)


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def text_hash() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n and key of every document's set, and a hash of its text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1).to_pylist(), 500_000):
                sets = list(shingle_sets(texts, shingle))
                made = [batch.column(0).slice(first, len(texts)), pa.array(list(map(len, sets)), pa.int64()), pa.array([set_key(s) if len(s) else 0 for s in sets], pa.int64()), batch.column(2).slice(first, len(texts))]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "key", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash()).mapInArrow(run, "doc_id long, n long, key long, text_hash long")


ENTRIES = "bucket int, sig binary, key binary, need binary"


def sign(docs: DataFrame, shingle: int, parts: Parts, buckets: int) -> DataFrame:
    """Blocks of signatures by bucket, with the key of their set and its need."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets", int)
        seen: set[int] = set()
        made: list[tuple] = []

        def block():
            sig, need = (np.concatenate([h[k] for h in made]) for k in (0, 1))
            key = np.repeat(np.array([h[2] for h in made], "i8"), [len(h[0]) for h in made])
            made.clear()
            return dealt((sig >> np.uint64(8)) % np.uint64(buckets), sig=sig, key=key, need=need).to_batches()

        size = 0
        for batch in batches:
            for _, texts in blocks(batch.column(0).to_pylist(), 500_000):
                for own in shingle_sets(texts, shingle):
                    if len(own) and (key := set_key(own)) not in seen:  # copies in this task sign once
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        made.append((*parts.signatures(own), key))
                        size += len(made[-1][0])
                if size > 500_000:
                    yield from block()
                    size = 0
        if size:
            yield from block()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, ENTRIES)


def by_signature(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(sig, key, need, sets that share the signature) of the signatures that several sets share."""
    sig, key, need = (joined(group, c, k) for c, k in (("sig", "u8"), ("key", "i8"), ("need", "i2")))
    order = np.lexsort((key, sig))
    sig, key, need = sig[order], key[order], need[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) if len(sig) else np.zeros(0, bool)
    sig, key, need = sig[once], key[once], need[once]
    at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, "i8")
    n = np.diff(np.append(at, len(sig)))
    size = np.repeat(n, n)
    keep = size > 1
    return sig[keep], key[keep], need[keep], size[keep].astype("i4")


def shared(blocks_: DataFrame, homes: int) -> DataFrame:
    """Entries whose signature several sets share, sent to the home of their set."""

    @tidy
    def run(group: pa.Table) -> pa.Table:
        sig, key, need, size = by_signature(group)
        return dealt(np.mod(key, homes), sig=sig, key=key, need=need, size=size)

    return blocks_.groupBy("bucket").applyInArrow(run, ENTRIES + ", size binary")


def needed(entries: DataFrame, buckets: int, rarest: bool) -> DataFrame:
    """Entries of the sets that share as many signatures as a link needs; with `rarest`, only as many
    of the least shared ones as must hold one in common with any linked set."""

    @tidy
    def run(group: pa.Table) -> pa.Table:
        sig, key, need, size = (joined(group, c, k) for c, k in (("sig", "u8"), ("key", "i8"), ("need", "i2"), ("size", "i4")))
        order = np.lexsort((sig, size, need < 0, key))
        sig, key, need = sig[order], key[order], need[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | ((need[1:] < 0) != (need[:-1] < 0)))) if len(key) else np.zeros(0, "i8")
        n = np.diff(np.append(at, len(key)))
        nth, count, least = np.arange(len(key)) - np.repeat(at, n), np.repeat(n, n), np.abs(need.astype("i8"))
        keep = nth < count - least + 1 if rarest else count >= least
        sig, key, need = sig[keep], key[keep], need[keep]
        return dealt((sig >> np.uint64(8)) % np.uint64(buckets), sig=sig, key=key, need=need)

    return entries.groupBy("bucket").applyInArrow(run, ENTRIES)


def agreements(entries: DataFrame) -> DataFrame:
    """(a, b): sets that agree on a signature, as a spanning forest per bucket. A set is its key at its
    own level and the key's other half at the level below, so that no cluster runs through levels."""

    @tidy
    def run(group: pa.Table) -> pa.Table:
        sig, key, need, _ = by_signature(group)
        key = np.where(need > 0, key, key ^ BELOW)
        nodes, at = np.unique(key, return_inverse=True)
        union = Union(len(nodes))
        pair = np.flatnonzero(sig[1:] == sig[:-1])
        for a, b in np.unique(np.stack([at[pair], at[pair + 1]], 1), axis=0).tolist() if len(pair) else ():
            union.join(a, b)
        a, b = tree_edges(nodes, union.roots())
        return pa.table({"a": a, "b": b})

    return entries.groupBy("bucket").applyInArrow(run, "a long, b long")


class Tree:
    """A signature tree over sets: nodes hold the OR of token bitmaps and ranges of size.

    Level 0 are the sets, ordered by their least token, which near copies mostly share; each node above
    takes up to `fan` below it. `excess` is the most tokens by which a set below outnumbers its bits."""

    def __init__(self, sets: list[np.ndarray], fan: int = 4):
        self.order = np.array(sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k]))), "i8")
        self.fan = fan
        size = np.array([len(sets[k]) for k in self.order])
        bits = np.zeros((len(sets), BITS), bool)
        for row, k in enumerate(self.order):
            bits[row, (sets[k] >> np.uint64(3)) % np.uint64(BITS)] = True
        excess = size - bits.sum(1)
        words = np.packbits(bits, axis=1).view("u8")
        self.levels = [(words, size, size, excess)]
        while len(size) > 1:
            words, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            size = self.levels[-1][1]

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) of all children."""
        child = nodes[:, None] * self.fan + np.arange(self.fan)
        ok = child < len(self.levels[level - 1][1])
        return np.nonzero(ok)[0], child[ok]


def possible(x: Tree, y: Tree, percent: int, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether nodes a of x and b of y could hold a linked pair, by their largest overlap."""
    (wx, lx, hx, ex), (wy, ly, hy, ey) = x.levels[level], y.levels[level]
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 8192):
        i, j = a[s : s + 8192], b[s : s + 8192]
        shared = np.bitwise_count(wx[i] & wy[j]).sum(1).astype("i8") + np.minimum(ex[i], ey[j])
        most = np.minimum(np.minimum(hx[i], hy[j]), shared)
        out[s : s + 8192] = most * (100 + percent) >= percent * (lx[i] + ly[j])
    return out


def candidates(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of x.order, y.order) that the dual traversal could not rule out; both trees have
    the same height. For x is y, each pair once."""
    level = len(x.levels) - 1
    a, b = np.zeros(1, "i8"), np.zeros(1, "i8")
    while level:
        ok = possible(x, y, percent, level, a, b)
        a, b = a[ok], b[ok]
        at, ca = x.below(level, a)
        bt, cb = y.below(level, b[at])
        a, b = ca[bt], cb
        level -= 1
        if x is y:
            half = a <= b
            a, b = a[half], b[half]
    ok = possible(x, y, percent, 0, a, b)
    if x is y:
        ok &= a < b
    return x.order[a[ok]], y.order[b[ok]]


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(p, q, assume_unique=True).size
    return 100 * both >= percent * (len(p) + len(q) - both)


def join_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Roots of the components among `sets`. side 0 and 1: two blocks of a cluster, of which only
    pairs across are wanted; all 0: all pairs. Pairs already connected are not intersected."""
    union = Union(len(sets))
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return union.roots()
        x, y = Tree([sets[k] for k in left]), Tree([sets[k] for k in right])
        for short, tall in ((x, y), (y, x)):
            while len(short.levels) < len(tall.levels):
                short.levels.append(short.levels[-1])
        a, b = candidates(x, y, percent)
        a, b = left[a], right[b]
    else:
        x = Tree(sets)
        for i, j in zip(x.order[:-1].tolist(), x.order[1:].tolist()):
            if linked(sets[i], sets[j], percent):
                union.join(i, j)
        a, b = candidates(x, x, percent)
    while len(a):
        roots = union.roots()
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        for i, j in zip(a[:2000].tolist(), b[:2000].tolist()):
            if union.find(i) != union.find(j) and linked(sets[i], sets[j], percent):
                union.join(i, j)
        a, b = a[2000:], b[2000:]
    return union.roots()


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, block: int = 1024, most_broadcast: int = 400_000) -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    Two documents link when 100 * intersection >= percent * union of their distinct shingles of words
    (white space is ASCII, A-Z are lower-cased); fewer words than `shingle` are one shingle. Null and
    empty texts have no shingle and link with nothing. Repeated rows are equal sets and so
    link; null doc_ids are kept and never name a component that has another id. Very long texts count whole,
    and ties in similarity make no difference. An empty table gives no rows. Other columns, of whatever
    name, are ignored."""
    return jaccard_rows(docs, shingle, percent, block, most_broadcast).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, shingle: int, percent: int, block: int = 1024, most_broadcast: int = 400_000) -> DataFrame:
    """As jaccard_components, with text_hash and component_key, a number for the component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    n_rows = docs.count()
    buckets = split_count(n_rows, 1000, 64)
    rows = scratch.save(describe(docs, shingle), "rows")
    entries = scratch.save(shared(sign(docs, shingle, Parts(percent), buckets), buckets), "shared")
    fewer = split_count(n_rows, 16_000, 16)  # most signatures are gone by now
    entries = needed(entries, fewer, False)
    entries = needed(shared(entries, fewer), fewer, False)
    entries = needed(shared(entries, fewer), fewer, True)
    near = scratch.save(agreements(entries), "near")
    scratch.drop("shared")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("text_hash").alias("hash"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.save(classes, "classes")
    roles = classes.select("key", F.explode(F.array("key", F.col("key").bitwiseXOR(F.lit(BELOW)))).alias("node"))
    clusters = components(near, scratch, "clusters").join(roles, "node").select("key", F.col("root").alias("cluster"))
    clusters = scratch.save(clusters, "members")
    large = clusters.groupBy("cluster").count().where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    # fewer than keys / block rows
    placed = clusters.join(F.broadcast(large), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    wanted = scratch.save(placed.join(classes, "key").select("key", "cluster", "blocks", "block", "rep", "hash"), "wanted")
    n_wanted, n_named = wanted.agg(F.count(F.lit(1)), F.count("rep")).first()
    by_id, by_text = wanted.where("rep is not null").drop("hash"), wanted.where("rep is null").drop("rep")
    if n_wanted <= most_broadcast:  # 40 bytes a row
        by_id, by_text = F.broadcast(by_id), F.broadcast(by_text)

    @tidy
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in blocks(batch.column("text").to_pylist(), 500_000):
                own = [s for s in shingle_sets(run, shingle)]
                part = batch.slice(first, len(run))
                good = pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(own, part.column("key").to_pylist())])
                made = [*(part.column(c) for c in ("key", "cluster", "blocks", "block")), pa.array([s.tobytes() for s in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["key", "cluster", "blocks", "block", "tokens"]).filter(good)

    kind, columns = "key long, cluster long, blocks int, block int, tokens binary", ["text", "key", "cluster", "blocks", "block"]
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"), text_hash().alias("hash"))
    sets = texts.join(by_id, "rep").select(*columns).mapInArrow(tokens, kind)
    if n_named < n_wanted:  # sets whose rows all have no doc_id: by their text, once a cluster
        unnamed = texts.where("rep is null").join(by_text, "hash").select(*columns).mapInArrow(tokens, kind)
        sets = sets.unionByName(unnamed.dropDuplicates(["key", "cluster"]))
    # one task for every pair of blocks; small clusters share tasks
    bins = split_count(n_wanted, 500, 64)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = sets.withColumn("other", other).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", low, high)).alias("task"),
        "cluster", "key", "tokens", (F.col("block") > F.col("other")).cast("int").alias("side"),
    )

    @tidy
    def verify(group: pa.Table) -> pa.Table:
        cluster, key = group.column("cluster").to_numpy(), group.column("key").to_numpy()
        side, tokens_ = group.column("side").to_numpy(), group.column("tokens")
        out_a, out_b = [], []
        order = np.lexsort((key, cluster))
        cuts = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
        for rows_ in np.split(order, cuts[1:]):
            rows_ = rows_[np.append(True, key[rows_][1:] != key[rows_][:-1])]
            own = [np.frombuffer(tokens_[int(k)].as_py(), "u8") for k in rows_]
            a, b = tree_edges(key[rows_], join_sets(own, side[rows_], percent))
            out_a.append(a), out_b.append(b)
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    links = scratch.save(dealt.groupBy("task").applyInArrow(verify, "a long, b long"), "links")
    joined = components(links, scratch, "components")
    named = joined.join(classes, joined["node"] == classes["key"]).select("node", "root", "rep")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_key = scratch.save(classes.select("key", "rep").join(named.select(F.col("node").alias("key"), "root").join(smallest, "root").select("key", "component", "root"), "key", "left").select("key", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "key").alias("root")), "of-key")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return join_spread(rows, of_key, "key", ["doc_id", "text_hash"], how="left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", F.col("root").alias("component_key"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, most_broadcast: int = 400_000) -> DataFrame:
    """`docs` with one row of each group of linked documents, the one of the smallest doc_id (null
    last; then the smallest hash of the text, then any of rows equal in both). Rows without any shingle, null and
    empty texts among them, all stay. Very long texts count whole. Columns, of whatever name, stay as they are."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows = scratch.save(jaccard_rows(docs, shingle, percent).where("n_shingles > 0"), "rows")
    who = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = rows.groupBy("component_key").agg(F.min(who).alias("first"))
    marked = join_spread(rows, first, "component_key", ["doc_id", "text_hash"]).withColumn("loses", who != F.col("first"))
    lost = scratch.save(marked.where("loses").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "lost")
    twice = scratch.save(marked.where("not loses").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).count().where("count > 1"), "twice")
    small = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df  # noqa: E731  16 bytes a row
    same = F.col("own_id").eqNullSafe(F.col("_doc")) & (F.col("own_hash") == F.col("_hash"))
    keyed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_hash"))  # no name of docs' own clashes
    left = keyed.join(small(lost), same, "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    once = left.join(small(twice.drop("count")), same, "left_semi").groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
    return left.join(small(twice.drop("count")), same, "left_anti").select("row").unionByName(once.select("row")).select("row.*")
