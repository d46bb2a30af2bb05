"""Suffix-array dedup: every byte covered by a long string that also starts earlier goes.

All suffixes of a corpus need not meet in one sort. Each window of `width` bytes has a minimizer, the
k-gram of least hash inside it, which its content alone decides; so equal windows have equal
minimizers at the same offset, and the suffix set can be dealt out by minimizer without parting
equal windows. Minimizers that occur once are dropped (their windows are unique). For the others the
text around them is brought together; equal stretches are told by their bytes and folded. The suffixes of the
stretches that differ are sorted by the difference-cover algorithm: sort sampled triples, recurse on their
names, merge the remaining suffixes, then compare adjacent prefixes. Sorting only has to be right for `width` bytes.

So the difference cover runs in many sorts, one for each part of the suffix set, and not as one sort across
the cluster: names of triples are not shuffled, and a corpus-wide suffix array is never made. Copies
that are equal as whole stretches are found by comparing bytes and need no sort.

A passage that very many documents share is folded where it is found, once per task, so that no task
gets all of its occurrences; its different surroundings all meet at its minimizers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held, split_count, tidy, whole_row
from .jaccard import mix

GRAM = 20
PRIME, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK, PLACE = 1 << 18, np.uint64((1 << 21) - 1)
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", PRIME), ("down", INVERSE)):
                x = np.full(n, base, "u8")
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def minimizers(data: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` bytes the place of its minimizer, the leftmost if tied."""
    span = width - GRAM + 1
    out = np.empty(max(0, len(data) - width + 1), "i8")
    for s in range(0, len(out), CHUNK):
        part = data[s : s + CHUNK + width - 1]
        n = len(part) - width + 1
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, "u8")
        np.cumsum((part.astype("u8") + np.uint64(1)) * up[: len(part)], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams &= ~PLACE
        low = grams | np.arange(len(grams), dtype="u8")
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:n], low[span - size : span - size + n])
        out[s : s + n] = (low[:n] & PLACE).astype("i8") + s
    return out


def runs(raw: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Windows that share a minimizer, as runs: (text, number within the text, first window,
    windows, minimizer's place after the first window, hash of the minimizer).

    They depend on each text alone, not on what else is in `raw`."""
    sizes = np.fromiter(map(len, raw), "i8", len(raw))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw), "u1")
    long_ = np.flatnonzero(sizes >= width)
    if not len(long_):
        return tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "i8", "u8"))
    place = minimizers(data, width)
    first, end = starts[long_], starts[long_] + sizes[long_] - width + 1
    valid = np.zeros(len(place) + 1, "i1")
    valid[first] += 1
    np.add.at(valid, end, -1)
    valid = np.cumsum(valid[:-1], dtype="i1").astype(bool)
    begin = np.append(True, place[1:] != place[:-1])
    begin[first] = True
    at = np.flatnonzero(begin & valid)
    of = np.searchsorted(first, at, "right") - 1
    stop = np.minimum(np.append(at[1:], len(place)), end[of])
    number = np.arange(len(at)) - np.searchsorted(of, np.arange(len(long_)))[of]
    grams = np.zeros(len(at), "u8")
    up, _ = powers(GRAM)
    for k in range(GRAM):
        grams += (data[place[at] + k].astype("u8") + np.uint64(1)) * up[k]
    return long_[of], number, at - first[of], stop - at, place[at] - at, mix(grams)


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sort key of two; dense numbers where they would not fit in 63 bits."""
    bits = lambda x: int(x.max()).bit_length() if len(x) else 0
    if bits(a) + bits(b) > 63:
        a = np.unique(a, return_inverse=True)[1]
    if bits(a) + bits(b) > 63:
        b = np.unique(b, return_inverse=True)[1]
    return a.astype("i8") << bits(b) | b


def below(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of `ordered` are less than each x; asked in order, which keeps the search local."""
    order = np.argsort(x)
    out = np.empty(len(x), "i8")
    out[order] = np.searchsorted(ordered, x[order])
    return out


def suffix_ranks(t: np.ndarray, limit: int) -> np.ndarray:
    """Ranks from 1 of all suffixes of t (symbols from 1), in order by their first `limit` symbols at
    least: suffixes alike in these have ranks side by side. Difference cover of 3."""
    n = len(t)
    s = np.concatenate([t, np.zeros(4, "i8")]).astype("i8")
    p0, p1, p2 = (np.arange(k, n, 3) for k in range(3))
    sample = np.concatenate([p1, p2])
    key = pack(pack(s[sample], s[sample + 1]), s[sample + 2])
    ordered, name = np.unique(key, return_inverse=True)
    name += 1
    if len(ordered) < len(sample) and limit > 3:
        deeper = suffix_ranks(np.concatenate([name[: len(p1)] + 1, [1], name[len(p1) :] + 1]), -(-limit // 3))
        name = np.delete(deeper, len(p1))
    rank = np.zeros(n + 4, "i8")
    rank[sample] = name
    # remaining suffixes: by first symbol and the sampled suffix behind it
    both = pack(s[np.concatenate([p0, p1])], rank[np.concatenate([p0, p1]) + 1])
    a0, a1 = both[: len(p0)], both[len(p0) :]
    q = np.concatenate([p0, p2])
    three = pack(pack(s[q], s[q + 1]), rank[q + 2])
    b0, b2 = three[: len(p0)], three[len(p0) :]
    out = np.zeros(n, "i8")
    names = np.sort(name)
    out[p0] = below(np.sort(a0), a0) + below(np.sort(a1), a0) + below(np.sort(b2), b0)
    out[p1] = below(names, name[: len(p1)]) + below(np.sort(a0), a1)
    out[p2] = below(names, name[len(p1) :]) + below(np.sort(b0), b2)
    return out + 1


def equal_windows(stretches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, window, class) of all windows of the stretches; equal windows have equal classes."""
    sizes = np.fromiter(map(len, stretches), "i8", len(stretches))
    text = np.frombuffer(b"\0".join(stretches) + b"\0", "u1")
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = text.astype("i8") + 2
    symbols[starts + sizes] = 1
    rank = suffix_ranks(symbols, width)
    counts = sizes - width + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[of] + window
    order = np.argsort(rank[at], kind="stable")
    at_sorted = at[order]
    same = np.zeros(len(order), bool)
    for k in range(0, len(order) - 1, 65536):  # compare adjacent prefixes
        a, b = at_sorted[k : k + 65536], at_sorted[k + 1 : k + 65537]
        a = a[: len(b)]
        alike = np.ones(len(b), bool)
        for j in range(0, width, 20):
            left = np.flatnonzero(alike)
            cols = np.arange(j, min(j + 20, width))
            alike[left] = (text[a[left, None] + cols] == text[b[left, None] + cols]).all(1)
        same[k + 1 : k + 1 + len(b)] = alike
    classes = np.empty(len(order), "i8")
    classes[order] = np.cumsum(~same)
    return of, window, classes


def stretch_marks(groups: dict, width: int, most: int = 1 << 18) -> Iterator[tuple]:
    """(key, start, end) of bytes to remove. groups: hash -> {stretch: [(doc, key, start), ...]}."""
    apart: list[tuple[bytes, tuple]] = []

    def settle():
        if not apart:
            return
        of, window, classes = equal_windows([s for s, _ in apart], width)
        places = [p for _, p in apart]
        by_place = sorted(range(len(places)), key=places.__getitem__)
        turn = np.empty(len(places), "i8")
        turn[by_place] = np.arange(len(places))
        # the first of a class: smallest document, then start; stretches of one text may overlap
        doc_turn = np.zeros(len(places), "i8")
        step = [0, *(int(places[a][:2] != places[b][:2]) for a, b in zip(by_place, by_place[1:]))]
        doc_turn[by_place] = np.cumsum(step)
        start = np.fromiter((p[2] for p in places), "i8", len(places))[of] + window
        order = np.lexsort((start, doc_turn[of], classes))
        first = np.append(True, classes[order][1:] != classes[order][:-1])
        marked = np.zeros(len(of), bool)
        marked[order[~first]] = True
        edge = np.flatnonzero(marked & np.append(True, ~(marked[:-1] & (of[1:] == of[:-1]))))
        stop = np.flatnonzero(marked & np.append(~(marked[1:] & (of[1:] == of[:-1])), True))
        for a, b in zip(edge.tolist(), stop.tolist()):
            key = places[of[a]][1]
            yield key, int(start[a]), int(start[b]) + width
        apart.clear()

    size = 0
    for stretches in groups.values():
        for stretch, places in stretches.items():
            if len(places) > 1:
                least = min(places)
                for p in places:
                    if p is not least:
                        yield p[1], p[2], p[2] + len(stretch)
                places[:] = [least]
        if len(stretches) > 1:
            apart += [(s, p[0]) for s, p in stretches.items()]
            size += sum(len(s) + 1 for s in stretches)
            if size > most:
                yield from settle()
                size = 0
    yield from settle()


def dealt(bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row per bucket with the bytes of each column's entries."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, "i8")
    ends = np.append(at[1:], len(bucket))
    made = {"bucket": pa.array(bucket[at].astype("i4"), pa.int32())}
    for name, x in columns.items():
        x = x[order]
        made[name] = pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())], pa.binary())
    return pa.table(made)


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def texts_in(raw: list[bytes], size: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    first, run, n = 0, [], 0
    for i, b in enumerate(raw):
        run.append(b)
        n += len(b)
        if n >= size:
            yield first, run
            first, run, n = i + 1, [], 0
    if run:
        yield first, run


def once_each(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(rows with one of each key, (key, copies) of keys that several rows have; None if there are none).

    Repeated rows are counted by key and then thinned before the shuffle, so they meet in no task."""
    twice = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twice")
    if twice.isEmpty():
        return rows, None
    alone = rows.join(twice, "key", "left_anti")
    first = rows.join(twice, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in rows.columns if c != "key"))
    return scratch.save(alone.unionByName(first), "once"), twice


def with_marks(rows: DataFrame, scratch: Scratch, width: int, part_rows: int, finish, made: str | T.StructType) -> DataFrame:
    """What `finish` makes of rows (doc_id, raw, key, ...), all of at least `width` bytes and each key once:
    of a table of some rows and, for each of them, the bytes left, their number removed and the runs removed."""
    n_buckets = split_count(rows.count(), part_rows, 64)
    home = lambda key: np.mod(key, n_buckets)

    @tidy
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("suffixes", int)
        found: list[tuple] = []

        def flush():
            of, number, grams = (np.concatenate(x) for x in zip(*found))
            found.clear()
            bucket = (grams >> np.uint64(32)) % np.uint64(n_buckets)
            short = grams.astype("u4")
            # of equal minimizers in this flush one goes on, with a mark that it is repeated
            order = np.lexsort((short, bucket))
            same = np.append(False, (short[order][1:] == short[order][:-1]) & (bucket[order][1:] == bucket[order][:-1]))
            repeated = (same | np.append(same[1:], False)).astype("u1")
            sent = np.where(same, 2, repeated).astype("u1")  # 2: known to be repeated, nothing to compare
            return dealt(bucket[order], gram=short[order], key=of[order], number=number[order].astype("u4"), state=sent).to_batches()

        for batch in batches:
            texts, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for first, run in texts_in(texts):
                of, number, _, _, _, grams = runs(run, width)
                found.append((keys[first + of], number, grams))
            if sum(len(f[0]) for f in found) > 500_000:
                yield from flush()
        if found:
            yield from flush()

    sent = rows.select("raw", "key").mapInArrow(anchors, "bucket int, gram binary, key binary, number binary, state binary")

    @tidy
    def repeated(group: pa.Table) -> pa.Table:
        gram, key, number, state = (joined(group, c, k) for c, k in (("gram", "u4"), ("key", "i8"), ("number", "u4"), ("state", "u1")))
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = g[1:] == g[:-1]
        often = np.append(same, False) | np.append(False, same) | (state[order] > 0)
        keep = order[often]
        return dealt(home(key[keep]), key=key[keep], number=number[keep])

    again = scratch.save(sent.groupBy("bucket").applyInArrow(repeated, "bucket int, key binary, number binary"), "again", lean=True)
    by_home = rows.withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int"))

    @tidy
    def stretches(own: pa.Table, found: pa.Table) -> pa.Table:
        key, number = joined(found, "key", "i8"), joined(found, "number", "u4")
        wanted: dict[int, list[int]] = {}
        for k, i in zip(key.tolist(), number.tolist()):
            wanted.setdefault(k, []).append(i)
        keys, ids, raws = own.column("key").to_pylist(), own.column("doc_id").to_pylist(), own.column("raw").to_pylist()
        pick = [i for i, k in enumerate(keys) if k in wanted]
        first_at: dict[tuple, tuple] = {}
        marks: list[tuple[int, int, int]] = []
        for first, run in texts_in([raws[i] for i in pick]):
            of, nth, begin, count, pre, grams = runs(run, width)
            edges = np.searchsorted(of, np.arange(len(run) + 1))
            for j, text in enumerate(run):
                i = pick[first + j]
                place = (-1 << 63 if ids[i] is None else ids[i], keys[i])
                rows = edges[j] + np.unique(np.array(wanted[keys[i]]))
                for b, c, p, g in zip(begin[rows].tolist(), count[rows].tolist(), pre[rows].tolist(), grams[rows].tolist()):
                    what, here = (g, p, text[b : b + c + width - 1]), (*place, b)
                    there = first_at.setdefault(what, here)
                    if there is not here:  # the later of two equal stretches is marked at once
                        later = max(here, there)
                        first_at[what] = min(here, there)
                        marks.append((later[1], b if later is here else later[2], (b if later is here else later[2]) + c + width - 1))
        out = []
        if marks:
            k, a, b = (np.array(x, "i8") for x in zip(*marks))
            out.append(marks_table(k, a, b))
        if first_at:
            gram = np.fromiter((w[0] for w in first_at), "u8", len(first_at))
            doc, key_, start = (np.array(x, "i8") for x in zip(*first_at.values()))
            bucket = ((gram >> np.uint64(32)) % np.uint64(n_buckets)).astype("i4")
            sizes = np.fromiter((len(w[2]) for w in first_at), "i8", len(first_at))
            text = np.array([w[2] for w in first_at], dtype=object)
            order = np.lexsort((gram, bucket))
            at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            ends = np.append(at[1:], len(order))
            cut = [order[a:b] for a, b in zip(at, ends)]
            out.append(pa.table({
                "bucket": pa.array(bucket[order][at], pa.int32()),
                **{n: pa.array([x[c].tobytes() for c in cut], pa.binary()) for n, x in (("gram", gram), ("doc", doc), ("key", key_), ("start", start), ("size", sizes))},
                "text": pa.array([b"".join(text[c]) for c in cut], pa.binary()),
            }))
        empty = pa.table({n: pa.array([], t) for n, t in STRETCHES})
        return pa.concat_tables([empty, *(fit_to(t, STRETCHES) for t in out)])

    STRETCHES = [("bucket", pa.int32()), ("gram", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("text", pa.binary()), ("home", pa.int32()), ("mark", pa.binary())]

    def fit_to(table: pa.Table, fields: list) -> pa.Table:
        n = len(table)
        return pa.table({name: table.column(name) if name in table.column_names else pa.nulls(n, kind) for name, kind in fields})

    def marks_table(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        rows = np.stack([key, start, end], 1)
        made = dealt(home(key), mark=rows)
        return made.rename_columns(["home", "mark"])

    slim = by_home.select("doc_id", "raw", "key", "bucket")
    found = slim.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(stretches, "bucket int, gram binary, doc binary, key binary, start binary, size binary, text binary, home int, mark binary")
    found = scratch.save(found, "stretches", lean=True)
    scratch.drop("again")

    @tidy
    def sort_suffixes(group: pa.Table) -> pa.Table:
        gram, doc, key, start, size = (joined(group, c, k) for c, k in (("gram", "u8"), ("doc", "i8"), ("key", "i8"), ("start", "i8"), ("size", "i8")))
        text, at = b"".join(group.column("text").to_pylist()), 0
        groups: dict[int, dict[bytes, list]] = {}
        for g, d, k, b, n in zip(gram.tolist(), doc.tolist(), key.tolist(), start.tolist(), size.tolist()):
            groups.setdefault(g, {}).setdefault(text[at : at + n], []).append((d, k, b))
            at += n
        made = list(stretch_marks(groups, width))
        if not made:
            return pa.table({"home": pa.array([], pa.int32()), "mark": pa.array([], pa.binary())})
        return marks_table(*(np.array(x, "i8") for x in zip(*made)))

    marks = found.where("bucket is not null").select("bucket", "gram", "doc", "key", "start", "size", "text").groupBy("bucket").applyInArrow(sort_suffixes, "home int, mark binary")
    marks = scratch.save(marks.union(found.where("home is not null").select("home", "mark")).withColumnRenamed("home", "bucket"), "marks", lean=True)
    scratch.drop("stretches")

    @tidy
    def collect(own: pa.Table, found: pa.Table) -> pa.Table:
        rows_ = joined(found, "mark", "i8").reshape(-1, 3)
        rows_ = rows_[np.lexsort((rows_[:, 1], rows_[:, 0]))]
        keys, first = np.unique(rows_[:, 0], return_index=True)
        where = dict(zip(keys.tolist(), zip(first.tolist(), np.append(first[1:], len(rows_)).tolist())))
        cuts = ((raw.as_py(), *where.get(k, (0, 0))) for raw, k in zip(own.column("raw"), own.column("key").to_pylist()))
        return finish(own, [cut_out(raw, spans_union(rows_[a:b, 1:])) for raw, a, b in cuts])

    return by_home.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(collect, made)


def spans_union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows sorted by start."""
    if not len(spans):
        return np.zeros((0, 2), "i8")
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


def cut_out(raw: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed)."""
    left, at = [], 0
    for a, b in spans.tolist():
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    kept = b"".join(left)
    return kept, len(raw) - len(kept), len(spans)


def bytes_of(docs: DataFrame) -> DataFrame:
    """doc_id, raw, key and rest: all columns but the text."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.encode(raw, "UTF-8").alias("raw"), F.xxhash64(doc_id, raw).alias("key"), whole_row(docs.drop("text")).alias("rest"))


def suffix_spans(docs: DataFrame, width: int = 100, part_rows: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row.

    Null texts are empty; texts shorter than `width` bytes lose nothing. Very long texts are read whole,
    in stretches. Documents come by doc_id, null first; rows of one doc_id come by a hash of their text,
    and rows equal in both lose everything but in one of them (if they have `width` bytes). An empty
    table gives no rows. Other columns, of whatever name, are ignored."""
    scratch = Scratch(docs.sparkSession, "suffix")
    base = bytes_of(docs.select("doc_id", "text")).drop("rest")
    own, twice = once_each(base.where(F.octet_length("raw") >= width), scratch)

    def digest(rows: pa.Table, cuts: list) -> pa.Table:
        sizes = pa.array([len(kept) + removed for kept, removed, _ in cuts], pa.int64())
        return pa.table({
            "doc_id": rows.column("doc_id"), "key": rows.column("key"), "n_bytes": sizes, "n_removed": pa.array([c[1] for c in cuts], pa.int64()),
            "n_spans": pa.array([c[2] for c in cuts], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts], pa.string()),
        })

    out = with_marks(own, scratch, width, part_rows, digest, "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if twice is not None:
        out = scratch.save(out, "digests")
        again = out.join(twice, "key").withColumn("_", F.explode(F.expr("sequence(2, copies)")))
        gone = again.select("doc_id", "key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
        out = out.unionByName(gone)
    zero = F.lit(0).cast("long")
    short = base.where(F.octet_length("raw") < width).select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"))
    return out.drop("key").unionByName(short)


def cut_repeats(docs: DataFrame, width: int = 100, part_rows: int = 1000) -> DataFrame:
    """`docs` with repeated passages taken out of the text and n_chars (where it is a column) counted
    anew. A character that loses a byte goes whole. Rows of which nothing is left are dropped, and so
    all but one of rows equal in doc_id and text with at least `width` bytes; shorter texts, null and
    empty ones among them, stay as they are. An empty table gives no rows; other columns stay."""
    scratch = Scratch(docs.sparkSession, "cut-repeats")
    long_ = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) >= width
    own, _ = once_each(bytes_of(docs.where(long_)), scratch)

    def left(rows: pa.Table, cuts: list) -> pa.Table:
        return pa.table({"rest": rows.column("rest"), "text": pa.array([c[0].decode("utf-8", "ignore") for c in cuts], pa.string())})

    out = with_marks(own, scratch, width, part_rows, left, T.StructType([own.schema["rest"], T.StructField("text", T.StringType())])).where(F.length("text") > 0)
    column = lambda c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`")
    cut = out.select(*(F.col("text") if c == "text" else column(c).alias(c) for c in docs.columns))
    return cut.unionByName(docs.where(~long_))
