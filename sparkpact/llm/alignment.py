"""Cross-tokenizer alignment: two vocabularies over the same bytes, and in how many documents ids are linked.

Where tokens of both end at the same byte, a text falls into groups; the ids of a group are linked. Documents lie
in blocks, and each block has for every pair of ids a compressed bitmap of its documents, with one bitmap
for each binary digit of how often a document links the pair (its multiplicity planes). OR of the planes is
the document bitmap, and its bits, added up over all blocks, are the pair's document count; the planes' bits,
weighed by their digit, its links. Counts then go back along the same postings to the documents of each block.

Neither vocabulary joins what lies on the two sides of a single blank or line break between other
characters, or a letter and a mark behind it. So a text is a row of small units that both encode
alike anywhere, and every distinct unit goes through the libraries once per worker. `Vocabularies` checks its
files for that; texts with characters in doubt go through the libraries whole."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held, small_batches, tidy
from .tokens import BYTES

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = r"!-/:-@\[-`{-~"
BLANK = r" \t\n\x0b\x0c\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf"[ \n]?[{LETTER}]+(?=[{BLANK}{MARK}]|\Z)|[{BLANK}]+[^{BLANK}]*|[^{BLANK}]+")
#: White space to one of the vocabularies or to Python only, and the sign that stands for a blank.
DOUBT = re.compile(r"[\x1c-\x1f\x85\u180e\u2581]")

ROWS = (
    "block long, width int, nth int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, docs int, bitmap binary, planes array<binary>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
OWN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def groups_of(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups between the byte offsets at which tokens of both end."""
    out, i, j, from_a, from_b, end_a, end_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a += size_a[a[i]]
            i += 1
        else:
            end_b += size_b[b[j]]
            j += 1
        if end_a == end_b:
            out.append((a[from_a:i], b[from_b:j]))
            from_a, from_b = i, j
    return out


class Vocabularies:
    """A byte-level vocabulary (A) and one of pieces (B), with what was learned of units."""

    def __init__(self, path_a: str, path_b: str, most: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        letters = {chr(c): b for b, c in BYTES.items()} | {chr(b): b for b in range(256) if b not in BYTES}
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i) or "" if c in letters) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        joins = re.compile(rf"[^▁]▁|\n|[{LETTER}][{MARK}]")
        self.apart = not any(joins.search(p) for p in plain)  # else every text goes whole
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.facts = np.zeros((1 << 14, 4), "i4")  # ids of A, ids of B, groups, links of a unit
        self.starts, self.counts, self.used = np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8"), 0
        self.pairs, self.times = np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i4")

    def _place(self, k: int, text: str, facts: tuple, pairs: dict[int, int]) -> None:
        for name, n in (("facts", k + 1), ("starts", k + 1), ("counts", k + 1), ("pairs", self.used + len(pairs)), ("times", self.used + len(pairs))):
            if n > len(have := getattr(self, name)):
                setattr(self, name, np.concatenate([have, np.zeros((max(n, 2 * len(have)) - len(have), *have.shape[1:]), have.dtype)]))
        self.texts.append(text)
        self.facts[k], self.starts[k], self.counts[k] = facts, self.used, len(pairs)
        end = self.used + len(pairs)
        self.pairs[self.used : end], self.times[self.used : end] = list(pairs), list(pairs.values())
        self.used = end

    def told(self, a: list[int], b: list[int], text: bytes) -> tuple[str, tuple, dict[int, int]] | None:
        """Groups as text, counts, and how often each pair (a * size of B + b) is linked; none if the bytes differ."""
        if b"".join(map(self.bytes_a.__getitem__, a)) != text or b"".join(map(self.bytes_b.__getitem__, b)) != text:
            return None
        groups = groups_of(a, b, self.size_a, self.size_b)
        pairs: dict[int, int] = {}
        links, wide = 0, len(self.size_b)
        for x, y in groups:
            links += len(x) * len(y)
            if len(x) == len(y) == 1:
                pairs[x[0] * wide + y[0]] = pairs.get(x[0] * wide + y[0], 0) + 1
                continue
            often = {i: y.count(i) for i in y} if len(y) < 64 else dict(zip(*(v.tolist() for v in np.unique(y, return_counts=True))))
            for i, n in ({i: x.count(i) for i in x} if len(x) < 64 else dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))).items():
                for j, m in often.items():
                    pairs[i * wide + j] = pairs.get(i * wide + j, 0) + n * m
        return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), (len(a), len(b), len(groups), links), pairs

    def learn(self, units: list[str]) -> None:
        """A unit on which the libraries' bytes differ gets -1 groups."""
        of_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        of_b = self.b.encode(["\n" + u for u in units], num_threads=1)  # behind the blank that B adds and the break: no unit joins them
        for u, a, b in zip(units, of_a, of_b):
            made = self.told(a, b[2:], u.encode())
            k = self.index[u] = len(self.index)
            self._place(k, *(made or ("", (0, 0, -1, 0), {})))

    def whole(self, text: str):
        """A text by both libraries as it is."""
        return self.told(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode())


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("alignment", path_a, path_b), lambda: Vocabularies(path_a, path_b))


def bitmaps(of: np.ndarray, places: np.ndarray, n: int, width: int) -> pa.BinaryArray:
    """Compressed bitmaps of n rows: places (16 bits each, rising), or bits where these take less room."""
    counts = np.bincount(of, minlength=n)
    full = (width + 7) // 8
    dense = 2 * counts >= full
    sizes = np.where(dense, full, 2 * counts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(starts[-1], "u1")
    bits = dense[of]
    at = starts[of[bits]] + (places[bits] >> 3)
    body += np.bincount(at, weights=(1 << (places[bits] & 7)), minlength=len(body)).astype("u1") if len(at) else np.uint8(0)
    rest = ~bits
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[of[rest]] + 2 * nth[rest]
    body[at], body[at + 1] = places[rest] & 255, places[rest] >> 8
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.astype("i4").tobytes()), pa.py_buffer(body.tobytes())])


def members(maps: pa.BinaryArray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all bits of compressed bitmaps; `width` of each row's block."""
    if not len(maps):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    ends = np.frombuffer(maps.buffers()[1], "i4")[maps.offset : maps.offset + len(maps) + 1].astype("i8")
    body = np.frombuffer(maps.buffers()[2] or b"", "u1")
    sizes, full = np.diff(ends), (width + 7) // 8
    dense = sizes == full
    rows, places = [], []
    few = np.flatnonzero(~dense)
    n = sizes[few] // 2
    of = np.repeat(few, n)
    at = np.repeat(ends[few], n) + 2 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    rows.append(of)
    places.append(body[at].astype("i8") | body[at + 1].astype("i8") << 8)
    many = np.flatnonzero(dense)
    m = sizes[many]
    of = np.repeat(many, m)
    nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    byte, bit = np.nonzero(np.unpackbits(body[np.repeat(ends[many], m) + nth][:, None], axis=1, bitorder="little"))
    rows.append(of[byte])
    places.append(8 * nth[byte] + bit)
    return np.concatenate(rows), np.concatenate(places)


class Block:
    """Documents gathered until a block is full. Runs of postings are merged as they come."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0

    def add_run(self, rows: list[tuple], doc: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        """Links of a run of documents, `doc` counted from its first."""
        keys = (pairs << 16) + (doc + len(self.rows))
        more = times > 1
        one, n = np.unique(keys[~more], return_counts=True)
        if more.any():
            one, n = np.concatenate([one, keys[more]]), np.concatenate([n, times[more]])
            order = np.argsort(one, kind="stable")
            one, n = one[order], n[order]
            first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            one, n = one[first], np.add.reduceat(n, first)
        self.keys.append(one)
        self.times.append(n)
        self.rows += rows
        self.links += len(one)

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each document, then a row for each pair."""
        keys, times = np.concatenate([*self.keys, np.zeros(0, "i8")]), np.concatenate([*self.times, np.zeros(0, "i8")])
        order = np.argsort(keys)
        keys, times, width = keys[order], times[order], len(self.rows)
        pair, doc = keys >> 16, keys & 0xFFFF
        fresh = np.append(True, pair[1:] != pair[:-1]) if len(pair) else np.zeros(0, bool)
        of, pairs = np.cumsum(fresh) - 1, pair[fresh]
        planes, places, rows = [], [], []  # plane by plane, then put in order of pairs
        for bit in range(int(times.max()).bit_length() if len(times) else 0):
            on = np.flatnonzero(times >> bit & 1)
            rows.append(of[on])
            places.append(doc[on])
            planes.append(np.full(len(on), bit))
        rows, places, planes = (np.concatenate([*x, np.zeros(0, "i8")]) for x in (rows, places, planes))
        deep = np.zeros(len(pairs), "i8")
        np.maximum.at(deep, rows, planes + 1)
        base = np.cumsum(deep) - deep
        slot = base[rows] + planes
        order = np.lexsort((places, slot))
        told = bitmaps(slot[order], places[order], int(deep.sum()), width)
        layers = pa.ListArray.from_arrays(pa.array(np.append(base, deep.sum()).astype("i4")), told)
        union = np.unique((rows << 16) + places)  # OR of a pair's planes
        bitmap = bitmaps(union >> 16, union & 0xFFFF, len(pairs), width)
        n, m = len(self.rows), len(pairs)
        columns = {k: list(c) for k, c in zip(OWN, zip(*self.rows))}
        types = {"block": pa.int64(), "width": pa.int32(), "nth": pa.int32()}
        made = []
        for f in schema:
            if f.name in types:
                top = {"block": np.full(n + m, number), "width": np.full(n + m, width), "nth": np.append(np.arange(n), np.full(m, -1))}[f.name]
                made.append(pa.array(top, f.type))
            elif f.name in columns:
                made.append(pa.concat_arrays([pa.array(columns[f.name], f.type), pa.nulls(m, f.type)]))
            else:
                own = {"pair": pa.array(pairs), "docs": pa.array(np.bincount(union >> 16, minlength=m).astype("i4")), "bitmap": bitmap, "planes": layers}[f.name]
                made.append(pa.concat_arrays([pa.nulls(n, f.type), own.cast(f.type)]))
        return pa.RecordBatch.from_arrays(made, schema=schema)


def run_of(v: Vocabularies, ids: list, texts: list) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of documents, and (document, pair, times) of their links."""
    if len(v.index) > v.most or v.used > 16 * v.most:
        v.clear()
    split: list[list[str]] = []
    whole: dict[int, tuple] = {}
    for k, t in enumerate(texts):
        if t and (not v.apart or DOUBT.search(t)):
            whole[k] = v.whole(t)
            split.append([])
        else:
            split.append(UNIT.findall(" " + t) if t else [])
    units = list(chain.from_iterable(split))
    new = list(dict.fromkeys(u for u in units if u not in v.index))
    if new:
        v.learn(new)
    at = np.fromiter(map(v.index.__getitem__, units), "i8", len(units))
    ends = np.cumsum([len(s) for s in split])
    rows, bad = [], set()
    facts = v.facts[at]
    sums = np.concatenate([np.zeros((1, 4), "i8"), np.cumsum(facts, axis=0, dtype="i8")])
    odd = np.searchsorted(ends, np.flatnonzero(facts[:, 2] < 0), "right")
    for k in set(odd.tolist()):  # a unit's bytes differ: the libraries decide on the whole text
        whole[k] = v.whole(texts[k])
        bad.add(k)
    get = v.texts.__getitem__
    place = at.tolist()
    for k, (doc, end) in enumerate(zip(ids, ends.tolist())):
        if k in whole:
            told = whole[k]
            rows.append((doc, *told[1], hashlib.sha256(told[0].encode()).hexdigest()) if told else (doc, 0, 0, 0, 0, ""))
            continue
        begin = end - len(split[k])
        n = (sums[end] - sums[begin]).tolist()
        rows.append((doc, *n, hashlib.sha256(";".join(map(get, place[begin:end])).encode()).hexdigest() if end > begin else ""))
    of = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
    if bad:
        good = ~np.isin(of, list(bad))
        of, at = of[good], at[good]
    n = v.counts[at]
    flat = np.repeat(v.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    doc, pairs, times = np.repeat(of, n), v.pairs[flat], v.times[flat].astype("i8")
    for k, told in whole.items():
        if told:
            doc = np.concatenate([doc, np.full(len(told[2]), k)])
            pairs = np.concatenate([pairs, np.fromiter(told[2], "i8", len(told[2]))])
            times = np.concatenate([times, np.fromiter(told[2].values(), "i8", len(told[2]))])
    return rows, doc, pairs, times


def postings(docs: DataFrame, path_a: str, path_b: str, most_docs: int, most_links: int) -> DataFrame:
    """Rows of documents and rows of pairs, by block."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ROWS.split(", ")])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block, number = vocabularies(path_a, path_b), Block(), 0
        for batch in batches:
            ids, texts, parts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and size < 1_000_000 and len(block.rows) + end - at < most_docs:
                    size += len(texts[end] or "")
                    end += 1
                block.add_run(*run_of(v, ids[at:end], texts[at:end]))
                if len(block.rows) >= most_docs or block.links >= most_links:
                    yield block.batch((parts[0] << 32) + number, schema)
                    block, number = Block(), number + 1
                at = end
        if block.rows:
            yield block.batch((parts[0] << 32) + number, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().cast("long")).mapInArrow(run, ROWS)


def scores_of_block(group: pa.Table) -> pa.Table:
    """Counts of the pairs back to the documents that hold them, along the planes."""
    own = group.filter(pc.greater_equal(group["nth"], 0))
    post = group.filter(pc.less(group["nth"], 0)).combine_chunks()
    n = own.num_rows
    best, total = np.zeros(n, "i8"), np.zeros(n, "i8")
    for part in post.to_batches(max_chunksize=20_000):
        planes = part.column("planes")
        ends = planes.offsets.to_numpy().astype("i8")
        of = np.repeat(np.arange(part.num_rows), np.diff(ends))
        digit = np.arange(ends[0], ends[-1]) - ends[of]
        flat = planes.values.slice(ends[0], ends[-1] - ends[0])
        row, place = members(flat, np.full(len(flat), n))
        pair, times = of[row], np.int64(1) << digit[row]
        count = part.column("count").to_numpy()[pair]
        top = part.column("top").to_numpy(zero_copy_only=False)[pair].astype(bool)
        np.add.at(total, place, times * count)
        np.add.at(best, place, np.where(top, times, 0))
    nth = own["nth"].to_numpy()
    columns = {c: own[c] for c in OWN} | {"n_best": pa.array(best[nth]), "count_sum": pa.array(total[nth])}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in RESULT.split(", ")})


def pair_counts(posted: DataFrame, wide: int) -> DataFrame:
    """(pair, count, links, top) of all blocks: documents, links, and whether no pair of the same id of A has more
    documents. Blocks hold different documents, so the bits of their bitmaps add up."""
    counts = posted.groupBy("pair").agg(F.sum("docs").cast("long").alias("count"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / F.lit(wide)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))


def align(docs: DataFrame, path_a: str, path_b: str, most_docs: int = 8192, most_links: int = 3_000_000) -> DataFrame:
    """One row per document: tokens of both vocabularies, groups, links, links whose pair no other pair of
    its id of A outnumbers, the sum of its links' document counts, and a digest of the groups.

    Null and empty texts, and texts whose tokens do not give back their bytes, have zeros and ''. Every row is a
    document, repeated ones too; null doc_ids stay; other columns are ignored; an empty table gives no rows. Long
    texts are encoded whole. A block ends at `most_docs` documents (under 65,536) or at `most_links` postings."""
    import sentencepiece

    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "align")
    wide = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = scratch.save(postings(docs, path_a, path_b, most_docs, most_links), "postings")
    posted = rows.where("nth < 0").select("block", "nth", "pair", "docs", "planes")
    scores = scratch.save(pair_counts(posted.select("pair", "docs"), wide), "counts")
    back = posted.join(scores, "pair").select("block", "nth", *(F.lit(None).cast(t).alias(c) for c, t in zip(OWN, ("long",) * 5 + ("string",))), "planes", "count", "top")
    own = rows.where("nth >= 0").select("block", "nth", *OWN, F.lit(None).cast("array<binary>").alias("planes"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("top"))
    return own.union(back).groupBy("block").applyInArrow(tidy(scores_of_block), RESULT)
