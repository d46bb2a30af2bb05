"""Token ids as compact binary shards: Re-Pair grammar compression with random access.

A shard covers a run of documents in ascending doc_id order, of `shard_tokens` ids or a block of texts more.
Frequent id pairs are replaced by nonterminals, over and over, until no pair is left that occurs `least` times or
the 16-bit ids have run out; a round replaces all pairs nearly as frequent as the most frequent one. The shard stores the
rules, the expansion length of every rule, the compressed ids and, for each document, where it
begins. Any document is decoded from its own stretch alone.

Shard layout, little endian: magic "RPID", version u2, base u4 (first nonterminal), rules u4,
symbols u8, documents u4; then rules (left u2, right u2 each), expansion lengths (u4 each),
per document first symbol u4 and n_tokens u4, symbols (u2 each). Nonterminals fill the 16-bit
ids above the vocabulary. Documents end at symbol borders, as no rule reaches over a document's end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, split_count, tidy
from .tokens import blocks, encoder

HEAD = struct.Struct("<4sHIIQI")
SHARDS = "part int, shard int, n_docs long, n_tokens long, doc_ids array<long>, blob binary"


APART = np.uint32(0xFFFFFFFF)  # stands between documents; 65535 is given out last, and no pair is counted after that


def neighbours(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pairs i, i+1 as left << 16 | right, `APART` where a document ends at i."""
    pairs = ids[:-1].astype("u4")
    pairs <<= np.uint32(16)
    pairs |= ids[1:]
    pairs[ends[:-1]] = APART
    return pairs


def frequent_pairs(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of those that occur at least `least` times, rising."""
    pairs = np.sort(pairs)
    pairs = pairs[: np.searchsorted(pairs, APART)]
    begins = np.flatnonzero(pairs[least - 1 :] == pairs[: max(0, len(pairs) - least + 1)])  # `least` alike from here
    often = pairs[begins]
    at = np.flatnonzero(np.append(True, often[1:] != often[:-1])) if len(often) else begins
    return often[at], np.diff(np.append(at, len(often))) + least - 1


def hashed(pairs: np.ndarray) -> np.ndarray:
    return pairs * np.uint32(2654435761) >> np.uint32(16)


def compress(ids: np.ndarray, counts: np.ndarray, base: int, least: int = 16, near: float = 0.1):
    """(rules (n, 2), symbols, first symbol of each document) for documents of `counts` ids each.

    A round takes the pairs that occur at least `near` times as often as the most frequent one, and at least
    `least` times; pairs that overlap are replaced from the left. It goes on until no such pair is left or
    there are no more ids (the most frequent pairs then get the last ones)."""
    ids = ids.astype("u2")
    ends = np.cumsum(counts)[counts > 0] - 1  # last symbol of each document that has any
    rules: list[np.ndarray] = []
    free = (1 << 16) - base
    while len(ids) > 1 and free > 0:
        keys = neighbours(ids, ends)
        pairs, n = frequent_pairs(keys, least)
        if not len(n):
            break
        best = np.flatnonzero(n >= near * n.max())
        best = best[np.argsort(-n[best], kind="stable")[:free]]
        slot = hashed(pairs[best])
        # of pairs with the same hash the most frequent is taken, the others wait for a later round
        table = np.full(1 << 16, -1, "i4")
        table[slot[::-1]] = np.arange(len(best))[::-1]
        chosen = pairs[best[np.sort(table[np.unique(slot)])]]
        table[hashed(chosen)] = np.arange(len(chosen))
        number = np.arange(len(chosen), dtype="u4") + (base + sum(map(len, rules)))
        found = table.take(hashed(keys))
        maybe = np.flatnonzero(found >= 0)
        found = found[maybe]
        hit = chosen[found] == keys[maybe]
        at, symbol = maybe[hit], number[found[hit]]
        run = np.append(True, np.diff(at) != 1)
        if not run.all():
            begins = np.flatnonzero(run)
            nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            at, symbol = at[nth % 2 == 0], symbol[nth % 2 == 0]
        ids[at] = symbol
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        ends -= np.searchsorted(at, ends)  # symbols gone up to here: those behind a smaller place
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1))
        free -= len(chosen)
    starts = np.append(0, ends + 1)[: len(ends)]
    first = np.full(len(counts), len(ids), "i8")
    first[counts > 0] = starts
    first = np.minimum.accumulate(first[::-1])[::-1] if len(first) else first
    return (np.concatenate(rules) if rules else np.zeros((0, 2))).astype("u2"), ids, first


def stretches(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """(first, end) of rules in a row that refer to nothing from the first of them on, so they can be laid out at once."""
    reach = np.maximum.accumulate(rules.max(1)).astype("i8") if len(rules) else np.zeros(0, "i8")
    first = 0
    while first < len(rules):
        end = int(np.searchsorted(reach, base + first))
        if end <= first:
            raise ValueError("a rule refers to itself or to a later one")
        yield first, end
        first = end


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule refers to earlier rules only."""
    lengths = np.ones(base + len(rules), "i8")
    for first, end in stretches(rules, base):
        lengths[base + first : base + end] = lengths[rules[first:end]].sum(1)
    return lengths[base:]


def write_shard(ids: np.ndarray, counts: np.ndarray, base: int, **options) -> bytes:
    counts = np.asarray(counts, "i8")
    rules, symbols, first = compress(ids, counts, base, **options)
    head = HEAD.pack(b"RPID", 1, base, len(rules), len(symbols), len(counts))
    spans = np.stack([first, counts], 1).astype("<u4") if len(counts) else np.zeros((0, 2), "<u4")
    return b"".join([head, rules.astype("<u2").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), spans.tobytes(), symbols.astype("<u2").tobytes()])


class Shard:
    """A shard's bytes, opened for random access."""

    def __init__(self, blob: bytes):
        magic, version, self.base, n_rules, n_symbols, n_docs = HEAD.unpack_from(blob)
        if magic != b"RPID" or version != 1:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.rules = np.frombuffer(blob, "<u2", 2 * n_rules, at).reshape(-1, 2)
        at += 4 * n_rules
        self.lengths = np.frombuffer(blob, "<u4", n_rules, at)
        at += 4 * n_rules
        self.spans = np.frombuffer(blob, "<u4", 2 * n_docs, at).reshape(-1, 2)
        at += 8 * n_docs
        self.symbols = np.frombuffer(blob, "<u2", n_symbols, at)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols: every rule's expansion is laid out once, then gathered."""
        if not hasattr(self, "flat"):
            self.size = np.concatenate([np.ones(self.base, "i8"), self.lengths.astype("i8")])
            self.begin = np.cumsum(self.size) - self.size
            self.flat = np.empty(self.size.sum(), "u2")
            self.flat[: self.base] = np.arange(self.base)
            for first, end in stretches(self.rules, self.base):
                made = self._gather(self.rules[first:end].ravel())
                at = self.begin[self.base + first]
                self.flat[at : at + len(made)] = made
        return self._gather(symbols)

    def _gather(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        ends = np.cumsum(n)
        if not len(ends):
            return np.zeros(0, "u2")
        return self.flat[np.repeat(self.begin[symbols] - ends + n, n) + np.arange(ends[-1])]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each document ends."""
        return self.expand(self.symbols), np.cumsum(self.spans[:, 1].astype("i8"))

    def document(self, k: int) -> np.ndarray:
        first = int(self.spans[k, 0])
        last = int(self.spans[k + 1, 0]) if k + 1 < len(self.spans) else len(self.symbols)
        return self.expand(self.symbols[first:last])


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int, base: int = 49_408, shard_tokens: int = 1_000_000, part_rows: int = 8_000) -> None:
    """Encodes every whole text and writes shards to `path`, ranges of doc_id by ascending part."""

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        counts: list[int] = []

        def flush():
            nonlocal shard
            blob = write_shard(np.concatenate(held), np.array(counts), base)
            row = [[part], [shard], [len(doc_ids)], [sum(counts)], [list(doc_ids)], [blob]]
            shard += 1
            doc_ids.clear(), held.clear(), counts.clear()
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["part", "shard", "n_docs", "n_tokens", "doc_ids", "blob"])

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in blocks(texts, 2_500_000):
                flat, n = tokens.encode(run)
                at = np.cumsum(n)
                held.append(np.insert(flat, at, np.uint16(end)))
                counts += (n + 1).tolist()
                doc_ids += ids_of[first : first + len(run)]
                if sum(map(len, held)) >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = split_count(docs.count(), part_rows, 12)
    dealt = wanted.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    dealt.select("doc_id", "text").mapInArrow(encode, SHARDS).write.mode("overwrite").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document of the shards at `path`: doc_id, start, n_tokens, ids_crc32.

    `start` adds what lies before in the document's own shard to the totals of the shards
    before, of which there is one row each."""
    shards = spark.read.schema(SHARDS).parquet(path)
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.select("part", "shard", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("n_tokens")

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, doc_ids, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                flat, ends = Shard(blob).documents()
                flat, at, out = flat.astype("<u4"), 0, []
                for doc, end in zip(doc_ids, ends.tolist()):
                    out.append((part, number, doc, at, end - at, zlib.crc32(flat[at:end])))
                    at = end
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "doc_ids", "blob").mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(totals, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Writes the shards to the shared folder and reads every document back from them.

    Null texts are empty: one id, the end. Null doc_ids come first. Repeated doc_ids are ordered by
    a hash of their text. An empty table writes no shard and gives no rows."""
    scratch = Scratch(docs.sparkSession, "token-files")
    write_ids(docs, scratch.path("shards"), vocabulary, end)
    return read_ids(docs.sparkSession, scratch.path("shards"))
