"""Mixture-controlled packing: deficit round-robin over source queues, into sequences without padding.

Every source is a queue of its documents' ids. In each round a queue gets its quantum, its share of a
window; what it may not send yet stays as its deficit for the rounds behind. Queues send in packets of
`grain` ids, in their order; what they send, one after the other, is cut every `capacity` ids. So each
sequence holds every source near its share of all ids, to a few packets.

A queue's deficit is what its quanta add up to less what it has sent. Quanta are whole numbers of 1/2^17 of
an id, so the state of all queues behind any round follows exactly from its number: a task begins
at any document with the deficits carried from all windows and partitions before, and none waits for another."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, tidy
from .tokens import blocks, encoder

END = 1
FRACTION = 17  # bits of a quantum behind the point
IDS = "doc_id long, source string, part int, nth long, before long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Queues:
    """The round-robin over queues of `sizes` ids, none of which is empty."""

    def __init__(self, sizes: list[int], capacity: int, grain: int):
        self.sizes, self.capacity, self.grain = np.array(sizes, "i8"), capacity, grain
        total = max(1, sum(sizes))
        self.total = sum(sizes)
        self.quanta = np.array([-(-capacity * n * (1 << FRACTION) // total) for n in sizes], "i8")

    def sent(self, rounds: np.ndarray, queue: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Ids that queues have sent when `rounds` are over: whole packets, and the rest once all may go."""
        may = (rounds * self.quanta[queue]) >> FRACTION
        return np.where(may >= self.sizes[queue], self.sizes[queue], may - may % self.grain)

    def round_of(self, queue: np.ndarray, packet: np.ndarray) -> np.ndarray:
        """The round, from 1, in which a packet goes: the first in which the queue's quanta cover it."""
        end = np.minimum((packet + 1) * self.grain, self.sizes[queue])
        return -((-end << FRACTION) // self.quanta[queue])

    def place(self, queue: np.ndarray, packet: np.ndarray, room: int = 1 << 20) -> np.ndarray:
        """Where packets begin in all that is sent: behind the rounds before, and behind what the queues
        before send in the same round."""
        round_ = self.round_of(queue, packet)
        rounds, at = np.unique(round_, return_inverse=True)
        place = packet * self.grain - self.sent(round_ - 1, queue)
        step = max(1, room // len(self.sizes))
        for k in range(0, len(rounds), step):
            here = rounds[k : k + step, None]
            before, after = self.sent(here - 1), self.sent(here)
            own = np.cumsum(after - before, axis=1)
            base = before.sum(axis=1)[:, None] + own - (after - before)  # of each round and queue
            mine = np.flatnonzero((at >= k) & (at < k + step))
            place[mine] += base[at[mine] - k, queue[mine]]
        return place

    def edges(self) -> np.ndarray:
        """Lengths of the sequences behind the last full one: powers of two, the largest first."""
        rest = self.total % self.capacity
        return np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], "i8")

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, its first place, its last place + 1) of places in all that is sent."""
        full = self.total // self.capacity
        number = at // self.capacity
        first, end = number * self.capacity, (number + 1) * self.capacity
        edges = np.concatenate([[0], np.cumsum(self.edges())]) + full * self.capacity
        late = np.flatnonzero(number >= full)
        k = np.searchsorted(edges, at[late], "right") - 1
        number[late], first[late], end[late] = full + k, edges[k], edges[np.minimum(k + 1, len(edges) - 1)]
        return number, first, end

    def pieces(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        """How documents at `begin` in their queues are cut: document, start, length, sequence and offset of
        each piece, in order. Packets that come to lie behind one another are one piece."""
        first, last = begin // self.grain, (begin + length - 1) // self.grain
        n = last - first + 1
        doc = np.repeat(np.arange(len(begin)), n)
        packet = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        start = np.maximum(packet * self.grain, begin[doc])
        end = np.minimum((packet + 1) * self.grain, (begin + length)[doc])
        at = self.place(queue[doc], packet) + start - packet * self.grain
        # a packet may lie over the end of a sequence, and of several short ones at the very end
        made = [np.zeros((4, 0), "i8")]
        todo = np.stack([doc, start, end, at])
        while todo.shape[1]:
            doc, start, end, at = todo
            _, _, edge = self.sequence(at)
            cut = np.minimum(end, start + edge - at)
            made.append(np.stack([doc, start, cut, at]))
            more = cut < end
            todo = np.stack([doc[more], cut[more], end[more], at[more] + cut[more] - start[more]])
        doc, start, end, at = np.concatenate(made, axis=1)
        order = np.lexsort((start, doc))
        doc, start, end, at = doc[order], start[order], end[order], at[order]
        number, edge, _ = self.sequence(at)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (at[1:] != at[:-1] + end[:-1] - start[:-1])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(doc)) - 1 if len(doc) else head
        return {"doc": doc[head], "start": start[head] - begin[doc[head]], "length": end[tail] - start[head], "sequence": number[head], "offset": (at - edge)[head]}


def queued(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of whole texts (16 bits each) with the ids of the same source before them in their task."""
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.spark_partition_id()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, before, nth = encoder(vocabulary), {}, 0
        for batch in batches:
            docs, texts, sources, parts = (c.to_pylist() for c in batch.columns)
            for first, texts_ in blocks(texts):
                flat, counts = tokens.encode(texts_)
                at, rows = 0, []
                for k, n in enumerate(counts.tolist(), first):
                    ids = flat[at : at + n].astype("<u2").tobytes() + END.to_bytes(2, "little")
                    at += n
                    rows.append((docs[k], sources[k], parts[k], nth, before.get(sources[k], 0), n + 1, ids))
                    before[sources[k]] = before.get(sources[k], 0) + n + 1
                    nth += 1
                types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in IDS.split(", ")])

    return docs.select(*columns).mapInArrow(run, IDS)


def pack_mixed(docs: DataFrame, vocabulary: str, capacity: int = 2048, grain: int = 32, queues: int = 512) -> DataFrame:
    """One row per piece with sequence_id and offset: all ids of all documents, each once, in sequences of
    `capacity`; what the last one lacks is told in powers of two, so nothing is padded. `capacity` is a power of two.

    Null texts are empty and give their end id alone. Null is a source. Repeated rows are packed each. Other
    columns are ignored. An empty table gives no rows. The `queues` - 1 largest sources (ties by name, null last)
    have a queue each; what others there are share one, which gets their joint share: a window has no room for
    more. Documents go in the order in which they are read, long ones over many windows."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "pack-mixed")
    told = scratch.save(queued(docs, vocabulary), "ids")
    each = scratch.save(told.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "sizes")  # a row per task and source
    totals = each.groupBy("source").agg(F.sum("n").alias("n"))
    largest = totals.orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(queues - 1).collect()  # at most `queues` - 1 rows
    rest = (totals.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in largest)
    names = sorted((r["source"] for r in largest), key=lambda s: (s is None, s))
    sizes = {r["source"]: r["n"] for r in largest}
    plan = Queues([sizes[s] for s in names] + ([rest] if rest else []), capacity, grain)
    if not plan.total:
        return spark.createDataFrame([], PIECES)

    number = F.lit(len(names))
    for k, name in enumerate(names):
        number = F.when(F.col("source").eqNullSafe(F.lit(name)), k).otherwise(number) if len(names) <= 64 else number
    if len(names) > 64:
        known = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "known string, queue int")  # at most `queues` - 1 rows
        each = each.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("known")), "left").withColumn("queue", F.coalesce("queue", number)).drop("known")
    else:
        each = each.withColumn("queue", number)
    so_far = Window.partitionBy("queue").orderBy("part", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    begins = each.select("part", F.col("source").alias("own"), "queue", F.coalesce(F.sum("n").over(so_far), F.lit(0)).cast("long").alias("base"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, source, ids = batch.column(0), batch.column(1), batch.column(4)
            begin, n, queue = (batch.column(k).to_numpy().astype("i8") for k in (2, 3, 5))
            p = plan.pieces(queue, begin, n)
            crcs, last, wide = np.zeros(len(p["doc"]), "i8"), -1, b""
            for k, (d, s, m) in enumerate(zip(p["doc"].tolist(), p["start"].tolist(), p["length"].tolist())):
                if d != last:
                    last, wide = d, memoryview(np.frombuffer(ids[d].as_buffer(), "<u2").astype("<u4").tobytes())
                crcs[k] = zlib.crc32(wide[4 * s : 4 * (s + m)])
            of = pa.array(p["doc"])
            made = [doc_id.take(of), p["start"], p["length"], crcs, n[p["doc"]], p["sequence"], p["offset"], source.take(of)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in made], names=[c.split()[0] for c in PIECES.split(", ")])

    placed = told.join(begins, (told["part"] == begins["part"]) & told["source"].eqNullSafe(begins["own"]))
    return placed.select("doc_id", "source", (F.col("before") + F.col("base")).alias("begin"), "doc_tokens", "ids", "queue").mapInArrow(cut, PIECES)
