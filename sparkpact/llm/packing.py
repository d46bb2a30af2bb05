"""Best-fit packing of token sequences, planned over counts of lengths.

The plan never sees documents: at most `capacity` distinct lengths and their counts go to the
driver, which runs best-fit-decreasing on counts. Pieces then take planned slots by their rank
among the pieces of their length. Each plan row is a run of slots in a row of sequences, so the
plan has a few rows per length whatever the corpus holds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, small_table, split_count, tidy
from .tokens import END, blocks, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = ("length", "first", "count", "sequence", "each", "offset")


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: rows (length, first, count, sequence, each, offset).

    The pieces of `length` with ranks first .. first+count-1 go, `each` to a sequence, to the
    sequences from `sequence` on, from `offset` on. All sequences with the same room left are
    alike, so they are held as id ranges under their room. Lengths of 0 take no room."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        first, left = 0, counts[length]
        while left:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = capacity // length
                n = max(1, left // each)
                room.setdefault(capacity, []).append((opened, n))
                opened += n
                fits = capacity
            at, n = room[fits].pop()
            each = min(fits // length, left)
            used = min(n, left // each)
            if used < n:
                room[fits].append((at + used, n - used))
            if not room[fits]:
                del room[fits]
            rows.append((length, first, used * each, at, each, capacity - fits))
            if fits - each * length:
                room.setdefault(fits - each * length, []).append((at, used))
            first, left = first + used * each, left - used * each
    return rows


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids of whole texts; only longer documents are cut."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in blocks(texts):
                flat, counts = tokens.encode(run)
                flat, at, out = flat.astype("<u4"), 0, []
                for doc, n in zip(ids_of[first : first + len(run)], counts.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(END)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = ids[start : start + capacity]
                        out.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, piece_rows: int = 50_000) -> DataFrame:
    """One row per piece with sequence_id and offset.

    Null texts are empty and give one piece, the end id. Repeated rows are packed once each; null
    doc_ids are kept. Other columns are ignored. An empty table gives no rows. Ties among equal
    lengths go by doc_id and piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(cut_documents(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")  # parts rows that are alike
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = small_table(spark, plan_best_fit(counts, capacity), **dict.fromkeys(PLAN, pa.int64()))
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "row"], "rank", split_count(sum(counts.values()), piece_rows, 64))
    p = plan.select(F.col("length").alias("_length"), "first", "count", "sequence", "each", F.col("offset").alias("_offset"))
    # at most capacity^2 / 2 rows whatever the input holds, in practice a few thousand
    hit = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(p), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
