"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt into blocks, and each block has a list for every term that a query uses: its
documents by falling impact. A query reads its lists side by side. A document that is met is looked up in all
other lists directly, which gives its whole score and its places there; so in each list the places seen
without a gap reach further down than was read. No document not met yet can score more than the impacts at
these best positions together, and reading ends when that is strictly below the k-th score found.

Statistics of the whole corpus (documents, words, documents of a term) come from the blocks before any list is
ranked. Every task hands on the k best of each query over all its blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, tidy

#: Bytes of terms stay (A-Z in lower case), all others part them. Bytes from 128 on belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCK = "docs binary, lengths binary, with_terms long, terms long, held binary, starts binary, places binary, counts binary"
FOUND = "query int, doc_id long, score long"
WIDTH = 1 << 16  # a block has fewer documents


def words(text: str | None, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Terms of a whole text, in lists; long texts come in parts, so that no list is long."""
    data = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = len(data) if at + size >= len(data) else data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Block:
    """Documents gathered until a block is full: how often each holds the terms asked for."""

    def __init__(self, terms: dict[bytes, int], most_docs: int, most_words: int):
        self.get, self.most_docs, self.most_words = terms.get, min(most_docs, WIDTH - 1), most_words
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        n, at = 0, len(self.ids)
        for part in words(text):
            n += len(part)
            found = np.fromiter(map(self.get, part, repeat(-1)), "i8", len(part))
            found = found[found >= 0]
            self.keys.append(found * WIDTH + at)
            self.held += len(found)
        self.ids.append(doc_id)
        self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.held >= self.most_words

    def row(self) -> dict:
        """Lists by term and document. Terms that no document has are left out."""
        keys, counts = np.unique(np.concatenate([*self.keys, np.zeros(0, "i8")]), return_counts=True)
        terms, places = keys // WIDTH, keys % WIDTH
        held, starts = np.unique(terms, return_index=True)
        ids = pa.array(self.ids, pa.int64())
        present = np.array([x is not None for x in self.ids], "u1")
        docs = present.tobytes() + ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        lengths = np.array(self.lengths, "<i8")
        made = {"docs": docs, "lengths": lengths.tobytes(), "with_terms": int((lengths > 0).sum()), "terms": int(lengths.sum())}
        return made | {"held": held.astype("<i4").tobytes(), "starts": starts.astype("<i4").tobytes(), "places": places.astype("<u2").tobytes(), "counts": counts.astype("<u4").tobytes()}


def indexed(docs: DataFrame, terms: dict[bytes, int], most_docs: int, most_words: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(terms, most_docs, most_words)
        schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in BLOCK.split(", "))])
        for batch in batches:
            for k in range(batch.num_rows):
                block.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                if block.full():
                    yield pa.RecordBatch.from_pylist([block.row()], schema)
                    block.clear()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row()], schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


class Ranked:
    """The impact lists of a block."""

    def __init__(self, row: dict, weights: np.ndarray, documents: int, total: int):
        n = len(row["lengths"]) // 8
        self.present = np.frombuffer(row["docs"], "u1", n).astype(bool)
        self.docs = np.frombuffer(row["docs"], "<i8", n, n)
        held, starts = np.frombuffer(row["held"], "<i4"), np.frombuffer(row["starts"], "<i4").astype("i8")
        places, tf = np.frombuffer(row["places"], "<u2").astype("i8"), np.frombuffer(row["counts"], "<u4").astype("i8")
        self.start, self.size = np.zeros(len(weights), "i8"), np.zeros(len(weights), "i8")
        self.start[held], self.size[held] = starts, np.diff(np.append(starts, len(places)))
        of = np.repeat(held.astype("i8"), self.size[held])
        norm = 100 - 75 + (75 * np.frombuffer(row["lengths"], "<i8") * documents) // max(1, total)
        self.impact = weights[of] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[places]))
        self.keys = of * WIDTH + places  # rising: direct access is a search in them
        self.order = np.lexsort((places, -self.impact, of))  # of the postings as they are ranked
        self.rank = np.empty(len(of), "i8")
        self.rank[self.order] = np.arange(len(of))
        self.places = places

    def best(self, terms: np.ndarray, times: np.ndarray, best: list[tuple], k: int, step: int = 8) -> list[tuple]:
        """`best`, (score, no id, doc_id) of the documents before, with the best of this block."""
        here = self.size[terms] > 0
        terms, times = terms[here], times[here]
        first, size = self.start[terms], self.size[terms]
        met, seen = np.zeros(len(self.docs), bool), np.zeros(len(self.order), bool)
        depth, position = 0, np.zeros(len(terms), "i8")  # read so far; seen without a gap
        while len(terms):
            ends = np.minimum(depth + step, size)
            read = np.concatenate([np.arange(f + depth, f + e) for f, e in zip(first.tolist(), ends.tolist()) if e > depth] or [np.zeros(0, "i8")])
            depth, step = depth + step, min(2 * step, 512)
            new = np.unique(self.places[self.order[read]])
            new = new[~met[new]]
            met[new] = True
            if len(new):
                wanted = terms[:, None] * WIDTH + new
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[at] == wanted
                scores = (np.where(hit, self.impact[at], 0) * times[:, None]).sum(axis=0)
                seen[self.rank[at[hit]]] = True
                least = best[k - 1][0] if len(best) >= k else 1
                good = np.flatnonzero(scores >= max(least, 1))
                more = [(s, not p, d) for s, p, d in zip(scores[good].tolist(), self.present[new[good]].tolist(), self.docs[new[good]].tolist())]
                best = sorted([*best, *more], key=lambda x: (-x[0], x[1], x[2]))[:k]
            bound = 0
            for t in range(len(terms)):
                ahead = seen[first[t] + position[t] : first[t] + size[t]]
                position[t] += len(ahead) if ahead.all() else int(ahead.argmin())
                if position[t] < size[t]:  # of a list seen whole, no other document is in it
                    bound += int(times[t]) * int(self.impact[self.order[first[t] + max(position[t] - 1, 0)]])
            if bound == 0 or len(best) >= k and bound < best[k - 1][0]:
                break
        return best


def weights_of(held_by: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held_by.tolist()], "i8")


def _search(docs: DataFrame, items: list, scratch: Scratch, name: str, k: int, most_docs: int, most_words: int) -> DataFrame:
    """The k best of each task for items (item_id, text), whose numbers are `query`."""
    terms: dict[bytes, int] = {}
    asked = []
    for item in items:
        own: dict[int, int] = {}
        for part in words(item["text"]):
            for w in part:
                t = terms.setdefault(w, len(terms))
                own[t] = own.get(t, 0) + 1
        asked.append((np.array(list(own), "i8"), np.array(list(own.values()), "i8")))
    blocks = scratch.save(indexed(docs, terms, most_docs, most_words), name)
    documents, total = (x or 0 for x in blocks.agg(F.sum("with_terms"), F.sum("terms")).first())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), "i8")
        for batch in batches:
            for held, starts, places in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(places) // 2
                sums[np.frombuffer(held, "<i4")] += np.diff(np.append(np.frombuffer(starts, "<i4"), n))
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["term", "n"])

    held_by = np.zeros(len(terms), "i8")
    for r in blocks.select("held", "starts", "places").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most as many rows as terms asked for
        held_by[r["term"]] = r["n"]
    weights = weights_of(held_by, documents)

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                ranked = Ranked({n: batch.column(n)[row].as_py() for n in ("docs", "lengths", "held", "starts", "places", "counts")}, weights, documents, total)
                for q, (own, times) in enumerate(asked):
                    best[q] = ranked.best(own, times, best[q], k)
        rows = [(q, None if none else d, s) for q, found in enumerate(best) for s, none, d in found]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return blocks.select("docs", "lengths", "held", "starts", "places", "counts").mapInArrow(search, FOUND)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, most_docs: int = 8192, most_words: int = 6_000_000, item_bytes: int = 4_000_000) -> DataFrame:
    """The k documents of the highest scores above 0 for each item: item_id, rank from 1, doc_id, score.

    Equal scores go by doc_id, null last. Documents and items without terms (null, empty, marks only) match
    nothing; items that find fewer documents give fewer rows, an empty table none. Each row of `docs` is a
    document of its own, repeated ones too; rows of `items` with equal item_id and text are one item, equal ids with
    different texts are several. Other columns are ignored. Items are taken in blocks of about
    `item_bytes` of text, each of which is searched in all documents."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lexical")
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // item_bytes + 1
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about `item_bytes`
        hits = _search(docs, own, scratch, f"blocks-{part}", k, most_docs, most_words)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(names, "query").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.union(best)
    return found


SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact FROM t JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
