"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed to buckets with an embedding each (long
runs without white space are several words, see all_words);
a window of words is the mean of its words' vectors; a linear softmax tells the classes. Both
are learned together by AdaGrad. Only documents are labelled, so the first pass takes every window
of a toxic document as toxic and the second only those the first one believes (at least the most
suspect one). A document's score is its most suspect window, calibrated on labelled documents
kept out of the fit. As all is linear after the embeddings, a word's share of a logit is one number,
looked up per worker when whole texts are scored."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches, trim
from .tokens import blocks

MARKS = re.compile(r"[\W_]+")
LONG, SLICE, OVER = 64, 8, 5  # slices overlap so far that every n-gram of up to 6 characters lies in one


def all_words(text: str) -> list[str]:
    """All of the text in words: runs without white space, those of over LONG characters in pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [piece for w in words for piece in (pieces(w) if len(w) > LONG else (w,))]


def pieces(run: str) -> Iterator[str]:
    """A run cut at its marks; letters that stand alone between marks stay together. What is longer
    than LONG even so is sliced."""
    marks = {ord(c): " " for c in set(run) if not c.isalnum() and unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf")}
    for alone, group in groupby(run.translate(marks).split(), lambda p: len(p) == 1):
        for piece in ["".join(group)] if alone else group:
            if len(piece) <= LONG:
                yield piece
            else:
                bare = MARKS.sub("", piece.lower())
                yield from (bare[s : s + SLICE] for s in range(0, max(1, len(bare) - OVER), SLICE - OVER))


def bags(words: list[str], buckets: int, least: int = 3, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in a row, number for each word): a word's n-grams with its borders, and the whole
    word. Upper case and marks don't count; a word of marks only has none."""
    held = [f"<{c}>" if (c := MARKS.sub("", w.lower())) else "" for w in words]
    sizes = np.fromiter(map(len, held), "i8", len(held))
    chars = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    word = np.repeat(np.arange(len(held)), sizes)
    if not len(chars):
        return np.zeros(0, "i8"), np.zeros(len(held), "i8")
    starts = np.cumsum(sizes) - sizes
    powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, "u8"))
    full = sizes > 0
    hashes, owners = [np.add.reduceat(chars * powers[np.arange(len(chars)) - starts[word]], starts[full]) + np.uint64(1)], [np.flatnonzero(full)]
    grams = chars * powers[0]
    for n in range(2, most + 1):
        grams = grams[:-1] * powers[1] + chars[n - 1 :] * powers[0]
        if n >= least:
            within = word[: len(grams)] == word[n - 1 :]
            hashes.append(grams[within] + np.uint64(n))
            owners.append(word[: len(grams)][within])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return ((h >> np.uint64(24)) % np.uint64(buckets)).astype("i8")[order], np.bincount(owner, minlength=len(held))


@dataclass
class Model:
    weights: np.ndarray  # a bucket's share of the logit
    bias: float
    slope: float  # calibration of a document's largest logit
    shift: float
    window: int
    known: dict = field(default_factory=dict, repr=False)

    def shares(self, words: list[str]) -> np.ndarray:
        """Each word's mean weight; words seen before are looked up."""
        out = np.fromiter(map(self.known.get, words, repeat(np.nan)), "f8", len(words))
        if len(lost := np.flatnonzero(np.isnan(out))):
            new = list(dict.fromkeys(map(words.__getitem__, lost.tolist())))
            for s in range(0, len(new), 100_000):
                flat, n = bags(some := new[s : s + 100_000], len(self.weights))
                sums = np.append(0.0, np.cumsum(self.weights[flat]))
                ends = np.cumsum(n)
                self.known.update(zip(some, ((sums[ends] - sums[ends - n]) / np.maximum(n, 1)).tolist()))
            out[lost] = [self.known[words[i]] for i in lost.tolist()]
        return out

    def logits(self, texts: list[str], most: int = 150_000) -> np.ndarray:
        """The largest window logit of each whole text; the bias alone for a text without words."""
        out = np.full(len(texts), min(self.bias, 0.0))
        for first, run in blocks(texts):
            if len(self.known) > most:
                self.known.clear()
            split = [all_words(t) for t in run]
            words = [w for s in split for w in s]
            sizes = np.fromiter(map(len, split), "i8", len(split))
            again = np.append(False, np.fromiter(map(eq, words[1:], words), bool, max(0, len(words) - 1)))[: len(words)]
            again[(np.cumsum(sizes) - sizes)[sizes > 0]] = False  # a document's first word follows no other
            shares = self.shares(words)[~again]  # a word said again adds nothing and counts for nothing, as in the fit
            ends = np.cumsum(sizes) - np.append(0, np.cumsum(again))[np.cumsum(sizes)]
            for k, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist()), first):
                if b > a:
                    out[k] = windows_mean(shares[a:b], self.window).max() + self.bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def windows_mean(shares: np.ndarray, window: int) -> np.ndarray:
    """Means over windows of `window` words, half overlapping; the last reaches to the end."""
    n, step = len(shares), max(1, window // 2)
    starts = np.arange(0, max(1, n - window + step), step)
    sums = np.append(0.0, np.cumsum(shares))
    ends = np.minimum(starts + window, n)
    starts = np.maximum(0, ends - window)
    return (sums[ends] - sums[starts]) / (ends - starts)


def fit(texts: list[str], labels: list[int], window: int = 8, buckets: int = 1 << 17, size: int = 8, epochs: tuple[int, int] = (2, 3), steps: tuple[int, int] = (300, 800), rate: float = 0.3, seed: int = 7) -> Model:
    """Trains embeddings and softmax together, for `epochs` rounds in either pass or as many as take `steps`
    steps; every fourth document is kept for calibration."""
    y = np.asarray(labels, "i8")
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), -4.0, 1.0, 0.0, window)
    number: dict[str, int] = {}
    said: list[tuple[int, np.ndarray]] = []
    for k, text in enumerate(texts):
        if k % 4 != 3:
            words = all_words(text)
            said.append((k, np.array([number.setdefault(w, len(number)) for w, last in zip(words, [None, *words]) if w != last], "i4")))
    flat, bag_n = bags(list(number), buckets)
    number.clear()
    windows: list[np.ndarray] = []
    owner: list[int] = []
    for k, ids in said:
        ids = ids[bag_n[ids] > 0]
        for s in range(0, len(ids), window):
            windows.append(ids[s : s + window])
            owner.append(k)
    if not windows:
        return Model(np.zeros(buckets), -4.0, 1.0, 0.0, window)
    bag_at = np.cumsum(bag_n) - bag_n
    win_n = np.array([len(w) for w in windows])
    doc = np.array(owner)
    rng = np.random.default_rng(seed)
    target = y[doc].astype("f8")

    def words_of(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = bag_n[u]
        return flat[np.repeat(bag_at[u] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def mean_rows(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.cumsum(n) - n, axis=0) / n[:, None]

    def forward(batch: np.ndarray):
        ids = np.concatenate([windows[i] for i in batch])
        u, inverse = np.unique(ids, return_inverse=True)
        g, n = words_of(u)
        return inverse, g, n, mean_rows(mean_rows(E[g], n)[inverse], win_n[batch])

    for stage, rounds in enumerate(epochs):
        if stage:  # which windows of the toxic documents are believed
            logit = np.concatenate([(h := forward(b)[3]) @ (V[:, 1] - V[:, 0]) + c[1] - c[0] for b in np.array_split(np.arange(len(windows)), max(1, len(windows) // 2048))])
            clean = np.quantile(logit[y[doc] == 0], 0.995)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, doc, logit)
            target = ((y[doc] == 1) & ((logit > clean) | (logit >= best[doc]))).astype("f8")
        E = rng.normal(0, 0.1, (buckets, size))
        V, c = rng.normal(0, 1.0, (size, 2)), np.zeros(2)
        GE, GV, Gc = np.full(buckets, 1e-6), np.full(V.shape, 1e-6), np.full(2, 1e-6)
        weight = np.where(target == 1, min(20.0, (target == 0).sum() / max(1.0, target.sum())), 1.0)
        for _ in range(max(rounds, -(-steps[stage] * 256 // len(windows)))):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), 256):
                b = order[s : s + 256]
                inverse, g, n, h = forward(b)
                z = h @ V + c
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = p.copy()
                d[np.arange(len(b)), target[b].astype("i8")] -= 1
                d *= weight[b][:, None] / weight[b].sum()
                dh, dV, dc = d @ V.T, h.T @ d, d.sum(0)
                dw = np.stack([np.bincount(inverse, x, len(n)) for x in np.repeat(dh / win_n[b][:, None], win_n[b], axis=0).T], 1) / n[:, None]
                ug, back = np.unique(g, return_inverse=True)
                rows = np.repeat(dw, n, axis=0)
                dE = np.stack([np.bincount(back, x, len(ug)) for x in rows.T], 1)
                GE[ug] += (dE**2).mean(1)
                E[ug] -= rate * dE / np.sqrt(GE[ug])[:, None]
                GV += dV**2
                V -= rate * dV / np.sqrt(GV)
                Gc += dc**2
                c -= rate * dc / np.sqrt(Gc)
    model = Model(E @ (V[:, 1] - V[:, 0]), float(c[1] - c[0]), 1.0, 0.0, window)
    kept = range(3, len(texts), 4)
    model.slope, model.shift = platt(model.logits([texts[k] for k in kept]), y[list(kept)])
    model.known = {}
    return model


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve by Newton steps with a small ridge."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    x = np.stack([logits, np.ones(len(y))], 1)
    scale = max(1e-9, np.abs(logits).mean())
    x[:, 0] /= scale
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -2, 2)
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `per_class` labelled rows of either class, the ones with the
    smallest hash of their id; rows with remainder 1 never take part."""
    of = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    chosen = of.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(of.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    got = sorted(rows.collect(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))  # at most 2 x per_class rows
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1200, threshold: float = 0.7) -> DataFrame:
    """`docs` with held_out, score and predicted.

    Null and empty texts score as texts without any suspect word; very long ones are scored whole, by
    their most suspect window (ties make no difference). Rows are scored one by one, so
    repeated rows get the same score; null doc_ids are kept. Without labels of both classes every
    score is low. An empty table gives no rows. Clashing columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, per_class)))  # one float per bucket
    trim()

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        own.known = held(("toxicity", own.bias, zlib.crc32(own.weights.tobytes())), dict)
        for texts in batches:
            yield pa.array(own.scores([t or "" for t in texts.to_pylist()]), pa.float64())
        trim()

    scored = F.arrow_udf(score, "double")(F.col("text").cast("string"))
    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": scored}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
