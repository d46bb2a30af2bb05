"""Token ids by a public vocabulary, for whole texts.

The vocabulary's normaliser and splitter never join what white space parts, so a text's ids are
its words' ids in a row: every distinct word goes through the library once per worker and is
then looked up. Arrow splits a block of texts and numbers its words, so Python looks at each of them once
a block. Texts where that might not hold (special tokens' strings, the four separators that only Python
counts as white space) go through the library whole."""

from __future__ import annotations

import gc
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
END = 0
#: The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes
#: for the characters from 256 on.
ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
MARKS = "".join(c for c in map(chr, range(33, 256)) if not c.isalnum() and not c.isspace())
BYTES = {b: 256 + k for k, b in enumerate(ODD)}


class Encoder:
    """Ids of texts as one flat array; keeps at most `most` words."""

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, "u2")  # a vocabulary of at most 65,536
        self.starts = np.zeros(1 << 14, "i4")
        self.counts = np.zeros(1 << 14, "i4")
        self.uses = np.zeros(1 << 14, "u4")
        self.used = 0

    def _forget(self) -> None:
        """Keeps the words used most since the last time, at most half of the room: most words of a
        corpus are met once."""
        n = len(self.index)
        uses = self.uses[:n]
        order = np.argsort(-uses.astype("i8"), kind="stable")[: self.most // 2]
        order = order[uses[order] > 1]
        words = list(self.index)
        kept = [words[i] for i in order.tolist()]
        counts = self.counts[order].astype("i8")
        ends = np.cumsum(counts)
        flat = self.flat[np.repeat(self.starts[order] - ends + counts, counts) + np.arange(counts.sum())]
        self.clear()
        first = self._place(kept, counts)
        self.flat[first : first + len(flat)] = flat

    def _room(self, name: str, n: int) -> None:
        have = getattr(self, name)
        if n > len(have):
            grown = np.zeros(max(n, 2 * len(have)), have.dtype)
            grown[: len(have)] = have
            setattr(self, name, grown)

    def _learn(self, words: list[str]) -> None:
        """Adds words. Marks behind letters are a piece of their own, so such a word is the word
        without them and the marks, unless its lower case has more than letters (a dot above the i of İ joins the marks)."""
        stems = [w.rstrip(MARKS) for w in words]
        marked = [(w, s, w[len(s) :]) for w, s in zip(words, stems) if len(s) < len(w) and s.isalpha() and (s.isascii() or s.lower().isalpha())]
        if marked:
            whole, left, right = zip(*marked)
            odd = set(whole)
            parts = dict.fromkeys(chain((w for w in words if w not in odd), left, right))
            self._add([w for w in parts if w not in self.index])
            left, right = (np.fromiter(map(self.index.__getitem__, x), "i8", len(x)) for x in (left, right))
            n = self.counts[left].astype("i8") + self.counts[right]
            total, first = int(n.sum()), self._place(whole, n)
            ends = np.cumsum(n)
            nth = np.arange(total) - np.repeat(ends - n, n)
            of = np.repeat(self.counts[left], n)
            base = np.where(nth < of, np.repeat(self.starts[left], n), np.repeat(self.starts[right], n) - of)
            self.flat[first : first + total] = self.flat[base + nth]
        else:
            self._add(words)

    def _add(self, words: list[str]) -> None:
        """Words of Latin-1 letters only are one piece that the normaliser leaves as it is, so they
        go straight to the library's model, in the byte alphabet; others go all the way."""
        plain = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or max(w) <= "\xff")]
        of = dict(zip(plain, plain))
        rest = [w for w in words if w not in of]
        model = self.library.model.tokenize
        ids = [[t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))] for w in plain]
        ids += [x.ids for x in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), "i8", len(ids))
        total, first = int(counts.sum()), self._place([*plain, *rest], counts)
        self.flat[first : first + total] = np.fromiter(chain.from_iterable(ids), "u2", total)

    def _place(self, words: list[str], counts: np.ndarray) -> int:
        """Room for new words' ids; where it begins."""
        at, first, total = len(self.index), self.used, int(counts.sum())
        self._room("flat", first + total)
        self._room("starts", at + len(words))
        self._room("counts", at + len(words))
        self.starts[at : at + len(words)] = first + np.cumsum(counts) - counts
        self.counts[at : at + len(words)] = counts
        self.used += total
        self.index.update(zip(words, range(at, at + len(words))))
        return first

    @staticmethod
    def _plain(text: str) -> str:
        """The vocabulary has no upper case. Only for Latin-1, where lower case is one to one."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        was = gc.isenabled()
        gc.disable()  # learning makes many small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(x in t for x in WHOLE)]
        if whole:
            odd = set(whole)
            flat, counts = self._encode([t for i, t in enumerate(texts) if i not in odd])
            ends, parts, rest = np.cumsum(counts), [], 0
            for i, t in enumerate(texts):
                if i in odd:
                    parts.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "u2"))
                else:
                    parts.append(flat[ends[rest] - counts[rest] : ends[rest]])
                    rest += 1
            return np.concatenate(parts), np.array([len(p) for p in parts], "i8")
        split = pc.ascii_split_whitespace(pa.array(map(self._plain, texts), pa.string(), size=len(texts)))
        coded = split.flatten().dictionary_encode()  # every word of the block once; of blanks side by side comes a word without ids
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > self.most:
            self._forget()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), "i4", len(words))
        if len(lost := np.flatnonzero(known < 0)):
            new = list(map(words.__getitem__, lost.tolist()))
            self._learn(new)
            known[lost] = np.fromiter(map(self.index.__getitem__, new), "i4", len(new))
        codes = coded.indices.to_numpy()
        self._room("uses", len(self.index))
        self.uses[known] += np.bincount(codes, minlength=len(words)).astype("u4")
        if not len(codes):
            return np.zeros(0, "u2"), np.zeros(len(texts), "i8")
        at = known[codes]
        counts = self.counts[at]
        ends = np.cumsum(counts, dtype="i8")
        flat = self.flat[np.repeat((self.starts[at] - ends + counts).astype("i4"), counts) + np.arange(ends[-1], dtype="i4")]
        sums = np.concatenate([[0], ends])
        edges = split.offsets.to_numpy()
        return flat, sums[edges[1:]] - sums[edges[:-1]]


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("tokens", path), lambda: Encoder(path))


def blocks(texts: list, size: int = 1_000_000):
    """(first, texts) in runs of about `size` characters; null: empty."""
    first, run, n = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        n += len(run[-1])
        if n >= size:
            yield first, run
            first, run, n = i + 1, [], 0
    if run:
        yield first, run
