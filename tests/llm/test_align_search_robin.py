"""Cross-tokenizer alignment, lexical search and mixture-controlled packing, against plain versions."""

import hashlib
import math
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS, VOCABULARY
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpact.llm.alignment import Vocabularies, align, bitmaps, members, run_of
from sparkpact.llm.lexical import SEARCH_SQL, best_documents
from sparkpact.llm.roundrobin import END, FRACTION, Queues, pack_mixed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# alignment


class Plain:
    """Both libraries over whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        in_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = [self.bytes_b(i) for i in b]
        if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
        found, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            found.append((a[i:p], b[j:q]))
            i, j = p, q
        return found


def plain_alignment(texts):
    plain = Plain()
    all_ = [plain.groups(t) for t in texts]
    links = [Counter((i, j) for x, y in g or [] for i in x for j in y) for g in all_]
    docs = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    rows = []
    for g, c in zip(all_, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        rows.append((
            sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(c.values()),
            sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return rows


STRANGE = [
    "▁ sign", "a▁b", "it's 'tis  don't'store", "two  blanks\n\nand\tlines \n x", " leads", "ends ", "\n", "a b 　c", "x\x1c!!\x1cfoo", "éa été.\nÉa",
    "中文文字。中文", "\U0001f600\U0001f600a", "<|endoftext|> <s> </s>", "1234567 8.9,1", "\x00\x01", "a\r\nb", "foo!!! (bar)--baz_qux", "œuvre ǅ", "᠎ x\x85y", "﻿bom",
]


def test_alignment_against_both_libraries(docs_of):
    texts = [*ODD_TEXTS, *STRANGE, *STRANGE[:5], "the cat and the cat. The end.\nthe cat"]
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)]
    for most in ((8192, 3_000_000), (3, 3_000_000), (8192, 50)):
        got = {r.doc_id: tuple(r)[1:] for r in align(docs_of(rows), A, B, *most).collect()}
        assert [got[i] for i, _ in rows] == plain_alignment(texts)


@given(st.lists(st.text(alphabet="abé \n.,'s1 ́中\t-", max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_units_are_encoded_as_in_the_text(texts):
    own = test_units_are_encoded_as_in_the_text.made = getattr(test_units_are_encoded_as_in_the_text, "made", None) or (Vocabularies(A, B, most=50), Plain())
    rows, doc, pairs, times = run_of(own[0], list(range(len(texts))), texts)
    for k, t in enumerate(texts):
        g = own[1].groups(t)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        assert rows[k][5] == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        links = Counter(i * 32000 + j for x, y in g or [] for i in x for j in y)
        mine = Counter()
        for p, n in zip(pairs[doc == k].tolist(), times[doc == k].tolist()):
            mine[p] += n
        assert mine == links and rows[k][4] == sum(links.values())


def test_the_vocabularies_allow_units():
    assert Vocabularies(A, B).apart


@given(st.integers(1, 300), st.lists(st.sets(st.integers(0, 299), max_size=120), max_size=8))
@settings(max_examples=100, deadline=None)
def test_bitmaps_give_back_their_places(width, sets):
    sets = [sorted(x for x in s if x < width) for s in sets]
    of, places = (np.array([v for k, s in enumerate(sets) for v in [(k, x)[n] for x in s]], "i8") for n in (0, 1))
    row, place = members(bitmaps(of, places, len(sets), width), np.full(len(sets), width))
    assert sorted(zip(row.tolist(), place.tolist())) == sorted(zip(of.tolist(), places.tolist()))


BLOCK_ALONE = """
import sys

import pyarrow as pa

from sparkpact.llm.alignment import scores_of_block

print(scores_of_block(pa.ipc.open_stream(sys.argv[1]).read_all()).to_pylist())
"""


def test_scores_of_a_block_need_no_import_made_elsewhere(tmp_path):
    """A worker may begin with a block's scores, as the table comes from the JVM: then only the module's own imports are there."""
    own = {"doc_id": 7, "n_a": 1, "n_b": 1, "n_groups": 1, "n_links": 1}
    plane = bitmaps(np.array([0]), np.array([0]), 1, 1).to_pylist()
    group = pa.table({
        "nth": pa.array([0, -1], pa.int32()), **{c: pa.array([v, None], pa.int64()) for c, v in own.items()}, "groups_sha256": pa.array(["x", None]),
        "planes": pa.array([None, plane], pa.list_(pa.binary())), "count": pa.array([None, 5], pa.int64()), "top": pa.array([None, True]),
    })
    with pa.OSFile(str(tmp_path / "block"), "wb") as f, pa.ipc.new_stream(f, group.schema) as stream:
        stream.write_table(group)
    out = subprocess.run([sys.executable, "-c", BLOCK_ALONE, tmp_path / "block"], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[2])
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == str([own | {"n_best": 1, "count_sum": 5, "groups_sha256": "x"}])


def test_alignment_of_nothing_and_other_columns(spark, docs_of):
    assert align(docs_of([]), A, B).count() == 0
    docs = spark.createDataFrame([(1, "a b", 2, "x")], "doc_id long, text string, pair long, `n.a` string")
    assert [r.n_a for r in align(docs, A, B).collect()] == [2]


# lexical search


def plain_search(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_words = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(1, n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_against_all_scores(spark, docs_of):
    rng = np.random.default_rng(5)
    names = ["The", "of", "naïve", "x1", "rare", "blue", "中文", "green"] + [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(names, int(n), p=(q := np.arange(len(names), 0, -1.0) ** 2) / q.sum())) for n in rng.integers(1, 60, 150)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(200 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "rare blue rare"), (300, texts[0]), (301, texts[0])]
    asked = [(1, "the RARE blue"), (2, "of of the"), (3, "中文, naïve!"), (4, None), (5, "..."), (6, "absent"), (7, "w3 w4 w5 w29 green x1 " * 3)]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = plain_search(docs, asked)
    for docs_each, words_each, bytes_ in ((8192, 10**6, 10**6), (7, 10**6, 10**6), (8192, 40, 20)):
        got = best_documents(docs_of(docs), items, 10, docs_each, words_each, bytes_).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_search_of_nothing(spark, docs_of):
    items = spark.createDataFrame([(1, "a"), (1, "a")], "item_id long, text string")
    assert best_documents(docs_of([]), items).count() == 0
    assert best_documents(docs_of([(1, "a b")]), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in best_documents(docs_of([(1, "b"), (2, "a b")]), items).collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_search_agrees_with_its_sql(spark, size):
    import duckdb

    db, at = duckdb.connect(), f"/root/testdata/{size}"
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    got = best_documents(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(SEARCH_SQL).fetchall())


# mixture-controlled packing


def plain_robin(sizes, capacity, grain):
    """Deficit round-robin queue by queue: (queue, id) in the order in which they are sent."""
    total, at, deficit, out = sum(sizes), [0] * len(sizes), [0] * len(sizes), []
    quanta = [-(-capacity * n * (1 << FRACTION) // total) for n in sizes]
    while any(a < n for a, n in zip(at, sizes)):
        for s, n in enumerate(sizes):
            deficit[s] += quanta[s]
            while at[s] < n and deficit[s] >> FRACTION >= (packet := min(grain, n - at[s])):
                deficit[s] -= packet << FRACTION
                out += [(s, at[s] + k) for k in range(packet)]
                at[s] += packet
    return out


def lengths_of(total, capacity):
    return [capacity] * (total // capacity) + [1 << b for b in range(40, -1, -1) if total % capacity >> b & 1]


@pytest.mark.parametrize("sizes", [[1], [5000], [3000, 17, 1, 900], [64, 64, 64], [40000, 3, 2, 1, 7000, 999]])
@pytest.mark.parametrize("capacity,grain", [(64, 8), (2048, 32), (16, 16)])
def test_pieces_are_those_of_plain_round_robin(sizes, capacity, grain):
    rng = np.random.default_rng(3)
    where = {x: k for k, x in enumerate(plain_robin(sizes, capacity, grain))}
    docs = []
    for s, n in enumerate(sizes):
        at = 0
        while at < n:
            docs.append((s, at, min(n - at, int(rng.integers(1, 300)))))
            at += docs[-1][2]
    starts = np.concatenate([[0], np.cumsum(lengths_of(sum(sizes), capacity))])
    p = Queues(sizes, capacity, grain).pieces(*(np.array(c) for c in zip(*docs)))
    for d, start, n, sequence, offset in zip(*(c.tolist() for c in p.values())):
        s, begin, _ = docs[d]
        assert [where[s, begin + start + k] for k in range(n)] == [starts[sequence] + offset + k for k in range(n)]
        assert starts[sequence] + offset + n <= starts[sequence + 1]
    assert p["length"].sum() == sum(sizes)


@pytest.mark.parametrize("queues", [512, 3, 1])
def test_mixed_sequences_hold_every_id_once(docs_of, queues):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = [*ODD_TEXTS, *[f"some words of text {k} and more of them" for k in range(200)]]
    rows = [(k, t, (None, "hot", "b", "hot", "hot")[k % 5]) for k, t in enumerate(texts)] + [(3, "x", "b"), (None, "x", "solo"), (3, "x", "b")]
    got = pack_mixed(docs_of(rows), VOCABULARY, 64, 4, queues).toPandas()
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [END], "<u4") for _, t, _ in rows]
    assert got.length.sum() == sum(map(len, ids))
    known = {(i, zlib.crc32(x.tobytes())) for (i, _, _), x in zip(rows, ids)}
    by_doc = {i: x for (i, _, _), x in zip(rows, ids)}
    for r in got.itertuples():
        x = by_doc[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert known
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.tolist() == lengths_of(int(got.length.sum()), 64)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    if queues > 4:  # in every full window the hot source is within a few packets of its share
        hot = got[got.source == "hot"].groupby("sequence_id").length.sum().reindex(lengths.index).fillna(0)[lengths == 64].to_numpy() / 64
        assert np.abs(hot[:-2] - got[got.source == "hot"].length.sum() / got.length.sum()).max() <= 5 * 4 / 64


def test_mixed_packing_of_many_sources_and_none(docs_of):
    assert pack_mixed(docs_of([]), VOCABULARY).count() == 0
    rows = [(k, "a few words", f"s{k}") for k in range(100)]
    got = pack_mixed(docs_of(rows), VOCABULARY, 16, 2).toPandas()
    assert got.length.sum() == 400 and sorted(got.groupby("doc_id").length.sum()) == [4] * 100
