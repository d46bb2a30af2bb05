"""Jaccard join, suffix dedup: against brute force on planted rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkpact.llm.common import FREE_SHUFFLES, Scratch
from sparkpact.llm.components import components
from sparkpact.llm.jaccard import Parts, candidates, jaccard_components, join_sets, keep_one, shingle_sets
from sparkpact.llm.jaccard import Tree, linked
from sparkpact.llm.suffix import cut_repeats, equal_windows, suffix_ranks, suffix_spans


def planted(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        text = " ".join(own)
        rows.append(text)
        if k % 3 == 0:
            rows.append(passage + " " + text)
        for _ in range(k % 4):
            near = own[:]
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append(" ".join(near))
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b c"), (905, " \t "), (907, rows[0])]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent,block", [(4, 85, 1024), (5, 80, 3)])
def test_jaccard_against_brute_force(docs_of, n, percent, block):
    rows = planted()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs_of(rows), n, percent, block).collect()}
    assert got == brute(rows, n, percent)


def test_jaccard_odd_rows(odd_docs, docs_of):
    got = jaccard_components(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    assert got[got.doc_id == 51].component_id.tolist() == [50]
    assert got[got.n_shingles == 0].doc_id.fillna(-1).tolist() == got[got.n_shingles == 0].component_id.fillna(-1).tolist()
    assert jaccard_components(docs_of([])).count() == 0


def test_keep_one(docs_of, odd_docs):
    rows = planted()
    want = {i for i, (size, root) in brute(rows, 5, 80).items() if root == i or not size}
    assert {r.doc_id for r in keep_one(docs_of(rows)).collect()} == want
    left = keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    assert left.where("doc_id = 3 and text = 'x'").count() + left.where("doc_id is null and text = 'x'").count() == 1


@given(st.integers(0, 10_000), st.integers(5, 60), st.sampled_from([80, 85, 90]))
@settings(max_examples=60, deadline=None)
def test_linked_sets_share_what_they_need(seed, size, percent):
    """No link is missed: linked sets share as many signatures of a level as either needs."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, size * 4).astype("u8")
    a = np.unique(base[: size * 3])
    b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], base[size * 3 : size * 3 + rng.integers(0, 1 + len(a) // 12)]]))
    if not linked(a, b, percent) or len(a) == len(np.intersect1d(a, b)) == len(b):
        return
    parts = Parts(percent)
    (sa, na), (sb, nb) = parts.signatures(a), parts.signatures(b)
    both, ia, ib = np.intersect1d(sa, sb, return_indices=True)
    assert len(both)
    for sign in (1, -1):
        for need, index in ((na, ia), (nb, ib)):
            mine = index[np.sign(need[index]) == sign]
            other = np.intersect1d(sa, sb)
            if len(mine):
                assert len(mine) >= abs(need[mine[0]]) or len(other) > len(mine)
    assert any(len(i) and (np.abs(n[i]) <= [(np.sign(n[i]) == np.sign(x)).sum() for x in n[i]]).any() for n, i in ((na, ia), (nb, ib)))


def test_dual_traversal_rules_out_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 63, 80).astype("u8"))
        sets += [base, np.unique(np.append(base[3:], rng.integers(0, 1 << 63, 2).astype("u8")))]
    tree = Tree(sets)
    a, b = candidates(tree, tree, 85)
    found = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    want = {frozenset((i, j)) for i in range(80) for j in range(i) if linked(sets[i], sets[j], 85)}
    assert want <= found and len(found) < 400
    roots = join_sets(sets, np.zeros(80, "i4"), 85)
    assert all(roots[i] == roots[j] for i, j in map(tuple, want))


def test_shingles_fold_ascii_only():
    same = list(shingle_sets(["A B C D", "a b c d", "É b c d", "é b c d", "a\x0bb\x0cc\rd"], 4))
    assert same[0] == same[1] == same[4] and same[2] != same[3]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 400), (400, 450), (7, 7)], "a long, b long")
    for most in (5, 10_000):
        got = {r.node: r.root for r in components(links, Scratch(spark, "t"), "c", most).collect()}
        assert got == {**{k: 0 for k in range(301)}, 400: 400, 450: 400, 500: 400}


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_suffix_ranks(t, limit):
    ranks = suffix_ranks(np.array(t, "i8"), limit)
    order = sorted(range(len(t)), key=lambda k: ranks[k])
    cut = [tuple(t[k : k + limit]) for k in order]
    assert cut == sorted(cut)


def test_equal_windows():
    a, b = b"abcdefghij" * 12, b"xx" + b"abcdefghij" * 11
    of, window, classes = equal_windows([a, b], 100)
    where = {}
    for o, w, c in zip(of.tolist(), window.tolist(), classes.tolist()):
        where.setdefault(c, set()).add((a if o == 0 else b)[w : w + 100])
    assert all(len(v) == 1 for v in where.values()) and len(where) == len({x for v in where.values() for x in v})


def spans(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_spans_against_brute_force(docs_of):
    passage = "The quick brown fox, naïve and öld, jumps over the lazy dog while nobody at all is watching it from the hill. "
    rows = planted(2) + [(1000, passage * 3), (1001, "z" * 350), (1002, "x" + passage + "y"), (1003, "z" * 120), (1004, "ab" * 200), (1005, passage[:99])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_spans(docs_of(rows)).collect()}
    assert got == spans(rows)


def test_suffix_spans_free_what_was_read(spark, docs_of):
    """What later steps don't read is gone before the last shuffle, and settings are as they were."""
    passage = "".join(chr(97 + k * k % 23) + " " * (k % 7 == 0) for k in range(150))
    before = list(Scratch.open)
    spans = suffix_spans(docs_of([(1, f"one {passage}"), (2, f"two {passage} more"), (3, "short")]))
    [scratch] = [s for s in Scratch.open if s not in before]
    for name, there in (("again", False), ("stretches", False), ("marks", True)):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.path(name))
        assert at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) is there, name
    assert spark.conf.get(FREE_SHUFFLES) == "false"
    assert {r.doc_id: r.n_removed for r in spans.collect()} == {1: 0, 2: len(f" {passage}"), 3: 0}


def test_suffix_odd_rows(odd_docs, docs_of):
    got = suffix_spans(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and suffix_spans(docs_of([])).count() == 0
    twice = docs_of([(1, "q" * 50 + "r" * 60), (1, "q" * 50 + "r" * 60)])
    assert sorted(r.n_removed for r in suffix_spans(twice).collect()) == [0, 110]
    left = cut_repeats(twice)
    assert left.columns == twice.columns and left.count() == 1


def test_cut_repeats_keeps_columns(docs_of):
    long_ = "Some passage of well over a hundred bytes, é included, that is said in one document and then again in another one. "
    docs = docs_of([(1, long_), (2, "before " + long_ + "after"), (3, None)]).withColumn("raw", F.lit(1))
    got = {r.doc_id: r for r in cut_repeats(docs).collect()}
    assert got[2].text == "before after" and got[2].n_chars == 12 and got[3].text is None or got[3].text == ""
    assert got[1].text == long_ and got[1].raw == 1


@pytest.mark.parametrize("most_broadcast", [400_000, 0])
def test_near_copies_without_doc_ids_link(docs_of, most_broadcast):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    far = lambda c: " ".join(f"{c}{k}" for k in range(60))
    nulls = [(None, " ".join(base)), (None, near), (None, " ".join(base))]
    mixed_ = [(7, far("x")), (None, far("x") + " more"), (8, far("y"))]
    got = jaccard_components(docs_of(nulls + mixed_), most_broadcast=most_broadcast).toPandas()
    assert len(got) == 6 and sorted(got.component_id.dropna()) == [7, 7, 8]
    kept = keep_one(docs_of(nulls + mixed_), most_broadcast=most_broadcast).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 7), (False, 8), (True, 0)]
