"""Token operators: packing, binary shards, sharding."""

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD_TEXTS, VOCABULARY  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpact.llm.binary import Shard, compress, expansion_lengths, frequent_pairs, neighbours, stretches, token_files, write_shard
from sparkpact.llm.packing import pack, plan_best_fit
from sparkpact.llm.shards import Bins, best_fit_decreasing, shard_by_bytes
from sparkpact.llm.tokens import Encoder


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    own = test_encoder_is_the_library.encoder = getattr(test_encoder_is_the_library, "encoder", None) or Encoder(VOCABULARY, most=60)
    texts = texts + ["It's naïve, 'quoted'. x's *** a.b, c."]
    flat, counts = own.encode(texts)
    want = [x.ids for x in own.library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    used, seen = {}, Counter()
    for length, first, count, sequence, each, offset in plan_best_fit(counts, 50):
        assert first == seen[length]
        seen[length] += count
        for k in range(count):
            at = (sequence + k // each, offset + k % each * length)
            assert at not in used and at[1] + length <= 50
            used[at] = length
    assert dict(seen) == counts
    for seq in {s for s, _ in used}:
        parts = sorted((o, n) for (s, o), n in used.items() if s == seq)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]


def test_plan_is_best_fit():
    assert len({r[3] for r in plan_best_fit({30: 1, 25: 1, 20: 1, 15: 1, 10: 1}, 50)}) == 2


def test_pack_odd_documents(odd_docs):
    rows = pack(odd_docs, VOCABULARY, 64).toPandas()
    lib = library()
    texts = [t or "" for t in ODD_TEXTS] + ["x", "x", "x", "", "a b c d e f g", "a b c d e f g"]
    want = [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert rows.length.sum() == sum(map(len, want))
    crcs = Counter(zlib.crc32(np.array(w[k : k + 64], "<u4").tobytes()) for w in want for k in range(0, len(w), 64))
    assert Counter(rows.ids_crc32.tolist()) == crcs
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 64 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()


def test_pack_and_files_of_nothing(docs_of):
    assert pack(docs_of([]), VOCABULARY).count() == 0
    assert token_files(docs_of([]), VOCABULARY).count() == 0
    assert shard_by_bytes(docs_of([])).count() == 0


@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=1, max_size=12), st.integers(2, 4))
@settings(max_examples=150, deadline=None)
def test_shards_round_trip(docs, least):
    ids = np.array([i for x in docs for i in x], "u2")
    shard = Shard(write_shard(ids, np.array([len(x) for x in docs]), 49_408, least=least))
    order = list(range(len(docs)))[::-1]
    assert [shard.document(k).tolist() for k in order] == [docs[k] for k in order]
    if len(shard.rules):
        assert [len(shard.expand(np.array([49_408 + k]))) for k in range(len(shard.rules))] == shard.lengths.tolist()


def test_files_odd_documents(odd_docs):
    rows = token_files(odd_docs, VOCABULARY).toPandas().sort_values("start")
    assert len(rows) == odd_docs.count()
    assert rows.start.tolist() == (rows.n_tokens.cumsum() - rows.n_tokens).tolist()
    assert rows.doc_id.isna().tolist()[:2] == [True, True] and rows.doc_id.dropna().is_monotonic_increasing
    lib = library()
    for k, t in enumerate(ODD_TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        mine = rows[(rows.doc_id == k) & (rows.n_tokens == len(ids))]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) in mine.ids_crc32.tolist()


@given(st.lists(st.tuples(st.sampled_from(["add", "take", "roomiest"]), st.integers(0, 30)), max_size=80))
@settings(max_examples=200, deadline=None)
def test_bins_take_the_tightest(steps):
    bins, plain = Bins(), []
    for k, (what, size) in enumerate(steps):
        if what == "add":
            bins.add(size, k)
            plain.append((size, k))
            continue
        fits = [b for b in plain if b[0] >= size] if what == "take" else plain
        want = (min if what == "take" else max)(fits, default=None)
        if what == "take" or want:
            assert (bins.take(size) if what == "take" else bins.roomiest()) == want
        if want:
            plain.remove(want)


def plain_best_fit(sizes, capacity, shards):
    """Every group on its own, by descending size, to the bin with least room that takes it."""
    room = [capacity] * (shards or 0)
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if not fits and shards is None:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        r, k = min(fits) if fits else max((r, k) for k, r in enumerate(room))
        room[k] = r - size
    return room


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.sampled_from([None, 3, 7]))
@settings(max_examples=200, deadline=None)
def test_counts_are_packed_as_single_groups_are(sizes, shards):
    capacity = 40 if shards is None else max(1, -(-sum(sizes) // shards))
    room: dict = {}
    for size, _, n, k in best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), capacity, shards):
        room[k] = room.get(k, capacity) - n * size
    plain = plain_best_fit(sizes, capacity, shards)
    if shards is None:
        assert len(room) == len(plain) and min(room.values()) >= 0
    else:
        assert max(capacity - r for r in room.values()) <= max(capacity - r for r in plain) + max(sizes)


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=20, unique_by=lambda x: x[0]))
@settings(max_examples=150, deadline=None)
def test_shard_plan(sizes):
    sizes = sorted(sizes, reverse=True)
    seen = Counter()
    for size, first, n, _ in best_fit_decreasing(sizes, max(1, -(-sum(a * b for a, b in sizes) // 4)), 4):
        assert first == seen[size]
        seen[size] += n
    assert dict(seen) == dict(sizes)


def test_shards_keep_groups_and_split_only_huge_ones(docs_of):
    rows = [(k, f"text {k} " * (k % 7 + 1)) for k in range(400)] + [(1000 + k, "copy") for k in range(6)] + [(2000 + k, "hot passage " * 10) for k in range(300)] + [(None, None), (7, None)]
    got = shard_by_bytes(docs_of(rows), 8).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and total.max() - total.min() <= 200
    assert got[got.doc_id.between(1000, 1005)].shard.nunique() == 1
    assert got[got.doc_id >= 2000].shard.nunique() > 1  # larger than a shard
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    kept = shard_by_bytes(docs_of(rows), 8, whole=True).toPandas()
    assert kept[kept.doc_id >= 2000].shard.nunique() == 1
    few = shard_by_bytes(docs_of(rows[:406]), None, capacity=4000).toPandas()
    groups = few.groupby("text_crc32")["size"].sum()
    assert few.shard.nunique() == len(plain_best_fit(groups.tolist(), 4000, None)) and few.groupby("shard")["size"].sum().max() <= 4000


def re_pair(ids, least):
    """One pair at a time, the most frequent first: length of what is left, and the rules."""
    ids, rules = list(ids), 0
    while True:
        seen, last, k = Counter(), {}, 0
        for k in range(len(ids) - 1):
            pair = (ids[k], ids[k + 1])
            if last.get(pair) != k - 1 or pair[0] != pair[1]:
                seen[pair] += 1
                last[pair] = k
        best = max(seen, key=lambda p: (seen[p], p), default=None)
        if best is None or seen[best] < least:
            return len(ids), rules
        out, k = [], 0
        while k < len(ids):
            hit = k + 1 < len(ids) and (ids[k], ids[k + 1]) == best
            out.append(-1 - rules if hit else ids[k])
            k += 2 if hit else 1
        ids, rules = out, rules + 1


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 50, rng.integers(2, 9)).tolist() for _ in range(40)]
    ids = np.array([i for k in rng.zipf(1.4, 2500) % 40 for i in words[k]], "u2")
    rules, symbols, _ = compress(ids, np.array([len(ids)]), 49_408)
    pairs = Counter(zip(symbols.tolist(), symbols.tolist()[1:]))
    assert all(n < 16 or a == b for (a, b), n in pairs.items())
    left, n = re_pair(ids.tolist(), 16)
    assert len(symbols) + 4 * len(rules) <= 1.25 * (left + 4 * n)  # rules made together cost a little


@pytest.mark.parametrize("text", ["İ! x", "aİ,. İ", "é! a\u00a0b!  c ", "\u00a0", " \t\n"])
def test_encoder_where_marks_follow_odd_letters_and_blanks(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    flat, n = Encoder(VOCABULARY).encode([text, "", text])
    assert flat.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def test_rules_are_laid_out_many_at_a_time():
    """Pairs are counted from the frequent ones alone, and the rules of a round go in one step: not one step a rule."""
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 2000, rng.integers(2, 9)).tolist() for _ in range(3000)]
    ids = np.array([i for k in rng.integers(0, 3000, 60_000) for i in words[k]], "u2")
    counts = np.full(-(-len(ids) // 500), 500)
    counts[-1] = len(ids) - counts[:-1].sum()
    ends = np.cumsum(counts) - 1
    apart = set(ends.tolist())
    plain = Counter(int(a) << 16 | int(b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if k not in apart)
    assert dict(zip(*(v.tolist() for v in frequent_pairs(neighbours(ids, ends), 16)))) == {p: n for p, n in plain.items() if n >= 16}
    rules, symbols, _ = compress(ids, counts, 49_408)
    steps = list(stretches(rules, 49_408))
    assert len(rules) > 2000 and len(steps) <= 30 and [a for a, _ in steps] == [0, *(b for _, b in steps[:-1])]
    size = [1] * 49_408
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    assert expansion_lengths(rules, 49_408).tolist() == size[49_408:]
    assert (Shard(write_shard(ids, counts, 49_408)).documents()[0] == ids).all()
    with pytest.raises(ValueError):
        list(stretches(np.array([[1, 2], [49_409, 1]], "u2"), 49_408))


@pytest.mark.parametrize("name", ["length", "offset"])
def test_clashing_columns(docs_of, name):
    docs = docs_of([(1, "a b"), (2, "c")]).withColumnRenamed("lang", name).withColumnRenamed("source", "size")
    assert pack(docs, VOCABULARY).count() == 2
    assert shard_by_bytes(docs, 2).count() == 2


@pytest.mark.parametrize("whole", [False, True])
def test_shards_are_those_of_plain_best_fit(docs_of, whole):
    """The whole table against a plain version: texts larger than a shard, groups larger than one, ties."""
    rng = np.random.default_rng(4)
    sizes = [9000, 7000, 7000, 2500, *rng.integers(1, 400, 120).tolist()]
    rows = [(k, chr(97 + k % 26) * n) for k, n in enumerate(sizes)] + [(900 + k, "copy " * 30) for k in range(40)] + [(None, None), (990, "")]
    got = shard_by_bytes(docs_of(rows), 12, whole=whole).toPandas()
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    groups = Counter((t or "") for _, t in rows)
    total, left = sum(len(t.encode()) * n + 16 * n for t, n in groups.items()), 12
    for s in sorted(((len(t.encode()) + 16) * n for t, n in groups.items()) if whole else size.values(), reverse=True):
        if left == 1 or s * left <= total:
            break
        total, left = total - s, left - 1
    capacity = -(-total // left)
    units = []
    for t, n in groups.items():
        each = len(t.encode()) + 16
        per = n if whole or each * n <= capacity else max(1, capacity // each)
        units += [each * min(per, n - k) for k in range(0, n, per)]
    want = plain_best_fit(units, capacity, 12)
    assert sorted(got.groupby("shard")["size"].sum().tolist()) == sorted(capacity - r for r in want if r != capacity)
    own = got.groupby("shard")["size"].sum().sort_values()
    assert got.shard.nunique() == 12
    if not whole:
        assert own.iloc[:-3].max() - own.iloc[:-3].min() <= 0.1 * capacity and own.iloc[-1] == 9016
