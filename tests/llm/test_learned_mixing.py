"""Mixing, licences, toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpact.llm.license import TEMPLATES, UNKNOWN, fit, scan
from sparkpact.llm.mixing import mix_rows, mixed, targets
from sparkpact.llm.toxicity import Model, all_words, bags, fit as fit_toxic, held_out, platt, score_toxicity, windows_mean


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in cut]
        left = total - sum(most * sizes[s] for s in cut)
        made = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if made[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in cut else made[s] for s in names}
        cut |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, "d": 2000, None: 5}, {"a": 1}, {"a": 0, "b": 7}, {"x": 100, "y": 100, "z": 100}, {"x": 5, "y": 3, "z": 1}, {"a": 10, "b": 4, "c": 2, "d": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_comes_near_its_targets(docs_of):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), s) for k, s in enumerate(rng.choices(["a", "b", "c", "d", None], [1, 5, 60, 30, 4], k=1500))]
    rows += [(None, "null id here", "a"), (3, None, "a")]
    docs = docs_of(rows)
    got = mix_rows(docs).toPandas()
    again = mix_rows(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
        assert g.source_size.iloc[0] == g["size"].sum()
    out = mixed(docs)
    assert out.columns == docs.columns
    words = out.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert 0.8 < words / got["size"].sum() < 1.2


@pytest.mark.parametrize("sizes,block", [({"x": 5, "y": 3, "z": 1}, 512), ({"a": 60, "b": 60, "c": 60}, 64), ({"a": 700, "b": 9, "c": 3000, None: 40}, 16)])
def test_small_sources_and_ties_come_near_their_targets(docs_of, sizes, block):
    rows = [(100 * k + i, " ".join(["w"] * (n // 3 + (i == 0) * (n % 3))), name) for k, (name, n) in enumerate(sizes.items()) for i in range(3)]
    got = mix_rows(docs_of(rows), block=block).toPandas()
    for name, target in water(sizes).items():
        own = got[got.source.isna()] if name is None else got[got.source == name]
        assert abs(own.taken.sum() - target) <= 0.5 and (own.taken <= 3 * own["size"]).all()
        assert own.target.iloc[0] == pytest.approx(target)


def test_the_schedule_holds_every_stretch_near_its_shares(spark):
    from sparkpact.llm.mixing import schedule, slot_point

    plan = spark.createDataFrame([(1, 0.0, 0.5, 500), (2, 0.5, 0.8, 300), (3, 0.8, 1.0, 203)], "number int, `from` double, `to` double, need long")
    got = schedule(plan, 1000, cells=7, chunk=64).toPandas().sort_values("slot")
    points = spark.range(1000).select(slot_point(F.col("id")).alias("p")).toPandas().p.tolist()
    want, ranks = [], {1: 0, 2: 0, 3: 0}
    for slot, p in enumerate(points):
        n = 1 if p < 0.5 else 2 if p < 0.8 else 3
        if ranks[n] < {1: 500, 2: 300, 3: 203}[n]:
            want.append((n, ranks[n], slot))
        ranks[n] += 1
    late = [(n, r) for n, need in ((1, 500), (2, 300), (3, 203)) for r in range(ranks[n], need)]
    assert list(got[["number", "rank", "slot"]].itertuples(index=False, name=None)) == want + [(n, r, 1000 + k) for k, (n, r) in enumerate(late)]
    for first in range(0, 950, 50):
        stretch = got[(got.slot >= first) & (got.slot < first + 50)]
        assert all(abs((stretch.number == n).sum() - 50 * share) <= 2.5 for n, share in ((1, 0.5), (2, 0.3), (3, 0.2)))


def test_every_stretch_of_the_mix_holds_its_shares(docs_of):
    """In the mix itself, as it is written: sources of very different sizes keep their shares all along."""
    rows = [(k, "w " * 40, "a" if k < 150 else "b" if k < 750 else "c") for k in range(1500)]
    docs = docs_of(rows)
    sized = mix_rows(docs, block=80).toPandas()
    share = sized.groupby("source").target.first() / sized.groupby("source").target.first().sum()
    out = [r.source for r in mixed(docs, block=80).collect()]
    assert abs(len(out) - 1500) <= 15
    for first in range(0, len(out) - 200, 100):
        stretch = out[first : first + 200]
        assert all(abs(stretch.count(s) / 200 - share[s]) <= 0.06 for s in "abc"), first
    met = sized[sized.taken > 0].sort_values("first_slot").source.tolist()[:300]  # so also first places
    assert all(abs(met.count(s) / 300 - share[s]) <= 0.1 for s in "abc")
    assert sized.first_slot.isna().sum() == (sized.taken == 0).sum()


def test_mix_keeps_rows_with_odd_columns(docs_of):
    docs = docs_of([(1, "a b c"), (2, "d e"), (None, "f")]).withColumns({"size": F.lit("x"), "_key": F.lit(1), "target": F.create_map(F.lit("a"), F.lit(1)), "number": F.lit(2)})
    assert mix_rows(docs).select("taken").toPandas().taken.sum() == 6
    assert mixed(docs).columns == docs.columns and mixed(docs).count() == 3


def test_mix_of_nothing(docs_of, odd_docs):
    assert mix_rows(docs_of([])).count() == 0
    assert mix_rows(docs_of([(1, None), (2, "")])).toPandas().taken.sum() == 0
    assert mix_rows(odd_docs).count() == odd_docs.count()
    assert mix_rows(odd_docs.withColumnRenamed("lang", "target")).count() == odd_docs.count()


def test_licence_families_and_decoys(docs_of):
    plain = [(k, f"Line {k} of no interest.\n{t[0].upper() + t[1:]}.\nAnd more text.") for k, (_, t) in enumerate(TEMPLATES)]
    decoys = [(100 + k, t) for k, t in enumerate(["The MIT campus is open.", "All rights were discussed.", "He has a driving licence.", "Released in 2020.", None, ""])]
    got = {r.doc_id: r for r in scan(docs_of(plain + decoys)).collect()}
    right = sum(got[k].license == f for k, (f, _) in enumerate(TEMPLATES))
    assert right >= len(TEMPLATES) - 2
    assert all(got[100 + k].license is None and got[100 + k].n_paragraphs == 0 for k in range(len(decoys)))
    assert got[0].first_paragraph == 1


def test_licence_odd_rows(odd_docs, docs_of):
    assert scan(odd_docs).count() == odd_docs.count() and scan(docs_of([])).count() == 0
    both = scan(docs_of([(1, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")])).first()
    assert both.licenses == "apache-2.0,mit" and both.n_paragraphs == 2


def test_licence_fit_is_sparse():
    lines = [f"the cat sat on the mat of number {k}" for k in range(300)]
    weights, bias, classes = fit(lines)
    assert classes[-1] == UNKNOWN and len(bias) == len(classes)
    w = np.array(list(weights.values()))
    assert (w == 0).mean() > 0.3
    # a word of many lines weighs less than a licence's own
    assert np.abs(weights.get("the", [0])).max() < np.abs(weights["mozilla"]).max()


def brute_scan(texts, weights, bias, classes, least=0.5, confirm=0.7):
    """The same weights applied in plain Python to every line, and every window through the text, without looking for
    words first."""
    from sparkpact.llm.license import SLACK, WINDOW, grams_of, templates, words_of

    two = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    known = [(f, {g: n for n, g in reversed(list(enumerate(two(t.split()))))}) for f, t in templates()]
    common = {(f, g): sum(h == f and g in gs for h, gs in known) for f, own in known for g in own}
    spread = {g: len({h for h, gs in known if g in gs}) for _, own in known for g in own}
    out = []
    for text in texts:
        lines = [words_of(x) for x in (text or "").split("\n")]
        flat = [(w, k) for k, x in enumerate(lines) for w in x]
        units = [(x, [k] * len(x)) for k, x in enumerate(lines)]
        units += [([w for w, _ in flat[s : s + WINDOW]], [k for _, k in flat[s : s + WINDOW]]) for s in range(0, max(len(flat) - WINDOW // 2 - 1, 0) + 1, WINDOW // 2)]
        found = {}
        for words, numbers in units:
            grams, pairs = grams_of(words), two(words)
            logit = np.array(bias) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(bias)))
            chance = {f: 1 / (1 + np.exp(logit[-1] - logit[k])) for k, f in enumerate(classes[:-1])}
            fits = []
            for f, own in known:
                hits = [(g, n, round((n - own[g]) * 1000 / (SLACK + len(own) / 3) + 1e-9)) for n, g in enumerate(pairs) if g in own]
                counts = [len({h for h, _, d in hits if abs(d - shift) <= 1000}) for _, _, shift in hits]
                if own and chance[f] >= least and max(counts, default=0) >= confirm * len(own):
                    fits.append((f, own, max(counts) / len(own), min((-c, -common[f, g], spread[g], n) for c, (g, n, _) in zip(counts, hits))))
            for f, own, share, place in fits:
                if not any(h != f and theirs > share and len(own.keys() & gs.keys()) >= 0.4 * min(len(own), len(gs)) for h, gs, theirs, _ in fits):
                    found.setdefault(f, {}).setdefault(id(words), []).append((chance[f], place, numbers[place[-1]]))
        each = {f: [(c, min(v, key=lambda x: x[1])[2]) for v in by_unit.values() for c in [v[0][0]]] for f, by_unit in found.items()}
        best = max(((max(c for c, _ in v), f) for f, v in each.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0.0, None))
        at = {p for v in each.values() for _, p in v}
        out.append((best[1], round(best[0], 9), ",".join(sorted(each)), len(at), min(at, default=None)))
    return out


def test_scan_against_plain_python(docs_of):
    from sparkpact.llm.license import learn_from

    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choice(["river", "stone", "the", "of", "version", "public", "a", "work", "2"]) for _ in range(n))
    texts = [None, "", plain(5), plain(400)]
    for _, t in TEMPLATES:
        w = t.split()
        texts += [plain(rng.randrange(90)) + "\n" + t + ". " + plain(9), plain(30) + " " + " ".join(w[: len(w) // 2]) + "\n  " + " ".join(w[len(w) // 2 :]) + "\n" + plain(50), " ".join(w[: len(w) // 2])]
    docs = docs_of([(k, t) for k, t in enumerate(texts)] + [(0, None)])
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("key"))
    want = brute_scan(texts, *fit(learn_from(base, 1500)))
    got = {r.doc_id: (r.license, round(r.confidence, 9), r.licenses, r.n_paragraphs, r.first_paragraph) for r in scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


def toxic_rows(n=900, seed=6):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "me", "lo", "sa", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    roots = ["grimzak", "vlorpu", "skadrif"]
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                root = rng.choice(roots)
                words.insert(rng.randrange(len(words)), root + rng.choice(["", "s", "ed", "!!"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows, labels = toxic_rows()
    docs = docs_of(rows + [(5000, "nothing here GRIMZAKY ba ko"), (5001, None), (5002, ""), (None, "ba ko ri")])
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    truth = {k: t for k, _, t in labels}
    kept = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got.held_out[k] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    predicted = np.array([got.predicted[k] for k in kept])
    wanted = np.array([truth[k] for k in kept])
    assert (predicted == wanted).mean() > 0.95
    assert got.score[5000] > got.score[5002]  # an unseen spelling shares n-grams
    assert got.predicted[5001] == 0 and got.score.between(0, 1).all()


def test_toxicity_without_labels(spark, docs_of, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_toxicity(odd_docs.withColumnRenamed("lang", "score"), none).toPandas()
    assert len(got) == odd_docs.count() and (got.predicted == 0).all()
    assert score_toxicity(docs_of([]), none).count() == 0


def test_held_out_is_crc(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_pieces():
    flat, n = bags(["Abc", "***", "abc!", ""], 1 << 17)
    assert n[1] == n[3] == 0 and sorted(flat[: n[0]]) == sorted(flat[n[0] : n[0] + n[2]])
    assert windows_mean(np.arange(10.0), 4).tolist() == [1.5, 3.5, 5.5, 7.5]
    slope, shift = platt(np.array([-1.0, -0.5, 0.5, 1.0] * 20), np.array([0, 0, 1, 1] * 20))
    assert slope > 0
    assert fit_toxic([], []).scores(["a"])[0] < 0.5


def model_of(*toxic):
    weights = np.zeros(1 << 17)
    weights[bags(list(toxic), 1 << 17)[0]] = 9.0
    return Model(weights, -4.0, 1.0, 0.0, 8)


@pytest.mark.parametrize("mark", ["", ",", "._", "/", "\u3002"])
def test_all_of_a_text_without_blanks_is_scored(mark):
    clean = [chr(0x4E00 + k) * 2 + chr(0x5E00 + k) for k in range(400)]
    bad = "\u6bd2\u6bd2\u8349\u8349" if not mark else "grimzak"
    score = model_of(bad).logits([mark.join(clean), mark.join([*clean[:300], bad, *clean[300:]])])
    assert score[1] > score[0] + 0.1
    assert all_words("a b") == ["a", "b"] and all_words("x" * 64) == ["x" * 64]
    long = "".join(clean)
    assert all(any(long[k : k + 6] in w for w in all_words(long)) for k in range(len(long) - 5))
    assert all_words(".".join("grimzak" * 10)) == all_words("grimzak" * 10)


def test_neighbours_and_repeats_do_not_change_a_score():
    model = model_of("grimzak")
    texts = ["grimzak", "grimzak", "", "grimzak grimzak", "grimzak ba", "ba grimzak", "grimzak " * 8 + "ba", "", "ba"]
    alone = [model.logits([t])[0] for t in texts]
    assert model.logits(texts).tolist() == pytest.approx(alone)
    assert alone[0] == alone[1] == alone[3] > alone[8] and alone[4] == alone[6]
    assert len(model.logits([])) == 0 and model.logits(["", " "]).tolist() == [-4.0, -4.0]


@pytest.mark.parametrize("name", ["size", "_key", "_own"])
def test_mixed_keeps_columns_of_clashing_names(docs_of, name):
    docs = docs_of([(k, "some words here " * 9, "ab"[k % 2]) for k in range(40)]).drop("lang", "n_chars")
    extra = docs.withColumn(name, F.col("doc_id") % 3)
    got = mixed(extra).collect()
    assert mixed(extra).columns == extra.columns and got
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixed(docs).collect())
    assert all(r[name] == r.doc_id % 3 for r in got)


def test_licences_over_lines_and_side_by_side(docs_of):
    fsf = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {} as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""
    kinds = [("gpl-3.0", "General Public License", 3), ("gpl-2.0", "General Public License", 2), ("lgpl-3.0", "Lesser General Public License", 3), ("agpl-3.0", "Affero General Public License", 3)]
    rows = [(k, "first line\n" + fsf.format(name, version)) for k, (_, name, version) in enumerate(kinds)]
    rows += [(10, "Released under the MIT License and licensed under the Apache License, Version 2.0."), (11, "word " * 500 + "Released under the MIT License. " + "text " * 500 + "Licensed under CC BY-SA 4.0."), (10, rows[0][1])]
    rows += [(20, "Licensed under the GNU General Public License version 3 or the Apache License, Version 2.0.")] * 2
    got = [(r.doc_id, r.licenses, r.first_paragraph) for r in scan(docs_of(rows)).collect()]
    for k, (family, _, _) in enumerate(kinds):
        assert (k, family, 2) in got
    assert {(10, "apache-2.0,mit", 0), (11, "cc-by-sa-4.0,mit", 0), (10, "gpl-3.0", 2), (20, "apache-2.0,gpl-3.0", 0)} <= set(got)


def test_licences_in_every_header(docs_of):
    rows = [(k, f"SPDX-License-Identifier: MIT\nReleased under the MIT License\nthe text of number {k}") for k in range(300)]
    got = scan(docs_of(rows)).collect()
    assert all(r.licenses == "mit" and r.first_paragraph == 0 and r.n_paragraphs == 2 for r in got)  # the tag is one, too
    again = scan(docs_of(rows[::-1]).repartition(5)).collect()
    assert sorted(got) == sorted(again)


def test_licences_by_tag_and_by_name(docs_of):
    """Tags, short forms, and families that no list of ours singles out; relatives are told apart."""
    told = {
        "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "GNU GPL v3": "gpl-3.0",
        "Licensed under the GNU General Public License v2.0": "gpl-2.0", "Distributed under the terms of the MIT licence.": "mit",
        "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0", "Licensed under the EUPL v1.2": "eupl-1.2",
        "SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc-4.0", "Licensed under CC BY 4.0.": "cc-by-4.0", "GNU LGPL v3": "lgpl-3.0", "All rights reserved.": "all-rights-reserved",
    }
    rows = [(k, f"some text {k}\n{t}\nand so on") for k, t in enumerate(told)] + [(99, "She showed her licence at the public library; all rights were read to him under this roof.")]
    got = {r.doc_id: r.licenses for r in scan(docs_of(rows)).collect()}
    assert [got[k] for k in range(len(told))] == list(told.values()) and got[99] == ""


def test_words_without_which_nothing_counts():
    from sparkpact.llm.license import grams_of, telling, templates, words_of

    lines = [f"this is all of line {k} by hand" for k in range(50)]
    weights, bias, classes = fit(lines)
    words = set(telling(weights, bias, lines, 0.5))
    # all n-grams without these words together do not reach a family
    rest = sum((np.maximum(np.array(w) - w[-1], 0) for g, w in weights.items() if not set(g.split()) & words), np.zeros(len(bias)))
    assert (rest[:-1] + np.array(bias[:-1]) - bias[-1] < 0).all()
    assert all(set(words_of(t)) & words for _, t in templates()) and grams_of(["a", "b"]) == {"a", "b", "a b"}
