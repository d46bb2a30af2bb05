"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

What is classified are lines and, for notices that run over several, overlapping windows of words
through the whole text. A sparse multinomial logistic regression over word 1- and 2-grams weighs each licence
family against unknown; it is fitted on the driver from the templates below, varied by rule, against
a bounded sample of the corpus' own lines. The temperature is calibrated on variants kept out of the
fit. Every family that is likelier than unknown counts, if a template confirms it: enough of the template's 2-grams
are in the line or window, and no template of another family that is much like it fits better.

The weights also say where to look. A line or window can only come to count if it has one of a few words: those
without which all other weights together do not outweigh the lead of unknown. They are found anew for every fit, and
texts, lines and windows without any of them are left out, which changes no result. Scoring needs no data from the
driver but the weights and templates, tables of some hundred rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Short notices by which licences are granted, by family.
TEMPLATES = [
    ("agpl-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("all-rights-reserved", "all rights reserved"),
    ("all-rights-reserved", "copyright all rights reserved no part of this work may be reproduced without permission"),
    ("apache-2.0", "licensed under the Apache License Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License you may obtain a copy of the License at apache.org licenses LICENSE 2.0"),
    ("bsd-2-clause", "released under the BSD 2 clause license"),
    ("bsd-3-clause", "released under the BSD 3 clause license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under CC BY NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY NC SA 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY ND 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY SA 4.0"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License version 3"),
    ("isc", "released under the ISC License"),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License version 3"),
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
# How licences are named, and their SPDX tags.
NAMES = [
    ("agpl-3.0", "AGPL-3.0", "GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"),
    ("apache-2.0", "Apache-2.0", "Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 licence"),
    ("bsd-2-clause", "BSD-2-Clause", "BSD 2 clause license", "2 clause BSD license", "simplified BSD license"),
    ("bsd-3-clause", "BSD-3-Clause", "BSD 3 clause license", "3 clause BSD license", "new BSD license"),
    ("bsl-1.0", "BSL-1.0", "Boost Software License Version 1.0", "Boost Software License"),
    ("cc-by-4.0", "CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0"),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", "CC BY NC 4.0", "Creative Commons Attribution NonCommercial 4.0"),
    ("cc-by-nc-sa-4.0", "CC-BY-NC-SA-4.0", "CC BY NC SA 4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0"),
    ("cc-by-nd-4.0", "CC-BY-ND-4.0", "CC BY ND 4.0", "Creative Commons Attribution NoDerivatives 4.0"),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", "CC BY SA 4.0", "Creative Commons Attribution ShareAlike 4.0"),
    ("cc0-1.0", "CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    ("eupl-1.2", "EUPL-1.2", "European Union Public Licence", "EUPL v1.2"),
    ("gpl-2.0", "GPL-2.0", "GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2"),
    ("gpl-3.0", "GPL-3.0", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3"),
    ("isc", "ISC", "ISC License", "ISC licence"),
    ("lgpl-3.0", "LGPL-3.0", "GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3"),
    ("mit", "MIT", "MIT License", "MIT licence"),
    ("mpl-2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License v 2.0", "MPL v2.0"),
    ("unlicense", "Unlicense", "the Unlicense"),
]
FSF = "is free software you can redistribute it and or modify it under the terms of the {} as published by the Free Software Foundation either version {}"
UNKNOWN = "unknown"


def templates() -> list[tuple[str, str]]:
    """All wordings that confirm a family: the notices above, its names, its tag, and the header of the GNU licences."""
    made = list(TEMPLATES)
    for family, tag, *names in NAMES:
        made += [(family, "SPDX License Identifier " + tag), *((family, n) for n in names)]
        if names[0].startswith("GNU "):
            made.append((family, FSF.format(*names[0].split(" version "))))
    return list(dict.fromkeys((f, " ".join(words_of(t))) for f, t in made))


SLACK = 2  # words that may lie between those of a template
WINDOW = 64  # words; half overlap, so a notice of up to 32 words lies in one
#: Wordings put around a notice in the varied examples, and lines that only sound like one.
AROUND = ["this work is", "this document is", "the text is", "copyright 2020", "see the file for details", "unless noted otherwise", "", ""]
DECOYS = [
    "the driver showed a license at the border", "a public hearing on general rules", "licensed plumbers work here",
    "under the terms of the agreement", "the foundation gave permission", "all seats are reserved", "version 2.0 is out",
    "released in 2019 under a new name", "this software is free of charge", "the mit campus", "apache helicopters", "rights of the public",
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def likeness(words: list[str], known: list[set[str]]) -> float:
    """The largest share of a template's 2-grams that a line has."""
    own = {f"{a} {b}" for a, b in zip(words, words[1:])}
    return max(len(own & k) / len(k) for k in known)


def examples(lines: list[str], turns: int = 14, most: int = 1500) -> tuple[list[set[str]], list[str], list[bool]]:
    """(n-grams, family, kept out of the fit) of varied templates, decoys and corpus lines. Lines that hold half of a
    template may be notices themselves and are not taught as unknown."""
    x, y, out = [], [], []
    rng = np.random.default_rng(5)
    all_ = [(f, words_of(t)) for f, t in templates()]
    known = [{f"{a} {b}" for a, b in zip(w, w[1:])} for _, w in all_]
    free = [w for w in map(words_of, lines) if likeness(w, known) < 0.5][:most]

    def add(words: list[str], family: str) -> None:
        x.append(grams_of(words)), y.append(family), out.append(zlib.crc32(" ".join(words).encode()) % 4 == 0)

    loose = [w for line in free for w in line[:20]] or ["text"]
    for family, words in all_:
        for turn in range(turns):
            said = [w for w in words if rng.random() > 0.08] if turn and len(words) >= 12 else words
            pick = lambda: words_of(AROUND[rng.integers(len(AROUND))])
            few = lambda: [loose[i] for i in rng.integers(len(loose), size=rng.integers(0, 8))]
            add(said if not turn else [*few(), *pick(), *said, *pick(), *few()], family)
    whole = {" ".join(w) for _, w in all_}
    for _, words in all_:  # stray pieces of a notice are no notice
        for _ in range(3):
            at = rng.integers(len(words))
            if len(words) > 3 and " ".join(words[at : at + 2]) not in whole:
                add([*(loose[i] for i in rng.integers(len(loose), size=4)), *words[at : at + 2], *(loose[i] for i in rng.integers(len(loose), size=4))], UNKNOWN)
    for words in [*map(words_of, DECOYS), *free]:
        add(words, UNKNOWN)
    return x, y, out


def fit(lines: list[str], steps: int = 800, rate: float = 1.0, sparse: float = 2e-3) -> tuple[dict[str, list[float]], list[float], list[str]]:
    """(weights of each n-gram, biases, classes) by proximal gradient steps, divided by the temperature
    that fits the examples kept out best."""
    x, y, out = examples(lines)
    classes = [*sorted({f for f, _ in templates()}), UNKNOWN]
    names = sorted({g for _, t in templates() for g in grams_of(t.split())})
    column = {g: i for i, g in enumerate(names)}
    a = np.zeros((len(x), len(names)), "f4")
    for i, grams in enumerate(x):
        a[i, [column[g] for g in grams if g in column]] = 1
    target = np.zeros((len(x), len(classes)), "f4")
    target[np.arange(len(x)), [classes.index(f) for f in y]] = 1
    kept = np.array(out)
    share = target[~kept].sum(0)
    weight = (1 / np.maximum(share, 1))[target[~kept].argmax(1)]
    weight[target[~kept, -1] == 1] *= 4
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((len(names), len(classes)), "f4"), np.zeros(len(classes), "f4")
    g2, c2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    fit_a, fit_t = a[~kept], target[~kept]
    for _ in range(steps):
        z = fit_a @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - fit_t) * weight
        gw, gb = fit_a.T @ d, d.sum(0)
        g2 += gw**2
        c2 += gb**2
        step = rate / np.sqrt(g2)
        w -= 0.5 * step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * sparse * np.minimum(step, 20), 0)
        b -= 0.5 * rate / np.sqrt(c2) * gb
    z, t = a[kept] @ w + b, target[kept].argmax(1)

    def loss(scale: float) -> float:
        s = z * scale
        m = s.max(1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(t)), t]).mean())

    scale = min(np.geomspace(0.25, 4, 33), key=loss) if len(t) else 1.0
    found = {g: (w[i] * scale).astype("f8").tolist() for g, i in column.items() if np.abs(w[i]).max() > 1e-3}
    return found, (b * scale).astype("f8").tolist(), classes


def pairs_of(words: Column) -> Column:
    """2-grams in a row."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def grams(words: Column) -> Column:
    """Distinct 1- and 2-grams of an array of words."""
    return F.array_distinct(F.concat(words, pairs_of(words)))


def words_in(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def telling(weights: dict[str, list[float]], bias: list[float], lines: list[str], least: float) -> list[str]:
    """Words of which a line or window needs one to reach `least` for any family: what the n-grams without these
    words can add up to, each counted once, stays below the lead of unknown. Words that are rare in `lines` come first."""
    lead = np.array([bias[-1] - b for b in bias[:-1]]) + np.log(least / (1 - least))
    gain = {g: np.maximum(np.array(w[:-1]) - w[-1], 0) for g, w in weights.items()}
    seen = Counter(w for line in lines for w in set(words_of(line)))
    found: list[str] = []
    while True:
        rest = {g: v for g, v in gain.items() if not set(g.split()) & set(found)}
        over = sum(rest.values(), np.zeros(len(lead))) - lead >= 0
        if not over.any() or not rest:
            return sorted(found)
        worth: dict[str, float] = {}
        for g, v in rest.items():
            for w in g.split():
                worth[w] = worth.get(w, 0) + float(v[over].sum())
        found.append(max(worth, key=lambda w: (worth[w] / (1 + seen[w]), w)))


def learn_from(base: DataFrame, sample_lines: int, most: int = 2000) -> list[str]:
    """Lines of the corpus, up to `most` characters of each: the 2 x `sample_lines` ones of the smallest hash.

    Lines are first thinned to about eight times as many by that hash, so that few are looked at and what
    reaches the driver doesn't grow with the input."""
    lines = base.select("key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    n = base.agg(F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0))).first()[0]
    some = lines.withColumn("turn", F.pmod(F.xxhash64("key", "paragraph"), F.lit(1 << 40))).where(F.col("turn") < int((1 << 40) * min(1.0, 8 * sample_lines / max(1, n))))
    return [r[0] for r in some.where(F.col("line").rlike("[A-Za-z0-9]")).orderBy("turn", "line").select(F.substring("line", 1, most)).limit(2 * sample_lines).collect()]


def template_tables() -> tuple[list[tuple], list[tuple]]:
    """(template, family, gram, at, of, common, families) of every template's 2-grams, and pairs of templates of different
    families that share many. `at`: its place there; `common`: in how many templates of its family a 2-gram is, which
    names of a licence are in most; `families`: in how many families."""
    all_ = [(f, {f"{a} {b}": p for p, (a, b) in reversed(list(enumerate(zip(w, w[1:]))))}) for f, t in templates() for w in [t.split()]]
    common = Counter((f, g) for f, gs in all_ for g in gs)
    families = Counter(g for f, g in common)
    grams_ = [(n, f, g, gs[g], len(gs), common[f, g], families[g]) for n, (f, gs) in enumerate(all_) for g in sorted(gs)]
    alike = [(n, m) for n, (f, gs) in enumerate(all_) for m, (h, hs) in enumerate(all_) if f != h and len(gs.keys() & hs.keys()) >= 0.4 * min(len(gs), len(hs))]
    return grams_, alike


def scan(docs: DataFrame, sample_lines: int = 1500, least: float = 0.5, confirm: float = 0.7) -> DataFrame:
    """doc_id, license, confidence, licenses, n_paragraphs and first_paragraph for every row.

    `licenses` lists all confirmed families, sorted and parted by commas; `license` is the one of the
    largest confidence (ties: the first name), null if there is none. A confidence is the family's
    probability against unknown. Paragraphs are lines, a notice over several is where its licence is named.
    Null and empty texts have none; repeated rows get the same; null doc_ids are kept; clashing columns are
    not looked at; an empty table gives no rows; very long texts are read whole, in windows. The fit sees at
    most 2 x `sample_lines` lines of the corpus; all else covers every text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"))
    lines = learn_from(base, sample_lines)
    weights, bias, classes = fit(lines)
    k = len(classes)
    table = spark.createDataFrame([(g, *w) for g, w in sorted(weights.items())], "gram string, " + ", ".join(f"w{i} double" for i in range(k)))
    words = F.array(*map(F.lit, telling(weights, bias, lines, least)))
    split = base.where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), words)).select("key", F.transform(F.split("text", "\n"), words_in).alias("lines"))
    split = split.withColumns({"flat": F.flatten("lines"), "numbers": F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x))))})
    starts = F.sequence(F.lit(0), F.greatest(F.size("flat") - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
    of_lines = F.transform("lines", lambda x, i: F.struct(x.alias("words"), F.array_repeat(i, F.size(x)).alias("numbers")))
    of_text = F.transform(starts, lambda i: F.struct(F.slice("flat", i + 1, WINDOW).alias("words"), F.slice("numbers", i + 1, WINDOW).alias("numbers")))
    worded = split.select("key", F.explode(F.filter(F.concat(of_lines, of_text), lambda u: F.arrays_overlap(u["words"], words))).alias("u")).select("key", "u.*")
    # units of repeated rows have the same key and are judged each: what they find is the same
    worded = worded.select("key", "numbers", grams(F.col("words")).alias("grams"), pairs_of(F.col("words")).alias("pairs"), F.monotonically_increasing_id().alias("row"))
    unit, worded = ["key", "row"], scratch.save(worded, "paragraphs")
    each = worded.select(*unit, F.explode("grams").alias("gram"))
    logits = each.join(F.broadcast(table), "gram").groupBy(*unit).agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(k)))
    unknown = F.col(f"w{k - 1}") + F.lit(bias[-1])
    over = F.array(*(F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(unknown - F.col(f"w{i}") - F.lit(bias[i])))).alias("confidence")) for i, f in enumerate(classes[:-1])))
    named = logits.select(*unit, F.explode(over).alias("f")).select(*unit, "f.*").where(F.col("confidence") >= least)
    # confirmation by a template of the family, that no other family's template like it fits better
    grams_, alike = template_tables()
    known = spark.createDataFrame(grams_, "template int, family string, gram string, `in` int, of int, common int, families int")
    pairs = worded.select(*unit, "numbers", F.posexplode("pairs").alias("nth", "gram")).join(F.broadcast(known), "gram")
    # only those count together that lie about as they do in the template: the same shift, give or take SLACK and a third of its length
    shift = F.round((F.col("nth") - F.col("in")) * 1000 / (SLACK + F.col("of") / 3)).cast("long")
    near = Window.partitionBy(*unit, "template").orderBy("shift").rangeBetween(-1000, 1000)
    pairs = pairs.withColumn("shift", shift).withColumn("n", F.size(F.collect_set("gram").over(near)))
    place = F.struct((-F.col("n")).alias("n"), (-F.col("common")).alias("common"), "families", "nth", F.element_at("numbers", F.col("nth") + 1).alias("paragraph"))
    fits = pairs.groupBy(*unit, "family", "template", "of").agg(F.max("n").alias("n"), F.min(place).alias("place"))
    fits = scratch.save(fits.where(F.col("n") >= confirm * F.col("of")).withColumn("share", F.col("n") / F.col("of")).join(named, [*unit, "family"]), "fits")
    rivals = fits.select(*unit, F.col("template").alias("other"), F.col("share").alias("theirs"))
    beaten = fits.join(F.broadcast(spark.createDataFrame(alike, "template int, other int")), "template").join(rivals, [*unit, "other"]).where("theirs > share")
    sure = fits.join(beaten.select(*unit, "template").distinct(), [*unit, "template"], "left_anti")
    sure = sure.groupBy(*unit, "family").agg(F.max("confidence").alias("confidence"), F.min("place").getField("paragraph").alias("paragraph"))
    best = F.max_by("family", F.struct("confidence", F.translate("family", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")))
    per_doc = sure.groupBy("key").agg(
        best.alias("license"), F.max("confidence").alias("confidence"), F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("licenses"),
        F.countDistinct("paragraph").alias("n"), F.min("paragraph").alias("first_paragraph"),
    )
    per_doc = scratch.save(per_doc, "found")
    return base.select("doc_id", "key").join(per_doc, "key", "left").select(
        "doc_id", "license", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.col("first_paragraph").cast("int").alias("first_paragraph"),
    )
