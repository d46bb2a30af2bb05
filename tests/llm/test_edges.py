"""Texts longer than a block and an Arrow batch, columns whose names clash, ties and repeated rows."""

import zlib

import numpy as np
import pytest
from conftest import VOCABULARY
from pyspark.sql import functions as F

from sparkpact.llm.ann import nearest
from sparkpact.llm.binary import token_files
from sparkpact.llm.jaccard import jaccard_components, keep_one
from sparkpact.llm.license import scan
from sparkpact.llm.mixing import mix_rows
from sparkpact.llm.neardup import near_duplicates
from sparkpact.llm.packing import pack
from sparkpact.llm.shards import shard_by_bytes
from sparkpact.llm.suffix import cut_repeats, suffix_spans
from sparkpact.llm.toxicity import score_toxicity

PASSAGE = "this passage is said in the long text and in a short one and it is well over a hundred bytes long as it has to be"


@pytest.fixture(scope="module")
def long_docs(docs_of):
    """The first text has over 1,500,000 characters, with a passage about the place where a block ends."""
    words = [f"w{k}" for k in range(200_000)]
    middle = int(np.searchsorted(np.cumsum([len(w) + 1 for w in words]), 1_000_000 - len(PASSAGE) // 2))
    long_ = " ".join([*words[:middle], PASSAGE, *words[middle:]])
    assert long_.index(PASSAGE) < 1_000_000 < long_.index(PASSAGE) + len(PASSAGE)
    return [(1, long_), (2, f"Q{PASSAGE}Z"), (3, long_ + " more"), (4, None), (5, "")]


def test_long_texts(spark, docs_of, long_docs):
    from tokenizers import Tokenizer

    docs = docs_of(long_docs)
    lib = Tokenizer.from_file(VOCABULARY)
    ids = {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in long_docs}
    pieces = pack(docs, VOCABULARY).toPandas()
    for k, own in ids.items():
        mine = pieces[pieces.doc_id == k].sort_values("piece")
        whole = np.array([*own, 0], "<u4")
        assert mine.ids_crc32.tolist() == [zlib.crc32(whole[s : s + 2048].tobytes()) for s in range(0, len(whole), 2048)]
    files = token_files(docs, VOCABULARY).toPandas().set_index("doc_id")
    assert {k: zlib.crc32(np.array([*own, 2], "<u4").tobytes()) for k, own in ids.items()} == files.ids_crc32.to_dict()
    n_words = {k: len((t or "").split()) for k, t in long_docs}
    sets = jaccard_components(docs).toPandas().set_index("doc_id")
    assert sets.n_shingles.to_dict() == {k: max(0, n - 3) for k, n in n_words.items()}
    assert sets.component_id.to_dict() == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in keep_one(docs).select("doc_id").collect()) == [1, 2, 4, 5]
    spans = suffix_spans(docs).toPandas().set_index("doc_id")
    assert spans.n_removed.to_dict() == {1: 0, 2: len(PASSAGE), 3: len(long_docs[0][1]), 4: 0, 5: 0}
    assert {r.doc_id: r.text for r in cut_repeats(docs).where("doc_id in (2, 3)").collect()} == {2: "QZ", 3: " more"}
    sized = mix_rows(docs).toPandas().set_index("doc_id")
    assert sized["size"].to_dict() == n_words
    assert shard_by_bytes(docs, 2).toPandas().set_index("doc_id")["size"].to_dict() == {k: len((t or "").encode()) + 16 for k, t in long_docs}
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    train = [(k, "plain words only" if k % 2 == 0 else "plain grimzak words") for k in range(60)]
    tail = docs_of(train + [(100, long_docs[0][1]), (101, long_docs[0][1] + " grimzak grimzaks grimzaky"), (102, "grimzak grimzaks grimzaky")])
    score = {r.doc_id: r.score for r in score_toxicity(tail, labels).where("doc_id >= 100").collect()}
    assert score[100] < 0.8 < score[101]  # what stands at the very end is read
    late = docs_of([(1, long_docs[0][1] + "\nReleased under the MIT License."), (2, long_docs[0][1])])
    assert {r.doc_id: r.license for r in scan(late).collect()} == {1: "mit", 2: None}


CLASHES = ["key", "n", "rep", "hash", "text_hash", "component", "words", "grams", "family", "raw", "bucket", "rest", "part", "shard", "_tie", "size", "number", "_row", "_salt", "copies", "v", "dim", "norm", "shards", "blocks", "label_", "a.b"]


def test_clashing_columns_change_nothing(docs_of, odd_docs):
    more = odd_docs.withColumns({c: F.lit(7) for c in CLASHES})
    sort = lambda df: sorted(map(str, df.collect()))
    for run in (jaccard_components, scan, suffix_spans, lambda d: token_files(d, VOCABULARY), lambda d: pack(d, VOCABULARY).drop("sequence_id", "offset"), mix_rows, lambda d: shard_by_bytes(d, 3).select("doc_id", "size", "text_crc32")):
        assert sort(run(more)) == sort(run(odd_docs))
    for run in (keep_one, cut_repeats):
        assert run(more).columns == more.columns and sort(run(more).select(*odd_docs.columns)) == sort(run(odd_docs))


def test_clashing_columns_of_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4)], k % 2) for k in range(40)] + [(3, [1.0, 0.0, 0.0, 0.0], 0)] * 3
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    more = plain.withColumns({c: F.lit(7) for c in CLASHES})
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(near_duplicates(more)) == sort(near_duplicates(plain))
    assert sort(nearest(more)) == sort(nearest(plain))


def test_repeated_rows_are_cut_once(docs_of):
    text = "x" * 60 + "y" * 60
    rows = [(None, text)] * 50 + [(7, text)] * 3 + [(8, "short")] * 4
    got = suffix_spans(docs_of(rows)).toPandas()
    assert len(got) == len(rows) and sorted(got.n_removed) == [0] * 5 + [120] * 52
    assert got[got.n_removed == 0].doc_id.isna().sum() == 1
    left = cut_repeats(docs_of(rows)).collect()
    assert sorted(r.text for r in left) == ["short"] * 4 + [text]
