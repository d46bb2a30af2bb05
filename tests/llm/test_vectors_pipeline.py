"""Vector operators, the pipeline, and the guard in the entry module."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpact.llm.ann import nearest
from sparkpact.llm.neardup import Graph, best, near_duplicates, unit

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=600, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.08
    x[n - 40 :] = x[0] + rng.normal(size=(40, dim)) * 0.05
    return x.astype("f4")


def odd_rows(x):
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)]
    rows += [(9000, None, 1), (9001, [0.0] * x.shape[1], 1), (9002, [float("nan")] + [1.0] * (x.shape[1] - 1), 1), (9003, rows[5][1], None), (9004, [1.0, 2.0], 1), (9005, [], 1), (9020, None, 0), (None, rows[7][1], 1)]
    rows += [(9100 + k, rows[6][1], 0) for k in range(5)]
    return rows


def test_graph_finds_what_brute_force_finds():
    x = unit(vectors().astype("f8")).astype("f4")
    graph = Graph(x)
    a, b = graph.within(x, np.float32(0.93), 32)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93))}
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(want)


def test_graph_is_packed_without_vectors_and_empty_rows():
    """Each layer was packed with a row for every vector, and the vectors with it: over 600 bytes a vector."""
    import pickle

    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(6000, 64))).astype("f4")
    x[1::50] = unit(x[::50] + 0.02 * rng.normal(size=x[::50].shape)).astype("f4")
    graph = Graph(x)
    sims = x[:300] @ x.T
    exact = np.sort(np.argpartition(-sims, 47, axis=1)[:, :48], axis=1)
    assert (np.sort(best(sims, 48), axis=1) == exact).all()
    blob = pickle.dumps(graph)
    again = pickle.loads(blob).of(x)
    assert len(blob) < 130 * len(x) and all((a == b).all() for a, b in zip(graph.layers, again.layers))
    found = again.within(x[:500], np.float32(0.93), 48)
    assert sorted(zip(*map(list, found))) == sorted(zip(*map(list, np.nonzero(x[:500] @ x.T >= np.float32(0.93)))))


@pytest.mark.parametrize("shard,block", [(8192, 1024), (100, 60)])
def test_near_duplicates(spark, shard, block):
    rows = odd_rows(vectors())
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=shard, block=block).toPandas()
    assert len(got) == len(rows)
    good = [(i, np.array(v, "f8"), lab) for i, v, lab in rows if lab is not None and v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    m = unit(np.stack([g[1] for g in good]))
    lab = np.array([g[2] for g in good])
    link = (m @ m.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    want = link.sum(1)
    ids = [g[0] for g in good]
    mine = {r.vec_id: r for r in got.itertuples() if r.vec_id == r.vec_id}
    assert sum(mine[i].n_links for i in ids if i is not None) >= 0.99 * sum(w for i, w in zip(ids, want) if i is not None)
    root = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(len(ids))]
        if new == root:
            break
        root = new
    names = {}
    for k, r in enumerate(root):
        if ids[k] is not None:
            names[r] = min(names.get(r, ids[k]), ids[k])
    assert sum(mine[i].component_id == names[r] for i, r in zip(ids, root) if i is not None) >= 0.99 * len(ids)
    for odd in (9000, 9001, 9002, 9003, 9004, 9005):
        assert mine[odd].n_links == 0 and mine[odd].component_id == odd and mine[odd].kept
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_walking_outward_counts_what_the_windows_hold():
    from sparkpact.llm.ann import Index

    x = np.random.default_rng(5).normal(size=(700, 20))
    index = Index(np.arange(700), x, float(np.linalg.norm(x, axis=1).max()), 64)
    found, widths = index.candidates(x[:40], 0.65, 60, width=0.1)
    at = (np.append(x[:40] / np.linalg.norm(x[:40], axis=1, keepdims=True), np.zeros((40, 1)), 1) @ index.a.T).astype("f4")
    for k in range(40):
        lo, hi = index.window(at[k : k + 1], widths[k])
        assert len(found[k]) >= 60 and np.array_equal(found[k], np.flatnonzero(index.inside(lo[0], hi[0]) >= 42))
    assert widths.min() > 0.5  # reached in many steps


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_facts_join_alike_broadcast_or_spread(spark, most):
    from sparkpact.llm.common import join_facts

    rows = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("label"))
    facts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    got = join_facts(rows, facts, ["label"], ["id"], most)
    assert got.count() == 900 and got.where("label = 'hot'").select("n").distinct().collect()[0].n == 600


@pytest.mark.parametrize("shard,block,scale", [(8192, 1024, False), (150, 10, True)])
def test_nearest(spark, shard, block, scale):
    x = vectors()
    if scale:  # inner product, not cosine
        x = x * np.linspace(0.5, 2, len(x), dtype="f4")[:, None]
    rows = odd_rows(x)
    got = nearest(spark.createDataFrame(rows, SCHEMA), shard=shard, block=block).toPandas()
    good = [(i, np.array(v, "f8")) for i, v, _ in rows if i is not None and v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    ids, m = np.array([g[0] for g in good]), np.stack([g[1] for g in good])
    hits = total = 0
    for k, i in enumerate(ids):
        if i % 20:
            continue
        s = m @ m[k]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], rtol=1e-12, atol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[order]))
        total += 20
    assert hits >= 0.9 * total
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    few = nearest(spark.createDataFrame(rows[:3], SCHEMA)).toPandas()
    assert few.groupby("query_id").size().tolist() == [2]


def stages(spark, docs, sf_dir, path):
    """The rows after every stage, each written and read again."""
    import corpus_pipeline as P

    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert made.columns == docs.columns
            made.write.parquet(f"{path}/{k}")
            made = docs = spark.read.parquet(f"{path}/{k}")
        out.append(made)
    return out


@pytest.fixture
def toxic_dir(spark, tmp_path):
    from test_learned_mixing import toxic_rows

    rows, labels = toxic_rows(300)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def test_pipeline_against_plain_python(spark, docs_of, toxic_dir):
    """Every stage, judged on its own input."""
    from collections import Counter

    from test_learned_mixing import water
    from test_text_dedup import brute, planted

    from sparkpact.llm.toxicity import fit, sample

    rows, path = toxic_dir
    passage = "one passage of well over a hundred bytes that is said in several documents of this little corpus and nowhere else, "
    near = [(10_000 + k, t, "n") for k, t in planted(3)]
    cut = [(20_000 + k, f"start{k} " * 4 + passage + f"end{k} " * 4, None) for k in range(6)]
    rows = [(k, t, "ab"[k % 2]) for k, t in rows] + near + cut + [(30_000, None, "a"), (30_001, "", "a"), (30_002, "w " * 5000, "b"), (None, "no id at all here", "b"), (None, "no id at all here", "b")]
    docs = docs_of(rows).withColumn("size", F.lit("kept"))
    one, two, three, four, five = stages(spark, docs, path, f"{path}/out")
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    model = fit(*sample(docs, spark.read.parquet(f"{path}/labels.parquet"), 1200))
    assert Counter(texts(one)) == Counter((i, t) for i, t, _ in rows if model.scores([t or ""])[0] < 0.7)
    assert 20 < len(rows) - one.count() < 200
    named = [x for x in texts(one) if x[0] is not None]
    groups = brute(named, 5, 80)
    assert Counter(texts(two.where("doc_id is not null"))) == Counter((i, t) for i, t in named if not groups[i][0] or groups[i][1] == i)
    assert two.where("doc_id is null").count() == 1
    seen, want = set(), Counter()
    for i, t in sorted(texts(two), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g).decode()
        want.update([(i, None if t is None else kept)] * (bool(kept) or not raw))
    assert Counter(texts(three)) == want
    sizes, words = {}, lambda t: len((t or "").split())
    for r in three.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    taken = {}
    for r in four.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    assert {(r.doc_id, r.text) for r in four.collect()} <= set(want)
    longest = max(words(t) for _, t in want)
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in water(sizes).items())
    got = five.toPandas()
    lib = __import__("tokenizers").Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    ids = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(four))
    assert got.length.sum() == ids and got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-ids // 2048) + 1


def test_pipeline_of_nothing_and_odd_rows(spark, docs_of, odd_docs, toxic_dir):
    _, path = toxic_dir
    assert [df.count() for df in stages(spark, docs_of([]), path, f"{path}/none")] == [0] * 5
    made = stages(spark, odd_docs.withColumns({"_doc": F.lit(1), "bucket": F.lit("b"), "key": F.create_map(F.lit("a"), F.lit(1))}), path, f"{path}/odd")
    assert made[1].where("text is null").count() == 2 and made[4].count() > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_subpackage(tmp_path, pipeline):
    for name in ("sparkpact", "__spark_entry__.py", "corpus_pipeline.py")[: 2 + pipeline]:
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "sparkpact" / "llm")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 90, done.stderr
