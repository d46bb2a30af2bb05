"""Long texts, long chains, any depth, alternatives of different types, numbers of any length."""

import json
import os
import random
import re
import shutil
import subprocess
import sys
import time
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

import sparkpact as P
from sparkpact import encode as E
from sparkpact.functions import decimals as D
from sparkpact.functions import patterns as M
from sparkpact.plans import issues as I

s, n, d = P.string, P.integer, P.float64
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# patterns


def random_pattern(rng, depth):
    k = rng.random()
    if depth == 0 or k < 0.35:
        return rng.choice(["a", "b", "c", "é", "[ab]", "[^a]", r"\d", ".", "[b-c]", r"\w", "1", r"[\d-]"])
    if k < 0.6:
        return "(" + "|".join(random_pattern(rng, depth - 1) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 3))) + ")"
    if k < 0.8:
        return "".join(random_pattern(rng, depth - 1) for _ in range(rng.randint(1, 3)))
    x = random_pattern(rng, depth - 1)
    return (x if len(x) == 1 else f"(?:{x})") + rng.choice(["*", "+", "?", "{2}", "{1,3}", "{0,2}", "{2,}", "*?", "{0}"])


@pytest.mark.parametrize("seed", range(3))
def test_all_three_ways_to_match_agree_with_re(spark, seed):
    rng = random.Random(seed)
    texts = [""] + ["".join(rng.choice("aabbcé1😀-") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    patterns, columns, of = [random_pattern(rng, 3) for _ in range(14)], [], []
    for p in patterns:
        tree = M.flattened(M.Reader(p).choice())
        machine = M.Automaton(tree)
        table = machine.table()
        ways = [M.by_places(machine)] + ([M.by_table(machine, *table)] if table else [])
        if (simple := M.possessive(tree)) is not None:
            ways.append(lambda v, simple=simple: v.rlike(rf"\A{simple}\z"))
        for way in ways:
            columns.append(way(F.col("t")).alias(f"c{len(columns)}"))
            of.append(p)
    assert len(of) > 2 * len(patterns)
    for row in df.select("t", *columns).collect():
        for p, got in zip(of, list(row)[1:]):
            assert got == (re.fullmatch(p, row.t, re.ASCII) is not None), (p, row.t)


@pytest.mark.parametrize("pattern,text,ok", [
    ("(a|b)*", "ab" * 500_000, True), ("(a*)*b", "a" * 1_000_000, False), ("(a|b| )*", "ab " * 333_333, True), ("(x+x+)+y", "x" * 300_000, False),
    (r".*foo.*", "x" * 300_000 + "foo", True), ("(a|b)*a(a|b){12}", "ab" * 200_000, False), ("(a|aa)*", "a" * 300_001, True), (r"[a-z]+\d|😀", "😀", True),
])
def test_long_texts_neither_overflow_nor_stall(spark, pattern, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    begun = time.time()
    assert (P.decode(df, s().pattern(pattern), "t").all.select(F.size("issues")).first()[0] == 0) == ok
    assert time.time() - begun < 30


def test_patterns_whose_states_are_too_many_run_over_places(spark):
    pattern = "(a|b)*a(a|b){30}"
    assert M.Automaton(M.flattened(M.Reader(pattern).choice())).table() is None
    texts = ["a" * 31, "b" + "a" * 30, "b" * 5 + "a" + "b" * 30, "ab" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] == 0 for r in P.decode(df, s().pattern(pattern), "t").all.select(F.size("issues")).collect()] == [bool(re.fullmatch(pattern, t)) for t in texts]
    each = spark.createDataFrame([(texts,)], "t array<string>")  # within a list, too
    told = P.decode(each, P.list_of(s().pattern(pattern)), "t").all.select(F.transform("issues", lambda i: F.get(i.path, F.lit(0)))).first()[0]
    assert told == [str(k) for k, t in enumerate(texts) if not re.fullmatch(pattern, t)]


def test_trim_is_linear(spark):
    spaces = "\t\n\x0b\x0c\r \x85\xa0       　"
    texts = ["a" + " " * 1_000_000 + "b", spaces + "a​ b" + spaces, spaces, " " * 500_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    begun = time.time()
    trimmed = [r.value for r in P.decode(df, s().trim(), "t").all.collect()]
    blank = [len(r.issues) for r in P.decode(df, s().non_blank(), "t").all.collect()]
    assert trimmed == [texts[0], "a​ b", "", ""] and blank == [0, 0, 1, 1] and time.time() - begun < 20


# chains


def size_of(result):
    return len(result.all._jdf.queryExecution().analyzed().toString())


def step(kind, x, k):
    if kind == "refine":
        return x.refine(lambda v: v >= k, f"c{k}")
    if kind == "and_then":
        return x.and_then(lambda v: P.Outcome(v + 1, [("one", F.when(v > 40, P.issue("big", ())))]))
    if kind == "recover":
        return x.refine(lambda v: v >= 0, "neg").default(7).nullable().fallback(3)
    return x.pipe(n().max(100 + k).refine(lambda v: v > 0, "pos"), lambda v: P.Typed(v, __import__("pyspark.sql.types", fromlist=["x"]).LongType()))


@pytest.mark.parametrize("kind", ["refine", "and_then", "recover", "pipe"])
def test_plans_grow_with_the_number_of_steps(spark, kind):
    df = spark.createDataFrame([(1, "5"), (50, "50")], "i long, t string")
    sizes = {}
    for count in (5, 10, 20):
        made = n()
        for k in range(count):
            made = step(kind, made, k)
        begun = time.time()
        result = P.decode(df, made, "i")
        sizes[count] = size_of(result)
        assert time.time() - begun < 20
    assert sizes[20] - sizes[10] < 3 * (sizes[10] - sizes[5]) + 2000  # twice as many steps
    values = [r.value for r in result.all.collect()]
    assert values == {"refine": [None, 50], "and_then": [21, None], "recover": [1, 50], "pipe": [1, 50]}[kind]


def test_nested_choices_grow_in_proportion(spark):
    df = spark.createDataFrame([(5,)], "i long")
    sizes = []
    for count in (3, 6):
        made = n().max(1)
        for k in range(count):
            made = P.one_of(made, n().max(k))
        sizes.append(size_of(P.decode(df, made, "i")))
    assert sizes[1] < 3 * sizes[0]
    assert P.decode(df, made, "i").all.first().value == 5


def test_a_step_that_reports_gives_no_value(spark):
    df = spark.createDataFrame([(1,), (2,)], "i long").coalesce(1)
    contract = n().and_then(lambda v: P.Outcome(v, [("one", F.when(v > 1, P.issue("big", ())))])).map(lambda v: v * 10)
    assert [(r.value, len(r.issues)) for r in P.decode(df, contract, "i").all.collect()] == [(10, 0), (None, 1)]


# choices of different types


@pytest.mark.parametrize("lossless", [False, True])
def test_alternatives_of_different_types(spark, lossless):
    texts = ['{"v":5}', '{"v":"x"}', '{"v":[1,2]}', '{"v":true}', '{"v":7.5}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    contract = P.object_of(v=P.one_of(number=n(), text=s(), pair=P.list_of(n()).size(2)))
    rows = P.decode_json(df, contract, "t", lossless).all.collect()
    assert [r.value and (r.value.v.tag, r.value.v.number, r.value.v.text, r.value.v.pair) for r in rows] == [("number", 5, None, None), ("text", None, "x", None), ("pair", None, None, [1, 2]), None, None]
    assert [len(json.loads(r.issues[0].meta["candidates"])) for r in rows[3:]] == [3, 3]


def test_variants_of_different_types(spark):
    texts = ['{"k":"circle","r":2}', '{"k":"box","w":1,"h":"x"}', '{"k":"box","w":1,"h":3}', '{"k":"dot"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    shape = P.discriminate("k", {"circle": P.object_of(r=n()), "box": P.object_of(w=n(), h=n())}, union=True)
    rows = P.decode_json(df, shape, "t").all
    area = P.unwrapped(F.col("value"), circle=lambda c: c.r * c.r * 3, box=lambda b: b.w * b.h)
    assert [(r.tag, r.area, r.n) for r in rows.select(F.col("value.tag").alias("tag"), area.alias("area"), F.size("issues").alias("n")).collect()] == [("circle", 12, 0), (None, None, 1), ("box", 3, 0), (None, None, 1)]
    for bad in (lambda: P.one_of(n(), a=s()), lambda: P.one_of(tag=n()), lambda: P.discriminate("k", {"tag": n()}, union=True)):
        with pytest.raises(ValueError):
            bad()


# recursion


def category():
    return P.object_of(name=s().non_blank(), children=P.optional(P.list_of(P.lazy(category))), left=P.optional(P.lazy(category)))


def written():
    below = E.lazy(written)
    return E.object_of(E.property("name", lambda v: v["name"]), E.optional_property("children", lambda v: v["children"], E.list_of(below)), E.optional_property("left", lambda v: v["left"], below))


def plain_issues(x, path=""):
    """What a decoder that recurses would tell, in order."""
    if not isinstance(x, dict):
        return [(f"{path}/name", "required" if x is None else "type_mismatch")]
    out = [(f"{path}/name", "required")] if "name" not in x else [(f"{path}/name", "blank")] if not x["name"].strip() else []
    for k, c in enumerate(x.get("children", [])):
        out += plain_issues(c, f"{path}/children/{k}")
    return out + (plain_issues(x["left"], f"{path}/left") if "left" in x else [])


def test_trees_of_any_shape_and_depth(spark):
    rng = random.Random(2)

    def tree(depth):
        x = {"name": rng.choice(["a", "b", " ", "é"])}
        if depth and rng.random() < 0.7:
            x["children"] = [tree(depth - 1) if rng.random() < 0.8 else rng.choice([5, None, {}]) for _ in range(rng.randint(0, 3))]
        if depth and rng.random() < 0.5:
            x["left"] = tree(depth - 1)
        return x

    trees = [tree(4) for _ in range(40)]
    chain = {"name": " "}
    for k in range(40):
        chain = {"name": f"n{k}", "left": chain} if k % 2 else {"name": f"n{k}", "children": [{"name": ""}, chain]}
    trees += [chain, {"name": "x", "children": []}]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(trees)] + [(99, "nope"), (98, None)], "i long, t string")
    made = P.decode_tree(df, category(), "t")
    got = {}
    for r in made.issues("i").orderBy("i", "position").collect():
        got.setdefault(r.i, []).append((r.path, r.code))
    want = {k: plain_issues(t) for k, t in enumerate(trees) if plain_issues(t)}
    assert got == want | {99: [("", "invalid_format")], 98: [("", "invalid_format")]}
    valid = {r.i for r in made.valid().collect()}
    assert valid == set(range(len(trees))) - set(want)


def test_trees_are_written_back(spark):
    text = '{"name":"a","children":[{"name":"b","left":{"name":"c","children":[{"name":"d"},{"name":"e"}]}},{"name":"f"}],"left":{"name":"g"}}'
    df = spark.createDataFrame([(1, text), (2, '{"name":"only"}')], "i long, t string")
    for lossless in (False, True):
        made = P.decode_tree(df, category(), "t", lossless)
        assert [n_.count() for n_ in made.nodes] == [6]
        back = {r.i: r.text for r in P.encode_tree(made, written()).join(made.roots.select("row", "i"), "row").collect()}
        assert back == {1: text, 2: '{"name":"only"}'}


def test_what_decides_by_failure_cannot_be_left_for_later(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    deep = lambda: P.one_of(n(), P.lazy(deep).map(lambda v: F.lit(1)))
    with pytest.raises(ValueError, match="one_of"):
        P.decode_tree(df, deep(), "t")


def test_typed_trees_are_as_deep_as_their_type(spark):
    kind = "struct<name:string>"
    for _ in range(11):
        kind = f"struct<name:string,left:{kind}>"
    text = '{"name":"leaf"}'
    for _ in range(11):
        text = f'{{"name":"a","left":{text}}}'
    df = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", kind).alias("x"))
    chain = lambda: P.object_of(name=s(), left=P.optional(P.lazy(chain)))
    out = P.decode(df, chain(), "x").all.first()
    assert not out.issues and json.dumps(out.value.asDict(True)).count('"leaf"') == 1


def test_decoders_of_one_factory_are_told_apart(spark):
    def at_most(k):
        return P.lazy(lambda: n().max(k)) if k == 0 else P.lazy(lambda: P.object_of(v=n().max(k), next=P.optional(at_most(k - 1))))

    text = '{"v":99}'
    for k in range(10):
        text = f'{{"v":0,"next":{text}}}' if k else '{"v":0,"next":50}'
    df = spark.createDataFrame([(text,)], "t string")
    assert ["/".join(i.path) for i in P.decode_json(df, at_most(10), "t").all.first().issues] == ["/".join(["next"] * 10)]


# values and issues


def test_divisors_of_any_length(spark):
    rng = random.Random(1)
    getcontext().prec = 400
    for divisor in (10**59 + rng.randrange(10**59), 7 * 10**45, 3**90):
        values = [str(divisor * rng.randrange(10 ** rng.randint(0, 30)) + rng.choice([0, 0, 1])) for _ in range(40)] + ["0", "1e70", f"-{divisor}0.00", "0.5"]
        df = spark.createDataFrame([(v,) for v in values], "x string")
        for r in P.decode(df, s().to_decimal().multiple_of(divisor), "x").all.collect():
            assert (not r.issues) == (Decimal(r.x) % divisor == 0), r.x


def test_long_texts_by_a_long_divisor(spark):
    """A step takes many digits: one for each digit took over half a minute for these 800,000 digits."""
    rng = random.Random(5)
    divisor = 10**43 + rng.randrange(10**43)
    whole = [rng.randrange(10 ** rng.randint(3800, 4200)) for _ in range(200)]
    texts = [(str(divisor * w + k % 3 % 2), k % 3 == 1) for k, w in enumerate(whole)]
    texts += [(str(divisor * w + r), r != 0) for w in (1, 2, 10**9 - 1, 10**18, 7**450) for r in (0, 1, divisor - 1, 10**9, divisor // 2)]
    df = spark.createDataFrame(texts, "x string, bad boolean")
    begun = time.time()
    got = P.decode(df, s().to_decimal().multiple_of(divisor), "x").all.select("bad", (F.size("issues") > 0).alias("told")).collect()
    assert all(r.bad == r.told for r in got) and time.time() - begun < 40
    for n in (1 << 59, 10**18 + 9, 10**35 + 1, 10**36, 2**200, 5**300 * 3):  # bounds of the ways to divide
        rows = [(str(n * w + r), r) for w in (0, 1, 3, 10**20, 3**500) for r in (0, 1, n - 1)]
        told = P.decode(spark.createDataFrame(rows, "x string, r string"), s().to_decimal().multiple_of(n), "x").all.select("r", F.size("issues")).collect()
        assert all((r == "0") == (k == 0) for r, k in told), n


def test_a_decimal_is_read_once(spark):
    df = spark.createDataFrame([("1E+3",), ("0100",), ("-.5e-2",), ("+1.",), ("-0.00",), ("1e99999999999",), ("1e-2147483648",), ("x",), (".",), (None,)], "x string")
    out = P.decode(df, s().to_decimal().map(D.to_text), "x").all
    assert [(r.value, len(r.issues)) for r in out.collect()] == [("1E+3", 0), ("100", 0), ("-0.005", 0), ("1", 0), ("0.00", 0), (None, 1), (None, 1), (None, 1), (None, 1), (None, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_extract") == 1


def test_fewest_digits(spark):
    rng = random.Random(3)
    values = [1e23, 2e-3, 5e-324, 0.1 + 0.2, -0.0, 1e7, 9999999.0, 0.001] + [rng.random() * 10 ** rng.randint(-300, 300) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    told = [r[0] for r in P.decode(df, d().max(-1e308), "x").all.select(F.element_at(F.get("issues", F.lit(0)).meta, "actual")).collect()]
    assert told[:8] == ["1.0E23", "0.002", "4.9E-324", "0.30000000000000004", "-0.0", "1.0E7", "9999999.0", "0.001"]
    assert [float(t) for t in told] == values
    digits = lambda t: re.sub("[eE].*", "", t).replace(".", "").strip("0-")
    assert [digits(t) for t in told[8:]] == [digits(repr(v)) for v in values[8:]]


def test_sets_by_type(spark):
    df = spark.createDataFrame([([0.0, -0.0, float("nan"), float("nan"), 1.0, None, 1.0, None], ["a", "NaN", "NaN"])], "a array<double>, s array<string>")
    for inner in (d().nullable(), d().nullable().map(lambda v: v * 1), d().nullable().refine(lambda v: v.isNull() | (v > -1), "x")):
        got = P.decode(df, P.set_of(inner), "a").all.first()
        assert sorted(map(str, got.value)) == ["0.0", "1.0", "None", "nan", "nan"]
    assert P.decode(df, P.set_of(s().map(F.upper)), "s").all.first().value == ["A", "NAN"]
    for maps in (lambda: P.list_of(P.dict_of(n())).unique(), lambda: P.set_of(P.dict_of(n()).nullable()), lambda: P.set_of(P.object_of(a=P.optional(P.list_of(P.dict_of(n()))))), lambda: P.list_of(P.dict_of(n())).contains(1)):
        with pytest.raises(ValueError, match="maps"):
            maps()
    P.set_of(P.object_of(a=n()))


def test_candidates_move_and_are_rendered(spark):
    df = spark.createDataFrame([('{"a":{"b":true}}',)], "t string")
    inner = P.one_of(n().max(3), P.one_of(P.int32().map(lambda v: v.cast("long")), n()))
    contract = P.object_of(a=P.new_decoder(lambda node: P.object_of(b=inner).compile(node)))
    out = P.decode_json(df, contract, "t").all.select(P.render(I.rebase(F.col("issues"), "x"), P.JAPANESE).alias("r")).first().r[0]
    outer = json.loads(out.meta["candidates"])
    assert out.path == "/x/a/b" and outer[0]["issues"][0]["path"] == "/x/a/b" and outer[0]["issues"][0]["message"] == "long型が必要です"
    nested = json.loads(outer[1]["issues"][0]["meta"]["candidates"])
    assert [c["issues"][0]["path"] for c in nested] == ["/x/a/b"] * 2 and "型が必要です" in nested[0]["issues"][0]["message"]


def test_candidates_of_candidates_to_the_depth_asked_for(spark):
    df = spark.createDataFrame([('{"b":9}',)], "t string")
    inner = n().max(1)
    for _ in range(4):
        inner = P.one_of(inner, n().max(2))
    issues = P.decode_json(df, P.object_of(b=inner), "t").all
    meta = json.loads(issues.select(P.render(I.rebase(F.col("issues"), "x", nested=4), P.JAPANESE, nested=4).alias("r")).first().r[0].meta["candidates"])
    for level in range(4):
        first, last = meta[0]["issues"][0], meta[1]["issues"][0]
        assert first["path"] == last["path"] == "/x/b" and last["message"] == "2以下で入力してください"
        meta = json.loads(first["meta"]["candidates"]) if level < 3 else None
    assert first["message"] == "1以下で入力してください"


def test_normal_forms_within_lists(spark):
    import unicodedata

    texts = ["é ﬁ ẛ̣", "abc", "", "한글 각", "Å"]
    df = spark.createDataFrame([(texts + [None],)], "t array<string>")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert P.decode(df, P.list_of(s().normalize(form).nullable()), "t").all.first().value == [unicodedata.normalize(form, t) for t in texts] + [None]


def test_no_json_text_for_what_is_no_number(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1.5,), (1e23,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(E.object_of(E.property("x", lambda v: v, E.float64)).encode(F.col("x"))).collect()] == ['{"x":1.5}', '{"x":1.0E23}']
    for bad in (float("nan"), float("inf"), -float("inf")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "x double").select(E.float64.encode(F.col("x"))).collect()


def test_the_entry_imports_without_the_corpus_operators(tmp_path):
    """The pipeline file may still be there."""
    for name in ("sparkpact", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        if os.path.exists(src):
            (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "sparkpact" / "llm", ignore_errors=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) >= 180, done.stderr
