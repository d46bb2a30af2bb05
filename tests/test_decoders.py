"""Behaviour of decoders on JSON, both readers: path and code of every issue, and values."""

import json

import pandas
import pytest

import sparkpact as P

s, n = P.string, P.integer


def run(spark, decoder, texts, lossless=False):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = P.decode_json(df, decoder, "t", lossless).all.orderBy("i").collect()
    return [(r.value, ["/".join(["", *i.path]) + " " + i.code for i in r.issues], [{k: json.loads(v) for k, v in i.meta.items()} for i in r.issues]) for r in rows]


def issues(spark, decoder, text, lossless=False):
    return run(spark, decoder, [text], lossless)[0][1]


@pytest.mark.parametrize("lossless", [False, True])
def test_object_tells_every_issue_in_order(spark, lossless):
    user = P.object_of(email=s().trim().non_blank(), age=n().range(0, 150), nickname=P.optional(s().trim())).strict()
    texts = ['{"email":"  ","age":200,"extra":1,"another":2}', '{"email":" a ","age":5}', '{"email":"a","age":5,"nickname":null}', '"x"', "null", '{"a":1} x', '{"a":1,"a":2}', ""]
    got = run(spark, user, texts, lossless)
    extra = ["/extra unknown_field", "/another unknown_field"] if lossless else ["/another unknown_field", "/extra unknown_field"]
    assert got[0][1] == ["/email blank", "/age out_of_range", *extra]
    assert got[1][0].email == "a" and got[1][0].age == 5 and got[1][0].nickname is None
    assert got[2][1] == ["/nickname required"]
    assert got[3][1] == ["/email type_mismatch", "/age type_mismatch"]
    assert got[4][1] == ["/email required", "/age required"]
    assert [g[1] for g in got[5:]] == [[" invalid_format"]] * 3


def test_presence_nullable_default_fallback(spark):
    note = P.object_of(note=P.presence(s()))
    assert [r[0].note.state for r in run(spark, note, ["{}", '{"note":null}', '{"note":"x"}'])] == ["absent", "null", "present"]
    nullable = P.object_of(note=s().nullable())
    assert [r[1] for r in run(spark, nullable, ['{"note":null}', "{}"])] == [[], ["/note required"]]
    assert [r[0] for r in run(spark, n().default(7), ["null", "3"])] == [7, 3]
    assert issues(spark, n().default(7), '"x"') == [" type_mismatch"]
    assert [r[0] for r in run(spark, n().fallback(7), ["null", '"x"', "1"])] == [7, 7, 1]


def test_lists(spark):
    assert issues(spark, P.list_of(n()), '[1,"a",3,true]') == ["/1 type_mismatch", "/3 type_mismatch"]
    assert run(spark, P.list_of(n()).unique(), ["[1,2,1,2,1]"])[0][2] == [{"duplicates": [1, 2]}]
    assert run(spark, P.list_of(n()).contains_all(1, 3, 3, 4), ["[1,2]"])[0][2] == [{"expected": [1, 3, 3, 4], "missing": [3, 3, 4]}]
    assert issues(spark, P.list_of(n()).non_empty(), "[]") == [" too_small"]
    assert issues(spark, P.list_of(n()), '{"a":1}') == [" type_mismatch"]
    assert sorted(run(spark, P.set_of(n()), ["[1,2,1,3]"])[0][0]) == [1, 2, 3]
    assert issues(spark, P.dict_of(n()), '{"b":"x","a":"y"}', True) == ["/b type_mismatch", "/a type_mismatch"]
    assert run(spark, P.dict_of(n()), ['{"a":1}'])[0][0] == {"a": 1}


def test_choices(spark):
    shape = P.discriminate("kind", {"square": P.object_of(side=n()), "rect": P.object_of(side=n())})
    got = run(spark, shape, ['{"kind":"rect","side":2}', '{"kind":"circle"}', "{}", '"rect"'])
    assert got[0][0].side == 2
    assert [g[1] for g in got[1:]] == [["/kind not_allowed"], ["/kind required"], ["/kind type_mismatch"]]
    assert got[1][2] == [{"allowed": ["rect", "square"], "actual": "circle"}]
    assert [g[1] for g in run(spark, P.enum_of({"straße": 1}), ['"STRAßE"', '"STRASSE"'])] == [[], [" invalid_format"]]
    either = P.one_of(n().map(lambda v: v.cast("string")), s().min_length(3))
    got = run(spark, either, ['"ab"', '"abc"', "5"])
    assert got[0][1] == [" one_of_failed"] and len(json.loads(json.dumps(got[0][2][0]["candidates"]))) == 2
    assert [g[0] for g in got[1:]] == ["abc", "5"]


def test_nested_strict_tells_once(spark):
    inner = P.object_of(a=n(), b=n()).strict()
    outer = P.object_of(P.fields().flat(inner).field("c", n())).strict("a", "c")
    assert issues(spark, outer, '{"a":1,"b":2,"c":3,"d":4}', True) == ["/c unknown_field", "/d unknown_field", "/b unknown_field"]


def test_numbers_as_written(spark):
    got = run(spark, P.int32(), ["1.5", "1e2", "1.0", "3000000000", "-0", "7"], True)
    assert [g[1] for g in got] == [[" type_mismatch"]] * 4 + [[], []]
    assert [g[0] for g in got[4:]] == [0, 7]
    assert run(spark, P.uint64(), ["18446744073709551615"], True)[0][0] == 18446744073709551615
    assert [g[1] for g in run(spark, P.decimal_number().scale(1), ["1.20", "1.2", "1e3", '"1"'], True)] == [[" invalid_scale"], [], [], [" type_mismatch"]]
    assert [g[1] for g in run(spark, P.float64(), ["1e400", "1"], True)] == [[" type_mismatch"], []]
    big = run(spark, P.decimal_number().max("1e20").multiple_of(3), ["1e-1000000000", "9" * 60, "3e10"], True)
    assert [g[1] for g in big] == [[" not_multiple_of"], [" out_of_range"], []]


def test_float_order(spark):
    import pyspark.sql.types as T

    df = spark.createDataFrame([(0, -0.0), (1, 0.0), (2, float("nan")), (3, float("inf"))], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())]))
    codes = lambda d: [[i.code for i in r.issues] for r in P.decode(df, d, "x").all.orderBy("i").collect()]
    assert codes(P.float64().non_negative()) == [["out_of_range"], [], [], ["type_mismatch"]]
    assert codes(P.float64().negative()) == [[], ["out_of_range"], ["out_of_range"], ["type_mismatch"]]
    assert codes(P.float64().max(5)) == [[], [], ["out_of_range"], ["type_mismatch"]]
    assert codes(P.float64().one_of(0.0, float("nan"))) == [["not_allowed"], [], [], ["type_mismatch"]]


@pytest.mark.parametrize("kind,good,bad", [
    ("instant", ["2024-01-15T24:00:00Z", "2024-01-15T10:30:00.123456789+09:00", "-1000000000-01-01T00:00:00Z"], ["2024-01-15T10:30Z", "2024-01-15T10:30:60Z", "2024-02-30T10:30:00Z", "2024-01-15T24:00:00.0Z"]),
    ("date", ["2024-02-29", "+10000-12-31", "-0001-03-01"], ["2023-02-29", "2024-1-5", "2024-01-15T00:00"]),
    ("time", ["10:30", "10:30:45.5"], ["24:00", "10:30:60", "1:30"]),
    ("offset_date_time", ["2024-01-15T10:30+18:00"], ["2024-01-15T10:30+18:01", "2024-01-15T10:30"]),
])
def test_temporals(spark, kind, good, bad):
    decoder = getattr(s(), kind)()
    got = run(spark, decoder, [json.dumps(t) for t in good + bad])
    assert [not g[1] for g in got] == [True] * len(good) + [False] * len(bad)


def test_formats(spark):
    def verdicts(decoder, texts):
        return [not g[1] for g in run(spark, decoder, [json.dumps(t) for t in texts])]

    assert verdicts(s().email(), ["a@b.co", "a..b@c.de", "a@-b.co", "x" * 65 + "@b.co"]) == [True, False, False, False]
    assert verdicts(s().ipv4(), ["1.2.3.4", "01.2.3.4", "256.1.1.1"]) == [True, False, False]
    assert verdicts(s().ipv6(), ["::1", "fe80::1%eth0", "2001:db8::1%eth0", "1::2::3"]) == [True, True, False, False]
    assert verdicts(s().uri(), ["mailto:x", "http://%41.example/", "nope", "http://a/ b"]) == [True, True, False, False]
    assert verdicts(s().url(), ["HTTP://a", "ftp://a", "http://"]) == [True, False, False]
    assert verdicts(s().pattern(r"[a-z]+\d"), ["ab1", "ab1\n", "1"]) == [True, False, False]
    assert verdicts(s().to_bool(), ["ON", "t"]) == [True, False]
    assert [g[0] for g in run(spark, s().to_int(), ['"+007"', '"2147483648"', '" 1"'])] == [7, None, None]
    assert run(spark, s().trim(), [json.dumps("  x ")])[0][0] == "x"
    assert run(spark, s().normalize("NFC"), [json.dumps("é")])[0][0] == "é"


def test_messages_attach_to_the_last_check(spark):
    decoder = s().message("text please").min_length(3).message("longer")
    df = spark.createDataFrame([(0, "1"), (1, '"a"')], "i int, t string")
    rows = P.decode_json(df, decoder, "t").all.orderBy("i").collect()
    assert [r.issues[0].custom_message for r in rows] == ["text please", "longer"]


def test_and_then_rebases_and_lazy(spark):
    from pyspark.sql import functions as F

    period = P.object_of(start=n(), end=n()).and_then(lambda v: P.Outcome(v, [("one", F.when(v.start > v.end, P.issue("invalid_value", ("end",))))]))
    outer = P.object_of(period=period)
    assert issues(spark, outer, '{"period":{"start":5,"end":1}}') == ["/period/end invalid_value"]
    assert issues(spark, outer, '{"period":{"start":"a","end":1}}') == ["/period/start type_mismatch"]


@pytest.mark.parametrize("build", [
    lambda: s().one_of("a", "a"), lambda: s().one_of(), lambda: n().multiple_of(0), lambda: P.float64().range(2, 1), lambda: s().pattern("(?=a)"), lambda: s().pattern("a{1,999999999}"), lambda: s().pattern("(?:a{1000}){1000}"), lambda: s().pattern("a{249999}"),
    lambda: s().date_time().between("2024-01-02T00:00", "2024-01-01T00:00"), lambda: s().instant().between("2024-01-01T00:00:00Z", "2024-01-01T00:30:00+01:00"), lambda: s().offset_date_time().between("2024-01-01T00:00+01:00", "2023-12-31T22:59Z"),
    lambda: P.enum_of({"A": 1, "a": 2}), lambda: P.one_of(), lambda: s().min_length(-1), lambda: s().normalize("X"), lambda: P.fields().field("a", s()).field("a", s()),
    lambda: P.list_of(n()).contains_all(), lambda: s().date().before("x"), lambda: P.encode.object_of(P.encode.property("a", None), P.encode.property("a", None)), lambda: P.encode.enum_of({"a": 1, "b": 1}),
])
def test_bad_definitions_are_refused(build):
    with pytest.raises(ValueError):
        build()


def test_paths():
    from sparkpact.plans.paths import Path

    p = Path.of("/a~1b/~0c").index(3)
    assert p.segments() == ["a/b", "~c", "3"] and str(p) == "/a~1b/~0c/3"
    assert Path().is_root() and str(Path().key("x").append(p)) == "/x/a~1b/~0c/3"
    for bad in ("a", "/~2"):
        with pytest.raises(ValueError):
            Path.of(bad)


def test_json_written_anew(spark):
    from sparkpact.sources.json import ordered

    texts = ['{"b":1.20,"a":[-0,{"z":null,"y":true}],"é":"\\n"}', "1E+5", '{"a":1,"a":2}', "[1,]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.o for r in df.orderBy("i").select(ordered(df.t).alias("o")).collect()] == [texts[0], "1E+5", None, None]


def test_nfc_reads_whole_texts(spark, tmp_path):
    import unicodedata

    from pyspark.sql import functions as F

    from sparkpact.queries import contracts

    texts = ["x" * 150 + "o\u0308", "\u1100\u1161" * 200, "a" * 5000 + "u\u0323\u0302"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.k: r.value for r in contracts._queries["string_normalize_nfc_whole"](spark, str(tmp_path)).collect()}
    wanted = spark.createDataFrame([(k, unicodedata.normalize("NFC", "e\u0301" + t)) for k, t in enumerate(texts)], "k long, x string").select("k", F.md5("x").alias("h"))
    assert got == {r.k: r.h for r in wanted.collect()}


def test_patterns_within_the_limits():
    for pattern in ("a{249998}", "(ab|c)*d?", r"[^\]]+x{2,}", "(?:a|b){3}"):
        s().pattern(pattern)


@pytest.mark.parametrize("kind", ["date", "time", "date_time", "instant", "offset_date_time"])
def test_near_and_far_years_are_read_alike(spark, kind):
    """The engine's calendar, arithmetic of our own, and the driver's bounds agree."""
    from pyspark.sql import functions as F

    from sparkpact.operators.temporal import INSTANT, ORDER, _far, parse, value_of

    days = ["0000-01-01", "0001-03-01", "1600-02-29", "1900-02-28", "1969-12-31", "1970-01-01", "2000-02-29", "2024-12-31", "9999-12-31", "2023-02-29", "-0001-03-01", "+10000-02-29"]
    clocks = {"date": [""], "time": ["00:00", "23:59:59.5"], "date_time": ["T00:00", "T10:30:01.123456789"], "instant": ["T24:00:00Z", "T01:02:03.5-00:30"], "offset_date_time": ["T10:30Z", "T00:00:00.000000001+17:59:30", "T12:00-18:00"]}[kind]
    texts = [d + c for d in ([""] if kind == "time" else days) for c in clocks]
    fields = ORDER.get(kind, INSTANT)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", parse(F.col("t"), kind).alias("v"), _far(F.col("t"), kind).alias("w")).collect()
    for r in rows:
        assert r.v == r.w and (r.v and tuple(r.v[f] for f in fields)) == value_of(r.t, kind), r.t


def test_conversions_share_one_message(spark):
    df = spark.createDataFrame([("x",), ("99999999999",), ("7",)], "x string")
    got = [r.issues[0].custom_message for r in P.decode(df, s().to_int().message("whole").max(5).message("small"), "x").all.collect()]
    assert got == ["whole", "whole", "small"]


def test_places_and_rounded_numbers(spark):
    from pyspark.sql import functions as F

    texts = ['{"a":1,\n "b":{"c":1, "c":2}}', '[{"x":"a\\"b","x":1}]', '{"a":[1,{"a":2}],"a":3}', "[1,", '{"n":1e400}', '{"n":1.25}', '{"n":1} x', '{"n":1}]', '{"n":1},2', "1, 2]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    contract = P.object_of(n=P.decimal_number())
    meta = [r.issues[0].meta if r.issues else None for r in P.decode_json(df, contract, "t", lossless=True).all.orderBy("i").collect()]
    assert [(m["line"], m["column"]) for m in meta[:4]] == [("2", "14"), ("1", "14"), ("1", "18"), ("1", "4")]
    assert meta[4] is None and meta[5] is None and all(m["line"] == "1" for m in meta[6:])
    fast = [r.issues[0].message_key if r.issues else None for r in P.decode_json(df, contract, "t").all.orderBy("i").collect()]
    assert fast == ["invalid_format.json"] * 4 + ["type_mismatch.numeric_range", None] + ["invalid_format.json"] * 4
    # functions of callers over what was decoded
    def shout(x):
        return x.str.upper()

    shout.__annotations__ = {"x": pandas.Series, "return": pandas.Series}
    udf = F.pandas_udf(shout, "string")
    out = P.decode_json(df, P.object_of(n=P.list_of(P.integer()).unique()), "t").all
    assert out.select(udf(F.to_json("issues")).alias("x")).where("x is not null").count() == len(texts)


def test_elements_that_cannot_be_told_apart_are_refused(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1,)], "i int").select(F.array(F.create_map(F.lit("a"), F.lit(1))).alias("x"))
    maps = P.list_of(P.dict_of(P.integer()))
    for contract in (lambda: maps.unique(), lambda: maps.to_set()):  # when they are built
        with pytest.raises(ValueError):
            P.decode(df, contract(), "x")
    assert P.decode(df, maps.non_empty(), "x").all.first().issues == []
    doubles = spark.createDataFrame([([0.0, -0.0, float("nan"), float("nan"), 1.0, 1.0],)], "x array<double>")
    assert len(P.decode(doubles, P.set_of(P.float64()), "x").all.first().value) == 4


def test_nothing_is_lost_below_the_depth_of_an_encoder(spark):
    from pyspark.sql import functions as F

    E = P.encode

    def node():
        return E.object_of(E.property("a", lambda v: v), E.optional_property("b", lambda v: v, E.lazy(node, 2)))

    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception, match="deeper than 2"):
        df.select(node().encode(F.col("x"))).collect()
