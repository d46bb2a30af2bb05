"""Catalogues, issue algebra, encoders and round trips."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sparkpact as P
from sparkpact import encode as E
from sparkpact.functions.catalogue import interpolate, interpolate_fully, java_double, parse_properties


def test_interpolate_once():
    assert interpolate("{min} of {max} {v} { }", {"min": 3, "max": "{other}", "other": 1}) == "3 of {other} {v} { }"
    assert interpolate_fully("{a} {b}", {"a": 1}) is None


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=200, deadline=None)
def test_java_double_reads_back(x):
    assert float(java_double(x)) == x


def test_java_double_forms():
    assert [java_double(x) for x in (1e7, 100.0, 0.001, 1e-4, 5e-324, 1e23, -0.0)] == ["1.0E7", "100.0", "0.001", "1.0E-4", "4.9E-324", "1.0E23", "-0.0"]


def test_properties():
    assert parse_properties("a\\ b : c\\u0041\n#x\nk=v\\\n  w\n") == {"a b": "cA", "k": "vw"}
    with pytest.raises(P.PropertiesError):
        parse_properties("a=\\u12")


def test_layers():
    own = P.ENGLISH.with_overrides({"too_short": "{min} or more, {missing}"})
    assert own.resolve("too_short", "too_short", {"min": 3}) == "must be at least 3 characters"
    assert own.resolve("odd", "odd.one", {}) == "validation failed: odd"
    assert set(P.JAPANESE.templates()) == set(P.ENGLISH.templates())


def test_render_and_format(spark):
    df = spark.createDataFrame([(1, '{"a":["x",1],"b":"zz"}')], "i int, t string")
    contract = P.object_of(a=P.list_of(P.integer()), b=P.string().min_length(3))
    out = P.decode_json(df, contract, "t").all
    got = out.select(P.render(F.col("issues")).alias("r"), P.format_tree(F.col("issues")).alias("f"), P.error_text(F.col("issues")).alias("e"), P.render(F.col("issues"), P.JAPANESE).alias("j")).first()
    assert [(r.path, r.message) for r in got.r] == [("/a/0", "expected long"), ("/b", "must be at least 3 characters")]
    assert json.loads(got.f) == {"a": {"0": {"_errors": ["expected long"]}}, "b": {"_errors": ["must be at least 3 characters"]}}
    assert got.e == "/a/0: expected long\n/b: must be at least 3 characters"
    assert got.j[1].message == "3文字以上で入力してください"


def test_round_trip(spark):
    contract = P.object_of(email=P.string(), age=P.integer(), nickname=P.optional(P.string()), note=P.presence(P.string()), joined=P.string().date(), balance=P.decimal_number())
    encoder = E.object_of(
        E.property("email", lambda v: v.email), E.property("age", lambda v: v.age), E.optional_property("nickname", lambda v: v.nickname),
        E.presence_property("note", lambda v: v.note), E.property("joined", lambda v: v.joined, E.date), E.property("balance", lambda v: v.balance, E.decimal),
    )
    texts = [
        '{"email":"a\\"b","age":1,"note":null,"joined":"2024-02-29","balance":1.20}',
        '{"email":"é","age":-5,"nickname":"n","joined":"-0001-03-01","balance":1E+3}',
        '{"email":"","age":0,"note":"x","joined":"+10000-12-31","balance":-1E-7}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    once = P.decode_json(df, contract, "t", lossless=True).all
    assert once.where(F.size("issues") > 0).count() == 0
    again = [r.t for r in once.orderBy("i").select(encoder.encode(F.col("value")).alias("t")).collect()]
    assert again == texts


@given(st.lists(st.tuples(st.integers(-10**30, 10**30), st.integers(-40, 40)), min_size=2, max_size=2))
@settings(max_examples=15, deadline=None)
def test_decimals_against_exact(spark, pair):
    from fractions import Fraction

    from sparkpact.functions import decimals as D

    texts = [f"{a}e{p}" for a, p in pair]
    x, y = (Fraction(a) * Fraction(10) ** p for a, p in pair)
    row = spark.range(1).select(*(F.lit(t).alias(c) for t, c in zip(texts, "ab"))).select(D.parse(F.col("a")).alias("a"), D.parse(F.col("b")).alias("b")).select(D.compare(F.col("a"), F.col("b")).alias("c"), D.sign(F.col("a")).alias("s")).first()
    assert row.c == (x > y) - (x < y) and row.s == (x > 0) - (x < 0)


def test_stream(spark, tmp_path):
    from sparkpact.streaming.decode import decode_stream, parquet_stream

    src = str(tmp_path / "in")
    spark.range(10).withColumnRenamed("id", "x").write.parquet(src)
    stream = parquet_stream(spark, src, spark.read.parquet(src).schema)
    result = decode_stream(stream, P.object_of(x=P.integer().max(6)))
    query = result.valid().writeStream.format("memory").queryName("good").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.x for r in spark.table("good").collect()) == list(range(7))
    with pytest.raises(ValueError):
        decode_stream(spark.range(1), P.object_of())


def test_a_stream_is_decoded_once_for_both_sinks(spark, tmp_path):
    from sparkpact.streaming.decode import decode_stream, parquet_stream, split_sinks

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id as x").write.parquet(str(tmp_path / f"in/{k}"))
    stream = parquet_stream(spark, str(tmp_path / "in/*"), spark.range(1).selectExpr("id as x").schema, 1)
    query = split_sinks(decode_stream(stream, P.object_of(x=P.integer().max(24))), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"), "x", once=True)
    assert query.awaitTermination(120)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "good")).collect()) == list(range(25))
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.x, r.path, r.code) for r in bad.collect()) == [(x, "/x", "out_of_range") for x in range(25, 30)] and bad.select("batch").distinct().count() >= 1
