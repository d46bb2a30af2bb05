"""Contracts that go far: long texts and many steps, any depth, alternatives of different types, any number of digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sparkpact as P
from sparkpact import encode as E
from sparkpact.plans import issues as I

from .contracts import _add, _table, _values, check, d, n, s

# patterns over whole texts: decided by the next character, and by states
_groups = r"(?:[a-zA-Z0-9]|[.,;:!?\x27\x22-]|[ \n])*"
check("string_pattern_groups", "documents", "doc_id", "text", s().pattern(r"([a-zA-Z0-9]|[.,;:!?'\"-]|[ \n])*"), f"NOT regexp_full_match(x, '{_groups}')", "invalid_format")
_states = r"(?:[^ ]* )*(?:the|der|que|les)(?: [^ ]*)*"
check("string_pattern_states", "documents", "doc_id", "text", s().pattern(r"([^ ]* )*(the|der|que|les)( [^ ]*)*"), f"NOT regexp_full_match(x, '{_states}')", "invalid_format")
# blanks inside do not make trimming slow
check("string_trim_inside", "documents", "doc_id", "concat(repeat(' ', 50), text, repeat(' ', 3000), text, repeat(' ', 50))", s().trim(), "false", "blank", value="md5(trim(x, chr(32) || chr(10) || chr(9) || chr(13)))", of=F.md5)


# chains
def _chain(step) -> P.Decoder:
    made = n()
    for k in range(2, 8):
        made = step(made, k)
    return made


_by = "WHEN x % {0} = 0 THEN ['by_{0}', 'by_{0}']"
check("combine_six_refinements", "part", "p_partkey", "p_size", _chain(lambda x, k: x.refine(lambda v: v % k != 0, f"by_{k}")), "x % 7 = 0", "by_7", value="x::BIGINT", more=" ".join(_by.format(k) for k in range(2, 7)))
_then = lambda x, k: x.and_then(lambda v: P.Outcome(v + 1, [("one", F.when(v % k == 0, P.issue(f"by_{k}", ())))]))
check("combine_six_and_thens", "part", "p_partkey", "p_size", _chain(_then), "(x + 5) % 7 = 0", "by_7", value="x::BIGINT + 6", more=" ".join(f"WHEN (x + {k - 2}) % {k} = 0 THEN ['by_{k}', 'by_{k}']" for k in range(2, 7)))
_mixed = lambda x, k: x.refine(lambda v: v % k != 1, "one").default(k).nullable().fallback(lambda issues: F.size(issues).cast("long"))
_values("combine_six_recoveries", "part", "p_partkey", "p_size", _chain(_mixed), "CASE WHEN list_contains([x % k = 1 FOR k IN [2, 3, 4, 5, 6, 7]], true) THEN 1 ELSE x END")


# alternatives of different types
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "case event_id % 4 when 0 then cast(event_id as string) when 1 then concat('\"', event_type, '\"') when 2 then '[1, 2]' else 'true' end"
    out = P.decode_json(_table(spark, sf_dir, "events").select("event_id", F.expr(text).alias("t")), P.one_of(number=n(), text=s(), list=P.list_of(n())), "t").all
    v = F.col("value")
    said = P.unwrapped(v, number=lambda x: x.cast("string"), text=lambda x: x, list=lambda x: F.size(x).cast("string"))
    return out.select("event_id", v["tag"].alias("tag"), v["number"].alias("number"), v["text"].alias("text"), said.alias("said"), F.get("issues", F.lit(0)).code.alias("code"))


_add("one_of_types", _types, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'list' END AS tag, CASE event_id % 4 WHEN 0 THEN event_id END AS number, CASE event_id % 4 WHEN 1 THEN event_type END AS text, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN '2' END AS said, CASE event_id % 4 WHEN 3 THEN 'one_of_failed' END AS code FROM events")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "value", "user_id").alias("event"))
    contract = P.discriminate("event_type", {"click": P.object_of(value=d().max(20.0)), "view": P.object_of(user_id=n(), event_type=s())}, union=True)
    out = P.decode(df, contract, "event").all
    v, first = F.col("value"), F.get("issues", F.lit(0))
    return out.select("event_id", v["tag"].alias("tag"), v["click"]["value"].alias("clicked"), v["view"]["user_id"].alias("viewer"), I.pointer(first.path).alias("path"), first.code.alias("code"))


_add("choice_union", _union, """SELECT event_id, CASE WHEN event_type = 'view' OR event_type = 'click' AND value <= 20 THEN event_type END AS tag, CASE WHEN event_type = 'click' AND value <= 20 THEN value END AS clicked,
  CASE WHEN event_type = 'view' THEN user_id::BIGINT END AS viewer, CASE WHEN event_type NOT IN ('click', 'view') THEN '/event_type' WHEN event_type = 'click' AND value > 20 THEN '/value' END AS path,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'not_allowed' WHEN event_type = 'click' AND value > 20 THEN 'out_of_range' END AS code FROM events""")


# recursion: objects in objects, deeper than any plan
def _category() -> P.Decoder:
    return P.object_of(name=s().non_blank(), child=P.optional(P.lazy(_category)), others=P.optional(P.list_of(P.lazy(_category))))


def _written() -> E.Encoder:
    below = E.lazy(_written)
    return E.object_of(E.property("name", lambda v: v["name"]), E.optional_property("child", lambda v: v["child"], below), E.optional_property("others", lambda v: v["others"], E.list_of(below)))


_DEPTH = 11
_deep = f"concat(repeat('{{\"name\":\"a\",\"child\":', n_nationkey % {_DEPTH}), '{{\"name\":\"', case when n_nationkey % 3 = 0 then ' ' else n_name end, '\",\"others\":[{{\"name\":\"x\"}},{{\"name\":\"', case when n_nationkey % 4 = 0 then '' else 'y' end, '\"}}]}}', repeat('}}', n_nationkey % {_DEPTH}))".replace("{{", "{").replace("}}", "}")


def _trees(spark: SparkSession, sf_dir: str) -> P.Tree:
    return P.decode_tree(_table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_deep).alias("t")), _category(), "t")


_add("tree_issues", lambda sp, sf: _trees(sp, sf).issues("n_nationkey").select("n_nationkey", "position", "path", "code"), f"""
SELECT n_nationkey, 0 AS position, repeat('/child', n_nationkey % {_DEPTH}) || '/name' AS path, 'blank' AS code FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END, repeat('/child', n_nationkey % {_DEPTH}) || '/others/1/name', 'blank' FROM nation WHERE n_nationkey % 4 = 0""")
_add("tree_round_trip", lambda sp, sf: (lambda t: P.encode_tree(t, _written()).join(t.valid(), "row").select("n_nationkey", F.col("text").alias("json")))(_trees(sp, sf)), f"SELECT n_nationkey, {_deep} AS json FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0")


# candidates move with their issue and are rendered with it
def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = P.new_decoder(lambda node: P.one_of(n().max(10), n().min(40)).compile(node))
    df = _table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size")).alias("x"))
    told = P.render(I.rebase(F.col("issues"), "part"), P.JAPANESE)
    return P.decode(df, P.object_of(size=either), "x").all.select("p_partkey", F.explode(told).alias("i")).select("p_partkey", "i.path", "i.message", F.col("i.meta")["candidates"].alias("candidates"))


def _candidate(k: int, name: str, said: str, of: str) -> str:
    return f"'{{\"candidate\":{k},\"issues\":[{{\"path\":\"/part/size\",\"code\":\"out_of_range\",\"message\":\"{said}\",\"meta\":{{\"{name}\":\"{of}\",\"actual\":\"' || p_size || '\"}}}}]}}'"


_add("candidates_rendered", _candidates, f"SELECT p_partkey, '/part/size' AS path, 'いずれのバリアントにも一致しませんでした' AS message, '[' || {_candidate(0, 'max', '10以下で入力してください', '10')} || ',' || {_candidate(1, 'min', '40以上で入力してください', '40')} || ']' AS candidates FROM part WHERE p_size > 10 AND p_size < 40")

# numbers of any length, and the fewest digits of a double
_divisor = "1" + "0" * 20 + "7" + "3" * 22
_long = f"case when p_partkey % 3 = 0 then concat(repeat('9', 50), p_partkey) else concat('{_divisor}', repeat('0', p_partkey % 30)) end"
check("decimal_long_divisor", "part", "p_partkey", _long, s().to_decimal().multiple_of(_divisor), "starts_with(x, '9')", "not_multiple_of")
_digits = "regexp_replace(regexp_replace(replace(split_part({0}, '{1}', 1), '.', ''), '^-?0*', ''), '0*$', '')"


def _shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.expr("l_extendedprice * l_tax * 1e18 / 3").alias("x"))
    told = P.decode(df, d().max(-1.0), "x").all.select("k", F.expr("issues[0].meta['actual']").alias("a"))
    return told.select("k", F.regexp_replace(F.regexp_replace(F.replace(F.split_part("a", F.lit("E"), F.lit(1)), F.lit("."), F.lit("")), "^-?0*", ""), "0*$", "").alias("digits"))


_add("double_shortest", _shortest, f"SELECT l_orderkey * 10 + l_linenumber AS k, {_digits.format('(l_extendedprice * l_tax * 1e18::DOUBLE / 3)::VARCHAR', 'e')} AS digits FROM lineitem")


# sets by the type of what a chain of decoders gives
def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part").select("p_partkey", F.expr("array(p_retailprice, 0.0D, -0.0D, double('NaN'), double('NaN'), p_retailprice)").alias("x"))
    known = P.decode(df, P.set_of(d().nullable()), "x").all.select("p_partkey", F.size("value").alias("known"))
    typed = P.decode(df, P.set_of(d().map(lambda v: v * 1)), "x").all.select("p_partkey", F.size("value").alias("typed"))
    return known.join(typed, "p_partkey")


_add("set_of_wrapped_doubles", _sets, "SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 3 ELSE 4 END::INT AS known, CASE WHEN p_retailprice = 0 THEN 3 ELSE 4 END::INT AS typed FROM part")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside a list, where no Python could run."""
    df = _table(spark, sf_dir, "documents").select("doc_id", F.expr("array(concat(text, 'u', decode(unhex('CC88'), 'UTF-8')), 'e')").alias("x"))
    return P.decode(df, P.list_of(s().normalize("NFC")), "x").all.select("doc_id", F.md5(F.get("value", F.lit(0))).alias("md5"))


_add("list_normalize", _forms, "SELECT doc_id, md5(nfc_normalize(text || 'u' || chr(776))) AS md5 FROM documents")

__all__: list[str] = []
