"""What issues tell (metadata, messages, places), and the combinators, issue functions and encoders that the
other contracts leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sparkpact as P
from sparkpact import encode as E
from sparkpact.functions import decimals as D
from sparkpact.plans import issues as I

from .contracts import EVENT, _add, _category, _event_issues, _queries, _sql, _table, _type, _value, _values, check, d, n, s

Case = tuple[str, str, str, str, str | None]


def meta_text(meta: Column) -> Column:
    """name=JSON text, by name."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat(e.key, F.lit("="), e.value))), ";")


def _first(out: DataFrame, *more: Column) -> DataFrame:
    i = F.get(F.col("issues"), F.lit(0))
    return out.select("k", i.code.alias("code"), i.message_key.alias("message_key"), meta_text(i.meta).alias("meta"), i.custom_message.alias("said"), I.pointer(i.path).alias("path"), *more)


def _case_sql(cases: list[Case], table: str, path: str = "") -> str:
    """cases: (SQL condition over x, code, message key, SQL of the metadata, own message), the first that holds."""
    def column(name: str, of) -> str:
        return f"CASE {' '.join(f'WHEN {c[0]} THEN {of(c)}' for c in cases)} END AS {name}"

    quoted = lambda t: "NULL" if t is None else "'" + t + "'"
    columns = [column("code", lambda c: quoted(c[1])), column("message_key", lambda c: quoted(c[2])), column("meta", lambda c: c[3]), column("said", lambda c: quoted(c[4])), column("path", lambda c: quoted(path))]
    return f"SELECT k, {', '.join(columns)} FROM {table} q"


def told(name: str, table: str, key: str, text: str, decoder: P.Decoder, cases: list[Case], sql_text: str | None = None) -> None:
    """A query of the first issue of each row with all that it tells."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table).select(F.expr(key).alias("k"), F.expr(text).alias("x"))
        return _first(P.decode(df, decoder, "x").all)

    _add(name, query, _case_sql(cases, f"(SELECT {key} AS k, {sql_text or text} AS x FROM {table})"))


def told_array(name: str, decoder: P.Decoder, cases: list[Case]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("y"))
        return _first(P.decode(rows.select("k", F.transform("y", lambda y: (y.l_partkey % 5).cast("long")).alias("x")), decoder, "x").all)

    _add(name, query, _case_sql(cases, "(SELECT l_orderkey AS k, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1)"))


# scalars
told("told_int", "part", "p_partkey", "p_size", n().min(20).message("too small"), [("x < 20", "out_of_range", "out_of_range.minimum", "'actual=' || x || ';min=20'", "too small")])
told("told_int_multiple", "part", "p_partkey", "p_size", n().multiple_of(3).one_of(3, 6), [("x % 3 <> 0", "not_multiple_of", "not_multiple_of", "'actual=' || x || ';divisor=3'", None), ("x NOT IN (3, 6)", "not_allowed", "not_allowed", "'actual=' || x || ';allowed=[3,6]'", None)])
told("told_string", "part", "p_partkey", "p_name", s().min_length(12).message("short").max_length(20), [("length(x) < 12", "too_short", "too_short", "'actual=' || length(x) || ';min=12'", "short"), ("length(x) > 20", "too_long", "too_long", "'actual=' || length(x) || ';max=20'", None)])
told("told_string_type", "part", "p_partkey", "p_size", s().message("a text"), [("true", "type_mismatch", "type_mismatch", "'actual=\"number\";expected=\"string\"'", "a text")])
told("told_conversion", "orders", "o_orderkey", "case o_orderkey % 3 when 0 then 'x' when 1 then '99999999999' else '7' end", s().to_int().message("a whole number").max(5).message("at most five"), [
    ("x = 'x'", "type_mismatch", "type_mismatch", "'expected=\"integer\"'", "a whole number"), ("x = '99999999999'", "type_mismatch", "type_mismatch.numeric_range", "'expected=\"integer\"'", "a whole number"),
    ("x = '7'", "out_of_range", "out_of_range.maximum", "'actual=7;max=5'", "at most five")])
told("told_double", "lineitem", "l_orderkey * 10 + l_linenumber", "l_discount", d().max(0.05).message("too much"), [("x > 0.05", "out_of_range", "out_of_range.maximum", "'actual=' || x::VARCHAR || ';max=0.05'", "too much")])
told("told_double_type", "part", "p_partkey", "p_name", P.float32(), [("true", "type_mismatch", "type_mismatch", "'actual=\"string\";expected=\"number\"'", None)])
told("told_bool", "labels", "doc_id", "quality = 1", P.boolean().is_true().message("must be good"), [("NOT x", "invalid_value", "invalid_value", "'actual=false;expected=true'", "must be good")])
told("told_bool_type", "labels", "doc_id", "quality", P.boolean().message("yes or no"), [("true", "type_mismatch", "type_mismatch", "'actual=\"number\";expected=\"boolean\"'", "yes or no")])
told("told_bytes_type", "part", "p_partkey", "p_name", P.binary(), [("true", "type_mismatch", "type_mismatch", "'actual=\"string\";expected=\"byte[]\"'", None)])
_fraction = "concat(cast(l_quantity as int), case l_linenumber % 3 when 0 then '.5' when 1 then '.250' else '' end)"
told("told_decimal_scale", "lineitem", "l_orderkey * 10 + l_linenumber", _fraction, s().to_decimal().scale(1).message("one place").min("10.0"), [
    ("x LIKE '%.250'", "invalid_scale", "invalid_scale", "'actualScale=3;maxScale=1'", "one place"), ("x::DOUBLE < 10", "out_of_range", "out_of_range.minimum", "'actual=' || x || ';min=10.0'", None)])
told("told_decimal_multiple", "lineitem", "l_orderkey * 10 + l_linenumber", "l_orderkey", P.decimal_number().multiple_of("12345678901234567890").message("no"), [("x % 12345678901234567890 <> 0", "not_multiple_of", "not_multiple_of", "'actual=' || x || ';divisor=12345678901234567890'", "no")])
_day = "date_format(o_orderdate, 'yyyy-MM-dd')"
_day_sql = "strftime(o_orderdate, '%Y-%m-%d')"
told("told_date", "orders", "o_orderkey", _day, s().date().before("1996-01-01").message("too late"), [("x >= '1996-01-01'", "out_of_range", "out_of_range.before", "'actual=\"' || x || '\";before=\"1996-01-01\"'", "too late")], _day_sql)
told("told_date_between", "orders", "o_orderkey", _day, s().date().between("1995-01-01", "1996-12-31"), [("x NOT BETWEEN '1995-01-01' AND '1996-12-31'", "out_of_range", "out_of_range.between", "'actual=\"' || x || '\";from=\"1995-01-01\";to=\"1996-12-31\"'", None)], _day_sql)
_kinds = {
    "time": ("case {0} when 0 then '24:00' when 1 then '10:30' when 2 then '10:30:60' when 3 then '23:59:59.999999999' else '1:00' end", "x IN ('24:00', '10:30:60', '1:00')"),
    "date_time": ("case {0} when 0 then '2023-02-29T00:00' when 1 then '2024-02-29T10:30' when 2 then '2024-01-01 10:30' when 3 then '-0001-12-31T00:00:00.5' else '2024-01-01' end", "x IN ('2023-02-29T00:00', '2024-01-01 10:30', '2024-01-01')"),
    "instant": ("case {0} when 0 then '2024-01-01T10:30:00' when 1 then '2024-01-01T24:00:00Z' when 2 then '2024-01-01T10:30Z' when 3 then '+10000-01-01T00:00:00Z' else '2024-01-01T00:00:00+18:01' end", "x IN ('2024-01-01T10:30:00', '2024-01-01T10:30Z', '2024-01-01T00:00:00+18:01')"),
    "offset_date_time": ("case {0} when 0 then '2024-01-01T10:30' when 1 then '2024-01-01T10:30+09:00' when 2 then '2024-01-01T10:30:00-18:30' when 3 then '2024-01-01T10:30:00.25-00:30:15' else '' end", "x IN ('2024-01-01T10:30', '2024-01-01T10:30:00-18:30', '')"),
}
for _kind, (_text, _fails) in _kinds.items():
    told(f"told_{_kind}", "orders", "o_orderkey", _text.format("o_orderkey % 5"), getattr(s(), _kind)().message("no such time"), [(_fails, "invalid_format", f"invalid_format.{_kind}", "''", "no such time")])
_stamps = "case o_orderkey % 4 when 0 then '2024-02-29T12:30:15.25+09:00' when 1 then '1969-12-31T23:59:59-00:30' when 2 then '-0001-03-01T00:00:00Z' else '2100-03-01T00:00:01.000000001-17:59:30' end"
_values("temporal_offset_value", "orders", "o_orderkey", _stamps, s().offset_date_time().map(lambda v: F.concat_ws("/", v.epoch_second.cast("string"), v.nano.cast("string"), v.offset_second.cast("string"))), "CASE k % 4 WHEN 0 THEN '1709177415/250000000/32400' WHEN 1 THEN '1799/0/-1800' WHEN 2 THEN '-62193657600/0/0' ELSE '4107607171/1/-64770' END")
# NaN lies above all numbers and -0 below 0
_odd_double = "case k when 0 then cast('NaN' as double) when 1 then -cast(0 as double) when 2 then cast(0 as double) else cast(5 as double) end"
told("told_total_order", "part", "p_partkey", _odd_double.replace("case k", "case p_partkey % 4"), d().min(0.0).message("below"), [("k % 4 = 1", "out_of_range", "out_of_range.minimum", "'actual=-0.0;min=0.0'", "below")])
told("told_total_order_top", "part", "p_partkey", _odd_double.replace("case k", "case p_partkey % 4"), d().max(4.0), [("k % 4 = 0", "out_of_range", "out_of_range.maximum", "'actual=NaN;max=4.0'", None), ("k % 4 = 3", "out_of_range", "out_of_range.maximum", "'actual=5.0;max=4.0'", None)])
_values("decimal_java_text", "orders", "o_orderkey", "case o_orderkey % 8 when 0 then '1E+3' when 1 then '0100' when 2 then '1.20' when 3 then '-1E-7' when 4 then '0.000001' when 5 then '12E2' when 6 then '-0.00' else '1.50E1' end", s().to_decimal().map(D.to_text), "CASE k % 8 WHEN 0 THEN '1E+3' WHEN 1 THEN '100' WHEN 2 THEN '1.20' WHEN 3 THEN '-1E-7' WHEN 4 THEN '0.000001' WHEN 5 THEN '1.2E+3' WHEN 6 THEN '0.00' ELSE '15.0' END")
for _form, _made in (("NFD", "'e' || chr(769) || '①ﬁ' || p_name"), ("NFKC", "'é1fi' || p_name"), ("NFKD", "'e' || chr(769) || '1fi' || p_name")):
    check(f"string_normalize_{_form.lower()}", "part", "p_partkey", "concat('é①ﬁ', p_name)", s().normalize(_form), "false", "blank", value=_made.replace("p_name", "x[4:]"))
check("string_lower_letters", "part", "p_partkey", "concat('ÀÉÎ Ж Ω ', upper(p_name))", s().to_lower(), "false", "blank", value="'àéî ж ω ' || lower(x[9:])")
check("string_upper_letters", "part", "p_partkey", "concat('àéî ж ω ', p_name)", s().to_upper(), "false", "blank", value="'ÀÉÎ Ж Ω ' || upper(x[9:])")
check("string_trim_blank", "part", "p_partkey", "case when p_partkey % 3 = 0 then '  ' else concat(' ', p_name, '  ') end", s().trim().non_blank(), "trim(x) = ''", "blank", value="trim(x)")
check("string_uri_rejected", "part", "p_partkey", "case p_partkey % 3 when 0 then 'a b:c' when 1 then 'urn:isbn:0451450523' else 'mailto:x%4y' end", s().uri().parts(), "x <> 'urn:isbn:0451450523'", "invalid_format", "invalid_format.uri", value="'isbn:0451450523'", of=lambda v: v.path)
# lists and maps
told_array("told_list", P.list_of(n()).max_size(3).message("too many"), [("len(x) > 3", "too_big", "too_big", "'actual=' || len(x) || ';max=3'", "too many")])
told_array("told_list_missing", P.list_of(n()).contains_all(2, 9), [("true", "missing_elements", "missing_elements", "'expected=[2,9];missing=' || CASE WHEN list_contains(x, 2) THEN '[9]' ELSE '[2,9]' END", None)])
told_array("told_list_twice", P.list_of(n()).unique().message("again"), [("len(list_distinct(x)) < len(x)", "duplicate_element", "duplicate_element", "'duplicates=[' || array_to_string(list_distinct_twice, ',') || ']'", "again")])


def _twice_sql() -> str:
    """Elements by the place at which they come the second time."""
    return (
        "WITH l AS (SELECT l_orderkey AS k, l_partkey % 5 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), "
        "c AS (SELECT *, row_number() OVER (PARTITION BY k, e ORDER BY i) AS nth FROM l), t AS (SELECT k, '[' || string_agg(e::VARCHAR, ',' ORDER BY i) || ']' AS twice FROM c WHERE nth = 2 GROUP BY 1) "
        "SELECT a.k, CASE WHEN twice IS NOT NULL THEN 'duplicate_element' END AS code, CASE WHEN twice IS NOT NULL THEN 'duplicate_element' END AS message_key, 'duplicates=' || twice AS meta, "
        "CASE WHEN twice IS NOT NULL THEN 'again' END AS said, CASE WHEN twice IS NOT NULL THEN '' END AS path FROM (SELECT DISTINCT k FROM l) a LEFT JOIN t ON a.k = t.k"
    )


_add("told_list_twice", _queries["told_list_twice"], _twice_sql())


def _dict_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.map_from_entries(F.transform(F.sequence(F.lit(1), (F.col("p_size") % 4 + 1).cast("int")), lambda i: F.struct(i.cast("string"), F.col("p_size").cast("long")))).alias("x"))
    return _first(P.decode(df, P.dict_of(n()).non_empty().max_size(3).message("wide").size(2), "x").all)


_add("told_dict", _dict_sizes, _case_sql([("x > 3", "too_big", "too_big", "'actual=' || x || ';max=3'", "wide"), ("x <> 2", "invalid_size", "invalid_size", "'actual=' || x || ';expected=2'", None)], "(SELECT p_partkey AS k, p_size % 4 + 1 AS x FROM part)"))
_values("set_of_doubles", "part", "p_partkey", "array(cast(p_partkey % 1 as double) * -1, cast(0 as double), cast('NaN' as double), cast('NaN' as double), cast(p_size as double))", P.set_of(d()).map(lambda v: F.concat(F.size(v).cast("string"), F.lit("/"), F.size(F.filter(v, F.isnan)).cast("string"))), "CASE WHEN p_size = 0 THEN '3/2' ELSE '4/2' END")
_sql["set_of_doubles"] = "SELECT p_partkey AS k, CASE WHEN p_size = 0 THEN '3/2' ELSE '4/2' END AS value, 0::BIGINT AS n_issues FROM part"
# combinators that are told where they are
_events = "(SELECT event_id AS k, value AS x FROM events)"


def _of_event(name: str, decoder: P.Decoder, cases: list[Case], path: str = "") -> None:
    """Over struct(value), so that there is a path."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.struct("value", "event_type").alias("x"))
        return _first(P.decode(df, decoder, "x").all)

    _add(name, query, _case_sql(cases, _events, path))


def _at(v: Column, path: tuple) -> P.Outcome:
    return P.Outcome(v, [("one", F.when(v > 50, P.issue("high", (*path, "here"), {"depth": len(path)})))])


_of_event("and_then_with_path", P.object_of(value=d().and_then_with_path(_at)), [("x > 50", "high", "high", "'depth=1'", None)], "/value/here")
_of_event("refine_with_path", P.object_of(value=d().refine_with_path(lambda v, path: F.when(v > 50, F.array(P.issue("high", (*path, "a")), P.issue("higher", path))).otherwise(F.expr(P.plans.outcome.NO_ISSUES)))), [("x > 50", "high", "high", "''", None)], "/value/a")
_of_event("refine_meta", P.object_of(value=d().refine(lambda v: v <= 50, "high", "too high", lambda v: {"by": (v - 50).cast("int").cast("string")})), [("x > 50", "high", "high", "'by=' || trunc(x - 50)::INT", "too high")], "/value")
_of_event("new_decoder_with_path", P.object_of(value=P.new_decoder_with_path(lambda node, path: P.Outcome(node.column, [("one", F.when(node.column > 50, P.issue("high", (*path, "own"))))]))), [("x > 50", "high", "high", "''", None)], "/value/own")
_of_event("object_and_then", P.object_of(value=d(), event_type=s()).and_then(lambda v: P.Outcome(v, [("one", F.when(v.value > 50, P.issue("high", ("value",))))])), [("x > 50", "high", "high", "''", None)], "/value")
_of_event("object_flat", P.object_of(P.fields().flat(P.object_of(value=d().max(50.0)), "amount").field("event_type", s())), [("x > 50", "out_of_range", "out_of_range.maximum", "'actual=' || x::VARCHAR || ';max=50.0'", None)], "/value")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return P.decode(df, EVENT.map(lambda v: F.concat(v.event_type, F.lit("#"), v.event_id.cast("string")))).all.select("event_id", F.col("value"))


_add("object_map", _mapped, f"SELECT event_id, CASE WHEN NOT ({_type}) AND NOT {_value} THEN event_type || '#' || event_id END AS value FROM events")
_add("object_of_no_object", lambda sp, sf: P.decode(_table(sp, sf, "nation").select("n_nationkey", "n_name"), P.object_of(a=n(), b=P.optional(s())), "n_name").issues("n_nationkey").select("n_nationkey", "path", "code", meta_text(F.col("meta")).alias("meta")), "SELECT n_nationkey, '/a' AS path, 'type_mismatch' AS code, 'actual=\"string\";expected=\"object\"' AS meta FROM nation")


def _discriminate_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.struct(F.concat(F.lit(" "), F.upper("event_type")).alias("event_type"), "value").alias("event"))
    contract = P.discriminate(s().trim().to_lower(), {"click": P.object_of(value=d().max(20.0)), "view": P.object_of(value=d())}, tag_name="event_type")
    return _first(P.decode(df, contract, "event").all, F.col("value.value").alias("kept"))


_add("choice_discriminate_with", _discriminate_with, """
SELECT event_id AS k, CASE WHEN event_type NOT IN ('click', 'view') THEN 'not_allowed' WHEN event_type = 'click' AND value > 20 THEN 'out_of_range' END AS code,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'not_allowed' WHEN event_type = 'click' AND value > 20 THEN 'out_of_range.maximum' END AS message_key,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'actual="' || event_type || '";allowed=["click","view"]' WHEN event_type = 'click' AND value > 20 THEN 'actual=' || value::VARCHAR || ';max=20.0' END AS meta,
  NULL::VARCHAR AS said, CASE WHEN event_type NOT IN ('click', 'view') THEN '/event_type' WHEN event_type = 'click' AND value > 20 THEN '/value' END AS path,
  CASE WHEN event_type = 'view' OR event_type = 'click' AND value <= 20 THEN value END AS kept FROM events""")


def _one_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"))
    return _first(P.decode(df, P.one_of(n().max(10), n().min(40)), "x").all)


def _candidate(k: int, name: str, bound: str) -> str:
    return f"""{{"candidate":{k},"issues":[{{"path":[],"code":"out_of_range","message_key":"out_of_range.{name}","meta":{{"{bound}","actual":"' || x || '"}}}}]}}"""


_add("one_of_candidates", _one_of_candidates, _case_sql([("x > 10 AND x < 40", "one_of_failed", "one_of_failed", "'candidates=[" + _candidate(0, "maximum", 'max":"10') + "," + _candidate(1, "minimum", 'min":"40') + "]'", None)], "(SELECT p_partkey AS k, p_size AS x FROM part)"))


_nested = "concat('{\"name\":\"', case when event_id % 2 = 0 then ' ' else 'a' end, '\",\"child\":{\"name\":\"b\",\"child\":{\"name\":\"', case when event_id % 3 = 0 then ' ' else 'c' end, '\"}}}')"


def _recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = P.lazy(_category, 3)
    rows = P.decode_json(_table(spark, sf_dir, "events").select("event_id", F.expr(_nested).alias("t")), contract, "t").issues("event_id")
    return rows.select("event_id", "position", "path", "code")


_add("lazy_recursive", _recursive, "SELECT event_id, 0 AS position, '/name' AS path, 'blank' AS code FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, '/child/child/name', 'blank' FROM events WHERE event_id % 3 = 0")
# JSON text
_broken = "case event_id % 5 when 0 then '{{\"a\": 1,\n \"b\": 2,\n \"a\": 3}}' when 1 then '[1, 2' when 2 then '{{\"n\": 1e400}}' when 3 then '{{\"n\": 12345678901234567890123456789012345678901234567890}}' else '{{\"n\": 1.50}}' end".format()


def _json_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.expr(_broken).alias("t"))
    return _first(P.decode_json(df, P.object_of(n=P.decimal_number().map(D.to_text)), "t", lossless=True).all, F.col("value.n").alias("n"))


_add("json_lossless_places", _json_places, """
SELECT event_id AS k, CASE WHEN m < 2 THEN 'invalid_format' END AS code, CASE WHEN m < 2 THEN 'invalid_format.json' END AS message_key, CASE m WHEN 0 THEN 'column=2;line=3' WHEN 1 THEN 'column=6;line=1' WHEN 2 THEN NULL END AS meta, NULL::VARCHAR AS said, CASE WHEN m < 2 THEN '' END AS path,
  CASE m WHEN 2 THEN '1E+400' WHEN 3 THEN '12345678901234567890123456789012345678901234567890' WHEN 4 THEN '1.50' END AS n FROM (SELECT event_id, event_id % 5 AS m FROM events) q""")


def _json_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.expr(_broken).alias("t"))
    return _first(P.decode_json(df, P.object_of(n=P.decimal_number().map(D.to_text)), "t").all, F.col("value.n").alias("n"))


_add("json_fast_rounded", _json_rounded, """
SELECT event_id AS k, CASE WHEN m < 2 THEN 'invalid_format' WHEN m < 4 THEN 'type_mismatch' END AS code, CASE WHEN m < 2 THEN 'invalid_format.json' WHEN m < 4 THEN 'type_mismatch.numeric_range' END AS message_key,
  CASE WHEN m < 2 THEN '' WHEN m < 4 THEN 'expected="decimal"' END AS meta, NULL::VARCHAR AS said, CASE WHEN m < 2 THEN '' WHEN m < 4 THEN '/n' END AS path, CASE WHEN m = 4 THEN '1.5' END AS n FROM (SELECT event_id, event_id % 5 AS m FROM events) q""")
# issues
_add("render_english", lambda sp, sf: P.decode(_table(sp, sf, "events").select("event_id", "event_type", "value"), EVENT).all.where(F.size("issues") > 0).select("event_id", F.to_json(P.render(F.col("issues"))).alias("rendered")), f"""
SELECT event_id, '[' || array_to_string(list_filter([CASE WHEN {_type} THEN '{{"path":"/event_type","code":"not_allowed","message":"must be one of [click, purchase, view]","meta":{{"allowed":"[\\"click\\",\\"purchase\\",\\"view\\"]","actual":"\\"' || event_type || '\\""}}}}' END,
  CASE WHEN {_value} THEN '{{"path":"/value","code":"out_of_range","message":"must be between 1.0 and 100.0","meta":{{"min":"1.0","max":"100.0","actual":"' || value::VARCHAR || '"}}}}' END], lambda e: e IS NOT NULL), ',') || ']' AS rendered FROM events WHERE {_type} OR {_value}""")
_add("group_by_path", lambda sp, sf: P.group_by_path(_event_issues(sp, sf), "event_id").select("event_id", "path", F.array_join(F.transform("issues", lambda i: i.message_key), ",").alias("keys")), f"SELECT event_id, '/event_type' AS path, 'not_allowed' AS keys FROM events WHERE {_type} UNION ALL SELECT event_id, '/value', 'out_of_range.range' FROM events WHERE {_value}")
_add("format_tree_text", lambda sp, sf: P.decode(_table(sp, sf, "events").select("event_id", "event_type", "value"), EVENT).all.select("event_id", P.format_tree(F.col("issues")).alias("tree")), f"""
SELECT event_id, '{{' || array_to_string(list_filter([CASE WHEN {_type} THEN '"event_type":{{"_errors":["must be one of [click, purchase, view]"]}}' END, CASE WHEN {_value} THEN '"value":{{"_errors":["must be between 1.0 and 100.0"]}}' END], lambda e: e IS NOT NULL), ',') || '}}' AS tree FROM events""")
_add("error_text", lambda sp, sf: P.decode(_table(sp, sf, "events").select("event_id", "event_type", "value"), EVENT).all.select("event_id", P.error_text(F.col("issues")).alias("told")), f"""
SELECT event_id, array_to_string(list_filter([CASE WHEN {_type} THEN '/event_type: must be one of [click, purchase, view]' END, CASE WHEN {_value} THEN '/value: must be between 1.0 and 100.0' END], lambda e: e IS NOT NULL), chr(10)) AS told FROM events""")
_add("resolver_function", lambda sp, sf: _event_issues(sp, sf).select("event_id", "position", I.resolved(F.col("issue"), lambda i: F.concat(F.upper(i.code), F.lit("!"))).alias("message")), f"SELECT event_id, 0 AS position, 'NOT_ALLOWED!' AS message FROM events WHERE {_type} UNION ALL SELECT event_id, CASE WHEN {_type} THEN 1 ELSE 0 END, 'OUT_OF_RANGE!' FROM events WHERE {_value}")
_OWN = P.Messages.of(P.parse_properties("# own wording\nout_of_range.range : from {min} \\\n   up to {max}\nnot\\_allowed = \\u00bfwhat?\n")).falling_back_to(P.ENGLISH)
_add("messages_of_properties", lambda sp, sf: _event_issues(sp, sf).select("event_id", "position", I.resolved(F.col("issue"), _OWN).alias("message")), f"SELECT event_id, 0 AS position, '¿what?' AS message FROM events WHERE {_type} UNION ALL SELECT event_id, CASE WHEN {_type} THEN 1 ELSE 0 END, 'from 1.0 up to 100.0' FROM events WHERE {_value}")
# every template in both languages, with one entry for all of its names
_KEYS = [k for k in P.ENGLISH.templates()]


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("min", "max", "actual", "expected", "before", "after", "from", "to", "divisor", "maxScale", "missing", "duplicates", "allowed", "prefix", "suffix", "substring")
    made = F.array(*(P.issue(k.split(".")[0], (), dict.fromkeys(names, 7), k) for k in _KEYS))
    rows = _table(spark, sf_dir, "region").select("r_regionkey", F.explode(made).alias("issue"))
    return rows.select("r_regionkey", F.col("issue.message_key").alias("key"), I.resolved(F.col("issue")).alias("english"), I.resolved(F.col("issue"), P.JAPANESE).alias("japanese"))


def _catalogue_sql() -> str:
    from sparkpact.functions.catalogue import PLACE

    text = lambda t: "'" + PLACE.sub("7", t).replace("'", "''") + "'"
    japanese = P.JAPANESE.templates()
    rows = ", ".join(f"('{k}', {text(t)}, {text(japanese[k])})" for k, t in P.ENGLISH.templates().items())
    return f"SELECT r_regionkey, key, english, japanese FROM region, (VALUES {rows}) t(key, english, japanese)"


_add("catalogue_templates", _catalogue, _catalogue_sql())


def _made_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues made by hand, changed, joined and moved."""
    one = I.with_message(I.with_meta(I.with_key(I.at(P.issue("odd", ()), "a", "b"), "odd.key"), "size", F.col("p_size").cast("string")), "an odd one")
    two = I.with_meta(I.with_meta(P.issue("even", ("c",)), "n", 1), "n", 2)
    made = I.rebase(I.merge(I.add(F.expr(P.plans.outcome.NO_ISSUES), one), F.array(two)), "root")
    rows = _table(spark, sf_dir, "part").select("p_partkey", made.alias("issues"))
    return I.explode_issues(rows, "issues", "p_partkey").select("p_partkey", "position", "path", "code", "message_key", meta_text(F.col("meta")).alias("meta"), F.col("issue.custom_message").alias("said"))


_add("issues_by_hand", _made_issues, "SELECT p_partkey, 0 AS position, '/root/a/b' AS path, 'odd' AS code, 'odd.key' AS message_key, 'size=' || p_size AS meta, 'an odd one' AS said FROM part UNION ALL SELECT p_partkey, 1, '/root/c', 'even', 'even', 'n=2', NULL FROM part")
_add("outcome_invalid", lambda sp, sf: P.decode(_table(sp, sf, "part").select("p_partkey", "p_size"), n().and_then(lambda v: P.Outcome(F.when(v <= 25, v), [("many", F.when(v > 25, F.array(P.issue("big", ()), P.issue("bigger", ("x",)))).otherwise(F.expr(P.plans.outcome.NO_ISSUES)))])), "p_size").issues("p_partkey").select("p_partkey", "position", "path", "code"), "SELECT p_partkey, 0 AS position, '' AS path, 'big' AS code FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 1, '/x', 'bigger' FROM part WHERE p_size > 25")
# encoders
_encoded = E.object_of(
    E.property("key", lambda v: v.k, E.integer.contramap(lambda k: k * 2)), E.property("price", lambda v: D.parse(v.price), E.decimal), E.property("id", lambda v: v.uuid, E.uuid), E.property("url", lambda v: v.url, E.url.and_then(F.upper)),
    E.presence_property("note", lambda v: v.note), E.property("tags", lambda v: v.tags, E.dict_of(E.integer)),
)


def _encode_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, "absent").when(k % 3 == 1, "null").otherwise("present")
    row = F.struct(
        k.alias("k"), F.concat(k.cast("string"), F.lit(".50")).alias("price"), F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8").alias("uuid"), F.lit("http://a.example/x").alias("url"),
        F.struct(state.alias("state"), F.col("o_orderstatus").alias("value")).alias("note"), F.create_map(F.lit("b"), k, F.lit("a"), F.lit(None).cast("long")).alias("tags"),
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", _encoded.encode(row).alias("json"))


_add("encode_more", _encode_more, """SELECT o_orderkey, '{"key":' || o_orderkey * 2 || ',"price":' || o_orderkey || '.50,"id":"6ba7b810-9dad-11d1-80b4-00c04fd430c8","url":"HTTP://A.EXAMPLE/X"' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"note":null' ELSE ',"note":"' || o_orderstatus || '"' END || ',"tags":{"b":' || o_orderkey || ',"a":null}}' AS json FROM orders""")


def _encode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpact.operators.temporal import parse

    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case o_orderkey % 3 when 0 then '2024-02-29T12:30:15.250+09:00' when 1 then '1969-12-31T00:00:59-00:30' else '+10000-03-01T00:00Z' end").alias("t"))
    v = parse(F.col("t"), "offset_date_time")
    clock = parse(F.expr("case o_orderkey % 3 when 0 then '12:30:15.000001' when 1 then '00:00' else '23:59:59' end"), "time")
    moment = F.struct(v.epoch_second.alias("epoch_second"), v.nano.alias("nano"))
    return df.select("o_orderkey", E.offset_date_time.encode(v).alias("offset"), E.instant.encode(moment).alias("instant"), E.time.encode(clock).alias("time"), E.date_time.encode(F.struct(F.lit(0).cast("long").alias("epoch_day"), clock.nano_of_day.alias("nano_of_day"))).alias("date_time"))


_add("encode_times", _encode_times, """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '"2024-02-29T12:30:15.250+09:00"' WHEN 1 THEN '"1969-12-31T00:00:59-00:30"' ELSE '"+10000-03-01T00:00Z"' END AS "offset",
  CASE o_orderkey % 3 WHEN 0 THEN '"2024-02-29T03:30:15.250Z"' WHEN 1 THEN '"1969-12-31T00:30:59Z"' ELSE '"+10000-03-01T00:00:00Z"' END AS instant,
  CASE o_orderkey % 3 WHEN 0 THEN '"12:30:15.000001"' WHEN 1 THEN '"00:00"' ELSE '"23:59:59"' END AS time, CASE o_orderkey % 3 WHEN 0 THEN '"1970-01-01T12:30:15.000001"' WHEN 1 THEN '"1970-01-01T00:00"' ELSE '"1970-01-01T23:59:59"' END AS date_time FROM orders""")


def _node(depth: int) -> T.DataType:
    fields = [T.StructField("name", T.StringType())]
    return T.StructType([*fields, T.StructField("child", _node(depth - 1))]) if depth else T.StructType(fields)


def _encode_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.struct(F.col("n_name").alias("name"))
    middle = F.struct(F.lit("b").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, leaf).alias("child"))
    tree = F.struct(F.lit("a").alias("name"), middle.alias("child"))

    def category(depth: int = 2) -> E.Encoder:
        own = [E.property("name", lambda v: v["name"])]
        return E.object_of(*own, E.optional_property("child", lambda v: v["child"], E.lazy(lambda: category(depth - 1)))) if depth else E.object_of(*own)

    return _table(spark, sf_dir, "nation").select("n_nationkey", category().encode(tree).alias("json"))


_add("encode_lazy", _encode_recursive, """SELECT n_nationkey, '{"name":"a","child":{"name":"b"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"child":{"name":"' || n_name || '"}' ELSE '' END || '}}' AS json FROM nation""")
