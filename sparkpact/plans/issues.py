"""What is done with issues: rendering, grouping, trees."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import ENGLISH, PLACE, Messages, meta_value
from .outcome import ISSUE, MOST_NESTED, let, moved, of_candidates


def pointer(path: Column) -> Column:
    """A path as JSON Pointer text; the root is empty."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.lit("/"), F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))), "")


def displayed(value: Column) -> Column:
    """JSON text of a metadata entry as messages write it."""
    items = F.from_json(value, "array<string>")
    plain = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    return F.when(value.startswith("["), F.concat(F.lit("["), F.array_join(items, ", ", "null"), F.lit("]"))).when(value.startswith('"'), plain).otherwise(value)


Resolver = Messages | Callable[[Column], Column]


def _split(template: str) -> list[tuple[str | None, str]]:
    """(name, text as written) of each {name}, (None, text) of what lies between."""
    pieces = re.split(r"(\{[A-Za-z_][A-Za-z0-9_.-]*\})", template)
    return [(p[1:-1], p) if PLACE.fullmatch(p) else (None, p) for p in pieces if p] or [(None, "")]


def _piece(name: str | None, text: str) -> Column:
    return F.struct(F.lit(name).cast("string").alias("name"), F.lit(text).alias("text"))


def template_maps(messages: Messages) -> list[Column]:
    """The layers of a catalogue as literal maps of templates in pieces."""
    return [F.create_map(*(x for k, t in layer.items() for x in (F.lit(k), F.array(*(_piece(*p) for p in _split(t)))))) for layer in messages.layers if layer]


def resolved(issue: Column, messages: Resolver = ENGLISH, maps: list[Column] | None = None) -> Column:
    """An issue's message: its own, or what `messages` says, a catalogue or a function of the issue.

    A catalogue is looked up by key and code, in `maps` where a caller has made them already."""
    own = issue.getField("custom_message")
    if not isinstance(messages, Messages):
        return F.coalesce(own, messages(issue))
    meta = issue.getField("meta")

    def filled(pieces: Column) -> Column:
        name = lambda p: p.getField("name")
        has = F.forall(pieces, lambda p: name(p).isNull() | F.coalesce(F.map_contains_key(meta, name(p)), F.lit(False)))
        made = F.transform(pieces, lambda p: F.when(name(p).isNull(), p.getField("text")).otherwise(F.coalesce(displayed(F.try_element_at(meta, name(p))), F.lit("null"))))
        return F.when(has, F.array_join(made, ""))

    tries = [own]
    for table in template_maps(messages) if maps is None else maps:
        tries += [let(F.try_element_at(table, issue.getField(on)), filled) for on in ("message_key", "code")]
    return F.coalesce(*tries, F.concat(F.lit("validation failed: "), issue.getField("code")))


def explode_issues(df: DataFrame, issues: str = "issues", *keys: str) -> DataFrame:
    """A row per issue: the keys, position, path (pointer), code, message_key, meta and the issue itself."""
    rows = df.select(*keys, F.posexplode(issues).alias("position", "issue"))
    return rows.select(*keys, "position", *(e.alias(n) for n, e in issue_columns(F.col("issue")).items()), "issue")


def issue_columns(i: Column) -> dict[str, Column]:
    return {"path": pointer(i.path), "code": i.code, "message_key": i.message_key, "meta": i.meta}


def render(issues: Column, messages: Resolver = ENGLISH, nested: int = MOST_NESTED) -> Column:
    """array<struct<path, code, message, meta>>. The issues of a one_of's candidates are rendered with it, and
    candidates of candidates to a depth of `nested`."""
    maps = template_maps(messages) if isinstance(messages, Messages) else None

    def one(i: Column, further: int) -> Column:
        meta = of_candidates(i, one, further)
        return F.struct(pointer(i.getField("path")).alias("path"), i.getField("code").alias("code"), resolved(i, messages, maps).alias("message"), meta.alias("meta"))

    return F.transform(issues, lambda i: one(i, nested))


def flatten(rows: DataFrame, *keys: str, messages: Resolver = ENGLISH) -> DataFrame:
    """Messages by path, in order, from exploded issues."""
    told = rows.withColumn("message", resolved(F.col("issue"), messages))
    in_order = F.array_sort(F.collect_list(F.struct("position", "message")))
    return told.groupBy(*keys, "path").agg(F.transform(in_order, lambda x: x.message).alias("messages"))


def group_by_path(rows: DataFrame, *keys: str) -> DataFrame:
    """Issues by path, in order, from exploded issues."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "code", "message_key")))
    return rows.groupBy(*keys, "path").agg(F.transform(ordered, lambda x: F.struct(x.code.alias("code"), x.message_key.alias("message_key"))).alias("issues"))


def error_text(issues: Column) -> Column:
    """One line per issue for a log: nothing from the input can make a line of its own."""
    def safe(c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for raw, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x00", "\\x00"), ("\x1b", "\\x1b")):
            c = F.replace(c, F.lit(raw), F.lit(written))
        return F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}]", "?")

    def line(i: Column) -> Column:
        at = pointer(i.path)
        return F.concat(safe(F.when(at == "", "(root)").otherwise(at)), F.lit(": "), safe(resolved(i)))

    return F.array_join(F.transform(issues, line), "\n")


def add(issues: Column, *more: Column) -> Column:
    return F.concat(issues, F.array(*(m.cast(ISSUE) for m in more)))


def merge(*issues: Column) -> Column:
    return F.concat(*issues)


def rebase(issues: Column, *segments: str, nested: int = MOST_NESTED) -> Column:
    """Issues under a path, and their candidates with them to a depth of `nested`."""
    prefix = F.array(*map(F.lit, segments)) if segments else F.expr("cast(array() as array<string>)")
    return F.transform(issues, lambda i: moved(i, prefix, nested))


def with_key(i: Column, key: str) -> Column:
    return i.withField("message_key", F.lit(key))


def with_meta(i: Column, name: str, value) -> Column:
    text = value if isinstance(value, Column) else F.lit(json.dumps(value))
    return i.withField("meta", F.map_concat(F.map_filter(i.meta, lambda k, v: k != name), F.create_map(F.lit(name), text)))


def with_message(i: Column, text: str) -> Column:
    return i.withField("custom_message", F.lit(text))


def at(i: Column, *segments: str) -> Column:
    return i.withField("path", F.array(*map(F.lit, segments)))


def tree(rendered) -> str:
    """Rendered issues of one row as a nested tree with the messages under `_errors`."""
    root: dict = {}
    for path, message in rendered:
        node = root
        for seg in path:
            if not isinstance(node.get(seg), dict):
                node[seg] = {}
            node = node[seg]
        node["_errors"] = [*(node["_errors"] if isinstance(node.get("_errors"), list) else []), message]
    return json.dumps(root, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def format_tree(issues: Column, messages: Resolver = ENGLISH) -> Column:
    """JSON text of the tree; its shape follows the data, so one Arrow-batched function makes it, which also
    finds the messages of a catalogue."""
    import pandas as pd

    def said(r) -> str:
        if r.get("message") is not None:
            return r["message"]
        if r["custom_message"] is not None:
            return r["custom_message"]
        return messages.resolve(r["code"], r["message_key"], {k: meta_value(v) for k, v in dict(r["meta"]).items()})

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: tree([(list(r["path"]), said(r)) for r in rows]), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    if not isinstance(messages, Messages):
        issues = F.transform(issues, lambda i: F.struct(i.path.alias("path"), resolved(i, messages).alias("message")))
    return F.pandas_udf(run, "string")(issues)


__all__ = [n for n in dir() if not n.startswith("_")]
