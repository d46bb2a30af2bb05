"""Encoders: typed columns back to JSON text. An encoder is a function of a column to JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import decimals
from ..plans.outcome import json_text, let
from ..sources.nodes import shortest
from . import temporal
from .core import refuse, unrolled


class Encoder:
    def __init__(self, run: Callable[[Column], Column]):
        self.encode = run

    def contramap(self, f: Callable[[Column], Column]) -> Encoder:
        """Encodes what `f` makes of the value."""
        return Encoder(lambda v: self.encode(f(v)))

    def and_then(self, f: Callable[[Column], Column]) -> Encoder:
        """Changes the JSON text."""
        return Encoder(lambda v: f(self.encode(v)))

    def value(self, v: Column) -> Column:
        return self.encode(v)


identity = Encoder(json_text)
string = integer = int32 = int64 = uint = uint32 = uint64 = boolean = uuid = uri = url = identity


def _number(v: Column, kind: str) -> Column:
    """JSON has no text for NaN and the infinities: such a value is an error of the program."""
    endless = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(endless, F.raise_error(F.concat(F.lit("no JSON number for "), v.cast("string"))).cast("string")).otherwise(shortest(v, kind))


float64 = Encoder(lambda v: _number(v, "double"))
float32 = Encoder(lambda v: _number(v, "float"))
decimal = Encoder(lambda v: let(v, decimals.to_text))


def _text(kind: str) -> Encoder:
    return Encoder(lambda v: json_text(temporal.to_text(v, kind)))


instant, date, time, date_time, offset_date_time = map(_text, ("instant", "date", "time", "date_time", "offset_date_time"))


def enum_of(names: dict[str, object]) -> Encoder:
    """A value to its name; a value without one is an error of the program and fails the job."""
    refuse(len(set(names.values())) < len(names), "two names have one value")
    table = [x for k, v in names.items() for x in (F.lit(v), F.lit(k))]

    def run(v: Column) -> Column:
        found = F.try_element_at(F.create_map(*table), v)
        return json_text(F.coalesce(found, F.raise_error(F.concat(F.lit("no name for "), v.cast("string"))).cast("string")))

    return Encoder(run)


class Entry:
    """A member of an object: its key and how it is written; null text leaves it out."""

    def __init__(self, key: str, write: Callable[[Column], Column]):
        self.key, self.write = key, write


def _key(key: str) -> Column:
    return F.concat(json_text(key), F.lit(":"))


def property(key: str, get: Callable[[Column], Column], e: Encoder = identity) -> Entry:
    return Entry(key, lambda v: F.concat(_key(key), e.encode(get(v))))


def nullable_property(key: str, get, e: Encoder = identity) -> Entry:
    return Entry(key, lambda v: F.concat(_key(key), let(get(v), lambda x: F.coalesce(F.when(x.isNotNull(), e.encode(x)), F.lit("null")))))


def optional_property(key: str, get, e: Encoder = identity) -> Entry:
    return Entry(key, lambda v: F.concat(_key(key), let(get(v), lambda x: F.when(x.isNotNull(), e.encode(x)))))


def property_with_default(key: str, get, default, e: Encoder = identity) -> Entry:
    other = default if callable(default) and not isinstance(default, Column) else lambda: default
    return property(key, lambda v: F.coalesce(get(v), other() if isinstance(other(), Column) else F.lit(other())), e)


def presence_property(key: str, get, e: Encoder = identity) -> Entry:
    def write(v: Column) -> Column:
        return let(get(v), lambda p: F.when(p.getField("state") == "null", F.concat(_key(key), F.lit("null"))).when(p.getField("state") == "present", F.concat(_key(key), e.encode(p.getField("value")))))

    return Entry(key, write)


def _braces(parts: list[Column]) -> Column:
    made = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.expr("cast(array() as array<string>)")
    return F.concat(F.lit("{"), F.array_join(made, ","), F.lit("}"))


class ObjectEncoder(Encoder):
    def __init__(self, entries: tuple[Entry, ...]):
        refuse(len({e.key for e in entries}) < len(entries), "two entries have one key")
        self.entries = entries
        super().__init__(lambda v: _braces([e.write(v) for e in entries]))


def object_of(*entries: Entry) -> ObjectEncoder:
    return ObjectEncoder(entries)


def list_of(e: Encoder) -> Encoder:
    return Encoder(lambda v: F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.coalesce(e.encode(x), F.lit("null"))), ","), F.lit("]")))


def dict_of(e: Encoder) -> Encoder:
    """Members in the map's order."""
    one = lambda kv: F.concat(json_text(kv.getField("key")), F.lit(":"), F.coalesce(e.encode(kv.getField("value")), F.lit("null")))
    return Encoder(lambda v: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(v), one), ","), F.lit("}")))


def lazy(make: Callable[[], Encoder], max_depth: int = 8) -> Encoder:
    """An encoder that refers to itself, unrolled to `max_depth`. A value that goes on below is an error of
    the program and fails the job, as nothing may be left out. In `encode_tree`, at any depth, it writes
    the text of the node that a reference stands for."""
    from ..plans.issues import pointer
    from ..plans.trees import children

    def run(v: Column) -> Column:
        if children() is not None:
            return F.when(v.isNotNull(), F.try_element_at(children(), pointer(v.getField("ref"))))
        with unrolled(make) as depth:
            if depth >= max_depth:
                return F.when(v.isNotNull(), F.raise_error(F.lit(f"a value goes deeper than {max_depth} levels")).cast("string"))
            return make().encode(v)

    return Encoder(run)


def discriminate(tag: str, of: Callable[[Column], Column], variants: dict[str, ObjectEncoder]) -> Encoder:
    """The tag first, then the members of the variant that `of` names; one named like the tag is left out."""
    refuse(not variants, "a variant is needed")

    def run(v: Column) -> Column:
        made = None
        for name, e in variants.items():
            parts = [F.concat(_key(tag), json_text(name)), *(x.write(v) for x in e.entries if x.key != tag)]
            made = F.when(of(v) == name, _braces(parts)) if made is None else made.when(of(v) == name, _braces(parts))
        return made.otherwise(F.raise_error(F.concat(F.lit("no variant for "), of(v).cast("string"))).cast("string"))

    return Encoder(run)
