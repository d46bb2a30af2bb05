"""What a compiled decoder yields: a value column and issue columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<path:array<string>,code:string,message_key:string,meta:map<string,string>,custom_message:string,by_strict:boolean>"
NO_ISSUES = f"cast(array() as array<{ISSUE}>)"
Path = tuple  # of str and Column segments


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def path_column(path: Path) -> Column:
    if not path:
        return F.expr("cast(array() as array<string>)")
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in path))


@dataclass(frozen=True)
class Raw:
    """JSON text given as such, for numbers that keep their digits."""

    text: str


def json_text(value) -> Column:
    """JSON text of a Python value (at plan time) or of a column."""
    if isinstance(value, Raw):
        return F.lit(value.text)
    if isinstance(value, Column):
        text = F.to_json(F.array(value))
        return F.substring(text, F.lit(2), F.length(text) - 2)
    return F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def issue(code: str, path: Path, meta: dict | None = None, key: str | None = None, message: str | None = None, by_strict: bool = False) -> Column:
    """An issue; metadata entries are Python values or columns of JSON text."""
    entries = [x for k, v in (meta or {}).items() for x in (F.lit(k), v if isinstance(v, Column) else json_text(v))]
    metas = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    return F.struct(
        path_column(path).alias("path"), F.lit(code).alias("code"), F.lit(key or code).alias("message_key"), metas.alias("meta"),
        F.lit(message).cast("string").alias("custom_message"), F.lit(by_strict).alias("by_strict"),
    ).cast(ISSUE)


#: The code of what stands for the issues of a node that is decoded later (see plans.trees).
PENDING = "\0pending"
_deferred: ContextVar = ContextVar("deferred", default=None)


@contextmanager
def deferring(nodes):
    """Within, lazy decoders leave their node to `nodes`, and what they leave is no failure."""
    token = _deferred.set(nodes)
    try:
        yield
    finally:
        _deferred.reset(token)


def deferred():
    return _deferred.get()


def _fails(one: Column) -> Column:
    return one.isNotNull() if deferred() is None else one.isNotNull() & ~one.getField("code").eqNullSafe(PENDING)


def settled(issues: Column) -> Column:
    """Whether nothing failed."""
    return F.size(issues) == 0 if deferred() is None else ~F.exists(issues, lambda i: i.getField("code") != PENDING)


@dataclass(frozen=True)
class Outcome:
    """`value` is null wherever there is an issue. `parts` are issues in order: ("one", column or null)
    or ("many", array column). `whole` is both as one struct, for outcomes that come from one. `light`: of a scalar,
    so that naming it twice costs less than binding it."""

    value: Column
    parts: list[tuple[str, Column]] = field(default_factory=list)
    whole: Column | None = None
    light: bool = False

    def issues(self) -> Column:
        groups: list[Column] = []
        ones: list[Column] = []
        for kind, c in [*self.parts, ("end", None)]:
            if kind == "one":
                ones.append(c)
                continue
            if ones:
                groups.append(F.filter(F.array(*ones), lambda x: x.isNotNull()))
                ones = []
            if kind == "many":
                groups.append(c)
        if not groups:
            return F.expr(NO_ISSUES)
        return groups[0] if len(groups) == 1 else F.concat(*groups)

    def failed(self) -> Column:
        made = F.lit(False)
        for k, (kind, c) in enumerate(self.parts):
            bad = _fails(c) if kind == "one" else ~settled(c)
            made = bad if not k else made | bad
        return made

    def packed(self) -> Column:
        if self.whole is not None:
            return self.whole
        return F.struct(self.value.alias("value"), self.issues().alias("issues"))


def unpacked(packed: Column) -> Outcome:
    return Outcome(packed.getField("value"), [("many", packed.getField("issues"))], packed)


#: Issues of the alternatives of one_of, as its metadata holds them; alternatives of alternatives to this depth.
CANDIDATES = "array<struct<candidate:int,issues:array<struct<path:array<string>,code:string,message_key:string,meta:map<string,string>,custom_message:string>>>>"
MOST_NESTED = 2


def of_candidates(i: Column, f: Callable[[Column, int], Column], nested: int = MOST_NESTED) -> Column:
    """An issue's metadata in which `f` (of an issue and of how far its own candidates go) has been put on the
    issues of all candidates."""
    meta = i.getField("meta")
    if not nested:
        return meta
    read = F.from_json(F.try_element_at(meta, F.lit("candidates")), CANDIDATES)
    made = F.to_json(F.transform(read, lambda c: F.struct(c.getField("candidate").alias("candidate"), F.transform(c.getField("issues"), lambda j: f(j, nested - 1)).alias("issues"))))
    return F.when(i.getField("code") == "one_of_failed", F.transform_values(meta, lambda k, v: F.when(k == "candidates", F.coalesce(made, v)).otherwise(v))).otherwise(meta)


def moved(i: Column, prefix: Column, nested: int = MOST_NESTED) -> Column:
    """An issue under a path, and those of its candidates with it."""
    meta = of_candidates(i, lambda j, n: moved(j, prefix, n), nested)
    return i.withField("path", F.concat(prefix, i.getField("path"))).withField("meta", meta)


def accepted(value: Column) -> Column:
    return F.struct(value.alias("value"), F.expr(NO_ISSUES).alias("issues"))


def rejected(issues: Column) -> Column:
    return F.struct(F.lit(None).alias("value"), issues.alias("issues"))


_unbound: ContextVar[bool] = ContextVar("unbound", default=False)


@contextmanager
def unbound():
    """Within, outcomes are not bound: functions that run in Python cannot stand in a lambda."""
    token = _unbound.set(True)
    try:
        yield
    finally:
        _unbound.reset(token)


def binding() -> bool:
    return not _unbound.get()


def binds(own: Outcome) -> bool:
    return binding() and not own.light


def bound(own: Outcome, body: Callable[[Outcome], Outcome]) -> Outcome:
    """`body` of an outcome that is evaluated once and stands in the plan once, however often its value and
    issues are named: chains of steps give plans that grow with their number."""
    if not binds(own):
        return body(own)
    return unpacked(let(own.packed(), lambda p: body(unpacked(p)).packed()))
