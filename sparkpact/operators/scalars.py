"""Scalar decoders: strings, integers, floats, decimals, booleans, bytes."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterable
from decimal import Decimal as Exact

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import decimals as D
from ..functions import grammar as G
from ..functions.patterns import matcher
from ..plans.outcome import Outcome, Path, Raw, binding, issue, json_text, let, unpacked
from ..sources.nodes import Node, Typed, shortest
from .core import Decoder, refuse


class Scalar(Decoder):
    """A read, then steps in written order: the first failing check wins, transforms cannot fail."""

    def __init__(self, read: Callable, steps: tuple = ()):
        self._read, self._steps, self._base_message = read, steps, None

    def _copy(self, kind: type | None = None):
        new = copy.copy(self)
        if kind:
            new.__class__ = kind
        return new

    def _check(self, ok: Callable[[Column], Column], code: str, meta: Callable[[Column], dict] | dict | None = None, key: str | None = None, joint: bool = False):
        """`joint`: part of the check before, with which it shares the message."""
        new = self._copy()
        new._steps = (*self._steps, ("check", ok, code, meta, key, None, joint))
        return new

    def _change(self, f: Callable[[Column], Column], kind: type | None = None, once: bool = False):
        """`once`: bound, so that it is evaluated once however many steps read it; it may give null, for a check that follows."""
        new = self._copy(kind)
        new._steps = (*self._steps, ("once" if once else "change", f))
        return new

    def message(self, text: str):
        """The message of the last check; before any, that of the type check."""
        new = self._copy()
        steps = list(self._steps)
        for k in range(len(steps) - 1, -1, -1):
            if steps[k][0] == "check":
                steps[k] = (*steps[k][:5], text, steps[k][6])
                if not steps[k][6]:
                    new._steps = tuple(steps)
                    return new
        new._base_message = text
        return new

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        value, guards = self._read(node)
        own = self._base_message
        bad = F.when(node.absent(), issue("required", path, message=own))
        for condition, code, meta, key in guards:
            bad = bad.when(condition, issue(code, path, meta, key, own))
        return self._chain(value, bad, self._steps, node.bind, path)

    def _chain(self, value: Column, bad: Column, steps: tuple, bind: bool, path: Path) -> Outcome:
        for k, step in enumerate(steps):
            if step[0] == "once" and binding():
                held = F.struct(step[1](value).alias("value"), bad.alias("bad"))
                after = lambda p: self._chain(p.getField("value"), F.when(p.getField("bad").isNotNull(), p.getField("bad")), steps[k + 1 :], True, path)  # noqa: B023, E731
                return unpacked(let(held, lambda p: after(p).packed()))
            if step[0] != "check":
                value = step[1](value)
                continue
            _, ok, code, meta, key, text, _ = step
            bad = bad.when(~F.coalesce(ok(value), F.lit(False)), issue(code, path, meta(value) if callable(meta) else meta, key, text))
        # a check says more than that there is a value, so the chain alone decides
        whole = None
        if bind:  # interpreted anyway: the chain runs once
            whole = let(bad, lambda b: F.struct(F.when(b.isNull(), value).alias("value"), F.filter(F.array(b), lambda x: x.isNotNull()).alias("issues")))
        return Outcome(F.when(bad.isNull(), value), [("one", bad)], whole, light=whole is None)


def mismatch(node: Node, ok: Column, expected: str, actual: bool = True) -> tuple:
    meta = {"expected": expected} | ({"actual": json_text(node.kind)} if actual else {})
    return ~F.coalesce(ok, F.lit(False)), "type_mismatch", meta, None


def sorted_allowed(values: Iterable, key=None) -> list:
    found = list(values)
    refuse(not found, "one_of needs a value")
    made = sorted(found, key=key)
    refuse(any((key(a) if key else a) == (key(b) if key else b) for a, b in zip(made, made[1:])), "a value is given twice")
    return made


def size_of(n: int) -> int:
    refuse(n < 0, "a size cannot be negative")
    return n


# strings


class String(Scalar):
    def trim(self):
        return self._change(lambda v: F.btrim(v, F.lit(G.SPACES)))

    def to_lower(self):
        return self._change(F.lower)

    def to_upper(self):
        return self._change(F.upper)

    def normalize(self, form: str = "NFC"):
        refuse(form not in ("NFC", "NFD", "NFKC", "NFKD"), "no such normal form")
        return self._change(lambda v: normaliser(form)(v))

    def non_blank(self):
        return self._check(lambda v: v.rlike(G.NOT_SPACE), "blank")

    def min_length(self, n: int):
        size_of(n)
        return self._check(lambda v: F.length(v) >= n, "too_short", lambda v: {"min": n, "actual": json_text(F.length(v))})

    def max_length(self, n: int):
        size_of(n)
        return self._check(lambda v: F.length(v) <= n, "too_long", lambda v: {"max": n, "actual": json_text(F.length(v))})

    def length(self, n: int):
        size_of(n)
        return self._check(lambda v: F.length(v) == n, "invalid_length", lambda v: {"expected": n, "actual": json_text(F.length(v))})

    def starts_with(self, text: str):
        return self._check(lambda v: v.startswith(text), "invalid_format", {"prefix": text}, "invalid_format.starts_with")

    def ends_with(self, text: str):
        return self._check(lambda v: v.endswith(text), "invalid_format", {"suffix": text}, "invalid_format.ends_with")

    def contains(self, text: str):
        return self._check(lambda v: v.contains(text), "invalid_format", {"substring": text}, "invalid_format.includes")

    def one_of(self, *values: str):
        allowed = sorted_allowed(values)
        return self._check(lambda v: v.isin(allowed), "not_allowed", lambda v: {"allowed": allowed, "actual": json_text(v)})

    def _format(self, name: str, grammar: str):
        return self._check(lambda v: v.rlike(grammar), "invalid_format", None, f"invalid_format.{name}")

    def email(self):
        return self._format("email", G.EMAIL)

    def ipv4(self):
        return self._format("ipv4", G.IPV4)

    def ipv6(self):
        return self._format("ipv6", G.IPV6)

    def ip(self):
        return self._format("ip", G.IP)

    def ulid(self):
        return self._format("ulid", G.ULID)

    def cuid(self):
        return self._format("cuid", G.CUID)

    def pattern(self, pattern: str):
        """The whole text, in time linear in it whatever the pattern."""
        return self._check(matcher(pattern), "invalid_format", {"pattern": pattern})

    # conversions
    def uuid(self):
        return self._format("uuid", G.UUID)._change(F.lower, Scalar)

    def uri(self):
        return self._format("uri", G.URI)._change(lambda v: v, Uri)

    def url(self):
        return self._format("url", G.URL)._change(lambda v: v, Uri)

    def _to_int(self, bits: int, name: str):
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        number = lambda v: F.when(v.rlike(G.INTEGER), F.when(F.length(D.bare(v)) <= 20, D.bare(v)).try_cast("decimal(38,0)"))
        ok = lambda v: number(v).between(low, high)
        made = self._check(lambda v: v.rlike(G.INTEGER), "type_mismatch", {"expected": name})
        made = made._check(ok, "type_mismatch", {"expected": name}, "type_mismatch.numeric_range", joint=True)
        return made._change(lambda v: F.when(ok(v), number(v)).cast("int" if bits == 32 else "long"), Int)

    def to_int(self):
        return self._to_int(32, "integer")

    def to_long(self):
        return self._to_int(64, "long")

    def to_decimal(self):
        return self._change(D.parse, Decimal, once=True)._check(lambda v: v.isNotNull(), "type_mismatch", {"expected": "decimal"})

    def to_bool(self):
        folded = lambda v: F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        yes, no = ["true", "1", "yes", "on"], ["false", "0", "no", "off"]
        made = self._check(lambda v: folded(v).isin(yes + no), "type_mismatch", {"expected": "boolean"})
        return made._change(lambda v: F.when(folded(v).isin(yes), True).when(folded(v).isin(no), False), Bool)

    def _temporal(self, kind):
        from . import temporal

        return temporal.conversion(self, kind)

    def date(self):
        return self._temporal("date")

    def time(self):
        return self._temporal("time")

    def date_time(self):
        return self._temporal("date_time")

    def instant(self):
        return self._temporal("instant")

    def offset_date_time(self):
        return self._temporal("offset_date_time")


def normaliser(form: str) -> Callable[[Column], Column]:
    """Unicode normal forms have no function in SQL, but the library that Spark collates with has."""
    step, compatible = "compose" if form.endswith("C") else "decompose", "K" in form
    return lambda v: F.when(v.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(step), F.coalesce(v, F.lit("")), F.lit(compatible)))


class Uri(Scalar):
    """A URI as written, with its parts; a part that is absent is null, an empty one is ''."""

    def parts(self):
        return self._change(uri_parts, Scalar)


def uri_parts(v: Column) -> Column:
    def part(g: int) -> Column:
        found = F.regexp_extract(v, G.URI, g)
        return found

    has = lambda p: F.regexp_extract(v, r"\A[^?#]*" + p, 0) != ""
    authority = v.rlike(r"\A[^:/?#]+://")
    return F.struct(
        part(1).alias("scheme"), F.when(authority, part(2)).alias("authority"), F.when(authority, part(3)).alias("host"),
        F.when(authority, part(4)).otherwise(part(5)).alias("path"), F.when(v.rlike(r"\A[^?#]*\?"), part(6)).alias("query"), F.when(v.contains("#"), part(7)).alias("fragment"),
    )


def parse_uri(v: Column) -> Column:
    """The parts of a URI, null if it is none."""
    return F.when(v.rlike(G.URI), uri_parts(v))


def string() -> String:
    def read(node: Node):
        ok, value = node.string()
        return value, [mismatch(node, ok, "string")]

    return String(read)


# numbers


class Number(Scalar):
    def _bound(self, name: str, ok: Callable[[Column], Column], meta: dict):
        return self._check(ok, "out_of_range", lambda v: meta | {"actual": self._text(v)}, f"out_of_range.{name}")

    def _text(self, v: Column) -> Column:
        return v.cast("string")


class Int(Number):
    def min(self, n: int):
        return self._bound("minimum", lambda v: v >= n, {"min": n})

    def max(self, n: int):
        return self._bound("maximum", lambda v: v <= n, {"max": n})

    def range(self, low: int, high: int):
        return self._bound("range", lambda v: v.between(low, high), {"min": low, "max": high})

    def positive(self):
        return self._bound("positive", lambda v: v >= 1, {"min": 1})

    def negative(self):
        return self._bound("negative", lambda v: v < 0, {"max": -1})

    def non_negative(self):
        return self._bound("non_negative", lambda v: v >= 0, {"min": 0})

    def non_positive(self):
        return self._bound("non_positive", lambda v: v <= 0, {"max": 0})

    def multiple_of(self, n: int):
        refuse(n == 0, "nothing is a multiple of 0")
        return self._check(lambda v: v % n == 0, "not_multiple_of", lambda v: {"divisor": n, "actual": self._text(v)})

    def one_of(self, *values: int):
        allowed = sorted_allowed(values)
        return self._check(lambda v: v.isin(allowed), "not_allowed", lambda v: {"allowed": allowed, "actual": self._text(v)})


def _integer(low: int, high: int, kind: str, name: str) -> Int:
    def read(node: Node):
        a, b = (F.lit(str(x)).cast("decimal(20,0)") for x in (low, high)) if high >= 1 << 63 else (low, high)
        ok, value, beyond = node.integer()
        guards = [mismatch(node, ok, name), (beyond | ~F.coalesce(value.between(a, b), F.lit(False)), "type_mismatch", {"expected": name}, "type_mismatch.numeric_range")]
        return F.when(ok & value.between(a, b), value).cast(kind), guards

    return Int(read)


def int32() -> Int:
    return _integer(-(1 << 31), (1 << 31) - 1, "int", "integer")


def int64() -> Int:
    return _integer(-(1 << 63), (1 << 63) - 1, "long", "long")


integer = int64


def uint32() -> Int:
    return _integer(0, (1 << 32) - 1, "long", "integer")


def uint64() -> Int:
    return _integer(0, (1 << 64) - 1, "decimal(20,0)", "long")


uint = uint64


def minus_zero(v: Column) -> Column:
    return (v == 0) & (v.cast("string").startswith("-"))


class Float(Number):
    """Compared as Java compares: -0 is below 0, NaN is above all and equal to itself."""

    kind = "double"

    def _text(self, v: Column) -> Column:
        return shortest(v, self.kind)

    @staticmethod
    def _less(v: Column, b: float, equal: bool) -> Column:
        """v < b (or <=) in the total order."""
        if b != b:
            return F.lit(True) if equal else ~F.isnan(v)
        strict = (v < b) & ~F.isnan(v)
        if b == 0 and str(b)[0] != "-":
            strict = strict | minus_zero(v)
        same = ((v == b) & (minus_zero(v) if str(b)[0] == "-" else ~minus_zero(v))) if b == 0 else v == b
        return strict | same if equal else strict

    def min(self, n: float):
        n = float(n)
        return self._bound("minimum", lambda v: ~self._less(v, n, False), {"min": n})

    def max(self, n: float):
        n = float(n)
        return self._bound("maximum", lambda v: self._less(v, n, True), {"max": n})

    def range(self, low: float, high: float):
        low, high = float(low), float(high)
        refuse(low > high, "the range is empty")
        return self._bound("range", lambda v: ~self._less(v, low, False) & self._less(v, high, True), {"min": low, "max": high})

    def positive(self):
        return self._bound("positive", lambda v: ~self._less(v, 0.0, True), {"min": 0.0})

    def negative(self):
        return self._bound("negative", lambda v: self._less(v, 0.0, False), {"max": 0.0})

    def non_negative(self):
        return self._bound("non_negative", lambda v: ~self._less(v, 0.0, False), {"min": 0.0})

    def non_positive(self):
        return self._bound("non_positive", lambda v: self._less(v, 0.0, True), {"max": 0.0})

    def one_of(self, *values: float):
        allowed = sorted_allowed(map(float, values), key=lambda x: (x != x, x, str(x)[0] != "-"))
        same = lambda v, b: self._less(v, b, True) & ~self._less(v, b, False)

        def ok(v: Column) -> Column:
            made = F.lit(False)
            for b in allowed:
                made = made | same(v, b)
            return made

        return self._check(ok, "not_allowed", lambda v: {"allowed": allowed, "actual": self._text(v)})


def _floating(kind: str, name: str) -> Float:
    def read(node: Node):
        ok, value = node.floating(kind)
        endless = F.abs(value) == float("inf")
        return value, [mismatch(node, ok, "number"), (endless, "type_mismatch", {"expected": name}, "type_mismatch.numeric_range")]

    made = Float(read)
    made.kind = kind
    return made


def float64() -> Float:
    return _floating("double", "double")


def float32() -> Float:
    return _floating("float", "float")


class Decimal(Number):
    """Decimals as written: struct(neg, digits, scale), of any number of digits."""

    def _text(self, v: Column) -> Column:
        return let(v, D.to_text)

    def _check(self, ok, code, meta=None, key=None, joint=False):
        return super()._check(lambda v: let(v, ok), code, meta, key, joint)

    @staticmethod
    def _bound_of(n) -> tuple[str, Callable[[], Column]]:
        """The bound's text, and its parts once there is a session."""
        exact = Exact(str(n))
        refuse(not exact.is_finite(), "a bound has to be a number")
        return str(n), lambda: D.exact(exact)

    def min(self, n):
        text, b = self._bound_of(n)
        return self._bound("minimum", lambda v: D.compare(v, b()) >= 0, {"min": Raw(text)})

    def max(self, n):
        text, b = self._bound_of(n)
        return self._bound("maximum", lambda v: D.compare(v, b()) <= 0, {"max": Raw(text)})

    def range(self, low, high):
        (a, lo), (b, hi) = self._bound_of(low), self._bound_of(high)
        return self._bound("range", lambda v: (D.compare(v, lo()) >= 0) & (D.compare(v, hi()) <= 0), {"min": Raw(a), "max": Raw(b)})

    def positive(self):
        return self._bound("positive", lambda v: D.sign(v) > 0, {"min": 0})

    def negative(self):
        return self._bound("negative", lambda v: D.sign(v) < 0, {"max": 0})

    def non_negative(self):
        return self._bound("non_negative", lambda v: D.sign(v) >= 0, {"min": 0})

    def non_positive(self):
        return self._bound("non_positive", lambda v: D.sign(v) <= 0, {"max": 0})

    def multiple_of(self, n):
        exact = Exact(str(n))
        refuse(not exact.is_finite() or exact == 0, "nothing is a multiple of 0")
        return self._check(lambda v: D.divisible(v, exact), "not_multiple_of", lambda v: {"divisor": F.lit(str(n)), "actual": self._text(v)})

    def scale(self, n: int):
        return self._check(lambda v: v.getField("scale") <= n, "invalid_scale", lambda v: {"maxScale": n, "actualScale": v.getField("scale").cast("string")})

    def as_decimal(self, precision: int = 38, scale: int = 18):
        """As Spark's decimal; null where it does not fit."""
        return self._change(lambda v: D.to_plain(v).try_cast(f"decimal({precision},{scale})"), Scalar)


def decimal_number() -> Decimal:
    def read(node: Node):
        if isinstance(node, Typed) and (parts := node.decimal_parts()) is not None:
            return parts, []
        ok, text = node.number_text()
        parsed = D.parse(text)
        return parsed, [(node.inexact(), "type_mismatch", {"expected": "decimal"}, "type_mismatch.numeric_range"), mismatch(node, ok & F.coalesce(parsed.isNotNull(), F.lit(False)), "number")]

    return Decimal(read)


# booleans and bytes


class Bool(Scalar):
    def _is(self, expected: bool):
        return self._check(lambda v: v == F.lit(expected), "invalid_value", lambda v: {"expected": expected, "actual": v.cast("string")})

    def is_true(self):
        return self._is(True)

    def is_false(self):
        return self._is(False)


def boolean() -> Bool:
    def read(node: Node):
        ok, value = node.boolean()
        return value, [mismatch(node, ok, "boolean")]

    return Bool(read)


def binary() -> Scalar:
    def read(node: Node):
        ok, value = node.binary()
        return value, [mismatch(node, ok, "byte[]")]

    return Scalar(read)


def json_literal(value) -> str:
    return json.dumps(value, ensure_ascii=False)
