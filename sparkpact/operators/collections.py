"""Decoders of arrays and maps."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.outcome import Outcome, Path, issue, json_text, let, rejected, settled, unpacked
from ..sources.nodes import Node, Typed
from .core import Decoder, Strict, base_of, refuse
from .objects import Object, Picked
from .scalars import Float, Scalar, size_of


class Sized(Decoder):
    """A collection: every element is decoded and all issues told; checks run only if all decoded."""

    def __init__(self, inner: Decoder):
        self.inner, self._steps, self._base_message = inner, (), None

    def _check(self, ok, code, meta, key=None):
        new = copy.copy(self)
        new._steps = (*self._steps, (ok, code, meta, key, None))
        return new

    def message(self, text: str):
        new = copy.copy(self)
        if self._steps:
            new._steps = (*self._steps[:-1], (*self._steps[-1][:4], text))
        else:
            new._base_message = text
        return new

    def _by_size(self, ok, code: str, meta: dict, key: str | None = None):
        return self._check(lambda v: ok(F.size(v)), code, lambda v: meta | {"actual": F.size(v).cast("string")}, key)

    def non_empty(self):
        return self._by_size(lambda n: n > 0, "too_small", {"min": 1}, "too_small.nonempty")

    def min_size(self, n: int):
        return self._by_size(lambda s: s >= size_of(n), "too_small", {"min": n})

    def max_size(self, n: int):
        return self._by_size(lambda s: s <= size_of(n), "too_big", {"max": n})

    def size(self, n: int):
        return self._by_size(lambda s: s == size_of(n), "invalid_size", {"expected": n})

    expected = "array"

    def _open(self, node: Node) -> tuple[Column, Column]:
        raise NotImplementedError

    def _finish(self, node: Node, path: Path, ok: Column, inner: Callable[[], Column]) -> Outcome:
        """`inner` is struct(value, issues) of all elements."""
        own = self._base_message
        bad = F.when(node.absent(), issue("required", path, message=own)).when(~F.coalesce(ok, F.lit(False)), issue("type_mismatch", path, {"expected": self.expected, "actual": json_text(node.kind)}, message=own))

        def judge(all_: Column) -> Column:
            value, told = all_.getField("value"), all_.getField("issues")
            checks = F.lit(None)
            for k, (good, code, meta, key, text) in enumerate(self._steps):
                fails = ~F.coalesce(good(value), F.lit(False))
                made = issue(code, path, meta(value), key, text)
                checks = F.when(fails, made) if not k else checks.when(fails, made)
            if self._steps:
                last = F.when(~settled(told), told).otherwise(F.concat(told, F.filter(F.array(checks), lambda x: x.isNotNull())))
            else:
                last = told
            return let(last, lambda issues: F.struct(F.when(settled(issues), value).alias("value"), issues.alias("issues")))

        done = let(inner(), judge)
        return unpacked(let(bad, lambda b: F.when(b.isNull(), done).otherwise(rejected(F.array(b)))))


class List(Sized):
    def compile(self, node: Node, path: Path = ()) -> Outcome:
        kind = node.dtype.elementType if isinstance(node, Typed) and isinstance(node.dtype, T.ArrayType) else None
        refuse(self.hashes and kind is not None and not hashable(kind), f"elements of {kind} cannot be told apart")
        ok, array, of = node.elements()
        each = F.transform(array, lambda x, i: self.inner.compile(of(x), (*path, i.cast("string"))).packed())
        inner = lambda: let(each, lambda e: F.struct(F.transform(e, lambda x: x.getField("value")).alias("value"), F.flatten(F.transform(e, lambda x: x.getField("issues"))).alias("issues")))
        return self._finish(node, path, ok, inner)

    def contains(self, element):
        """NaN is never contained; the two zeros are the same."""
        refuse(element is None, "an element is needed")
        self = self._told_apart()
        if element != element:
            return self._check(lambda v: F.lit(False), "missing_element", lambda v: {"expected": element})
        return self._check(lambda v: F.array_contains(v, F.lit(element)), "missing_element", lambda v: {"expected": element})

    def contains_all(self, *elements):
        """Missing elements are told in the order and as often as they were asked for."""
        refuse(not elements, "an element is needed")
        self = self._told_apart()
        gone = lambda v: F.filter(F.array(*map(F.lit, elements)), lambda x: ~F.array_contains(v, x) | (x != x))
        return self._check(lambda v: F.size(gone(v)) == 0, "missing_elements", lambda v: {"expected": list(elements), "missing": F.to_json(gone(v))})

    def unique(self):
        return self.unique_by(None)

    def unique_by(self, key: Callable[[Column], Column] | None):
        """Each repeated element once, in the order in which it is first repeated. NaN repeats nothing."""
        nan = lambda x: F.coalesce(x.cast("string") == "NaN", F.lit(False))

        def twice(v: Column) -> Column:
            """By sorting: of a run of equal keys the second place is where the key is first repeated."""
            keys = F.transform(v, key) if key else v
            placed = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
            same = lambda p, j, back: F.coalesce(F.get(p, j - back).getField("k").eqNullSafe(F.get(p, j).getField("k")), F.lit(False)) & (j >= back)
            second = lambda p: F.filter(p, lambda e, j: same(p, j, 1) & ~same(p, j, 2) & ~nan(e.getField("k")))
            return let(placed, lambda p: F.transform(F.array_sort(F.transform(second(p), lambda e: e.getField("i"))), lambda i: F.get(v, i)))

        def unique(v: Column) -> Column:
            keys = F.transform(v, key) if key else v
            return F.when(F.size(F.array_distinct(keys)) == F.size(v), True).otherwise(F.size(twice(v)) == 0)

        return (self if key else self._told_apart())._check(unique, "duplicate_element", lambda v: {"duplicates": F.to_json(twice(v))})

    def to_set(self, numbers: bool | None = None):
        """Distinct elements. Of floats the two zeros are one and every NaN is an element of its own. Whether elements
        are floats is known from their decoder, through combinators that keep the value; `numbers` tells it, and where
        neither does, their type decides when the plan is analysed."""
        base = base_of(self.inner)
        if numbers is None and isinstance(base, (Scalar, Picked)):
            numbers = isinstance(base, Float)

        def distinct(v: Column) -> Column:
            if numbers is None:
                return distinct_of_any(v)
            if not numbers:
                return F.array_distinct(v)
            plain = F.array_distinct(F.transform(F.filter(v, lambda x: ~F.isnan(x)), lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))
            return F.concat(plain, F.filter(v, F.isnan))

        return self._told_apart().map(distinct)

    def _told_apart(self):
        refuse(holds_map(self.inner), "maps cannot be told apart")
        new = copy.copy(self)
        new.hashes = True
        return new

    hashes = False


class Dict(Sized):
    expected = "object"

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        ok, entries, of = node.entries()
        each = F.transform(entries, lambda e: F.struct(e.getField("key").alias("key"), self.inner.compile(of(e), (*path, e.getField("key"))).packed().alias("made")))
        inner = lambda: let(each, lambda e: F.struct(
            F.map_from_entries(F.transform(e, lambda x: F.struct(x.getField("key"), x.getField("made").getField("value")))).alias("value"),
            F.flatten(F.transform(e, lambda x: x.getField("made").getField("issues"))).alias("issues"),
        ))
        return self._finish(node, path, ok & node.is_object(), inner)


def list_of(inner: Decoder) -> List:
    return List(inner)


def dict_of(inner: Decoder) -> Dict:
    return Dict(inner)


def set_of(inner: Decoder, numbers: bool | None = None) -> Decoder:
    return List(inner).to_set(numbers)


def holds_map(decoder: Decoder) -> bool:
    """Whether the values of a decoder hold maps."""
    base = base_of(decoder)
    if isinstance(base, Object):
        return any(holds_map(source.decoder) for _, source in base.of.parts)
    if isinstance(base, Strict):
        return holds_map(base.inner)
    return isinstance(base, Dict) or isinstance(base, List) and holds_map(base.inner)


def distinct_of_any(v: Column) -> Column:
    """Distinct elements of whatever type, the first of each, by a key: the element itself as JSON, and of floats their
    text, with one key for both zeros and one of its own for each NaN."""
    def key(x: Column, i: Column) -> Column:
        text = x.cast("string")
        number = F.when(text.isin("-0.0", "0.0"), "0.0").when(text == "NaN", F.concat(F.lit("NaN "), i.cast("string"))).otherwise(text)
        return F.coalesce(F.when(F.typeof(x).isin("float", "double"), number).otherwise(F.to_json(F.array(x))), F.lit("null"))

    placed = F.array_sort(F.transform(v, lambda x, i: F.struct(key(x, i).alias("k"), i.alias("i"))))
    first = lambda p: F.filter(p, lambda e, j: (j == 0) | (F.get(p, j - 1).getField("k") != e.getField("k")))
    return let(placed, lambda p: F.transform(F.array_sort(F.transform(first(p), lambda e: e.getField("i"))), lambda i: F.get(v, i)))


def hashable(dtype: T.DataType) -> bool:
    """Whether elements of this type can be told apart: maps and variants cannot."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return hashable(dtype.elementType)
    return not isinstance(dtype, T.StructType) or all(hashable(f.dataType) for f in dtype.fields)
