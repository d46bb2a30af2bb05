"""Decoders and their combinators. A decoder is immutable and compiles to column expressions."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.outcome import PENDING, Outcome, Path, accepted, binds, bound, deferred, issue, let, moved, path_column, rejected, settled, unpacked
from ..sources.nodes import Missing, Node, Typed

Check = Callable[[Column], Column]


def refuse(condition: bool, why: str) -> None:
    if condition:
        raise ValueError(why)


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


class Decoder:
    """Reads one value. Subclasses give compile(node, path) -> Outcome."""

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        raise NotImplementedError

    # combinators
    def map(self, f: Callable[[Column], Column]) -> Decoder:
        return Custom(lambda node, path: self._then(node, path, lambda v: Outcome(f(v))))

    def and_then(self, f: Callable[[Column], Outcome]) -> Decoder:
        """`f` gives an Outcome whose issue paths are relative to here."""
        return Custom(lambda node, path: self._then(node, path, lambda v: rebased(kept(f(v)), path)))

    def and_then_with_path(self, f: Callable[[Column, Path], Outcome]) -> Decoder:
        """`f` is given the path, and the paths of its issues are kept."""
        return Custom(lambda node, path: self._then(node, path, lambda v: kept(f(v, path))))

    def pipe(self, decoder: Decoder, of: Callable[[Column], Node]) -> Decoder:
        """Hands the value on to another decoder at the same path; `of` makes its node."""
        return Custom(lambda node, path: self._then(node, path, lambda v: decoder.compile(of(v), path)), decoder)

    def refine(self, ok: Check, code: str, message: str | None = None, meta: Callable[[Column], dict] | None = None) -> Decoder:
        """Rejects values that are not `ok`; metadata is made only for a value that fails."""
        refuse(not code, "a refinement needs a code")

        def run(v: Column, path: Path) -> Outcome:
            bad = F.when(~F.coalesce(ok(v), F.lit(False)), issue(code, path, meta(v) if meta else None, message=message))
            return Outcome(F.when(bad.isNull(), v), [("one", bad)])

        return Custom(lambda node, path: self._then(node, path, lambda v: run(v, path)), self)

    def refine_with_path(self, check: Callable[[Column, Path], Column]) -> Decoder:
        """`check` gives an array of issues with absolute paths."""
        def run(v: Column, path: Path) -> Outcome:
            found = published(check(v, path))
            return Outcome(F.when(F.size(found) == 0, v), [("many", found)])

        return Custom(lambda node, path: self._then(node, path, lambda v: run(v, path)), self)

    def default(self, value) -> Decoder:
        """`value` for null and missing input, tested before decoding; other failures stay."""
        def run(node: Node, path: Path) -> Outcome:
            own, gone = self.compile(node, path), node.absent()
            other = lit(value() if callable(value) and not isinstance(value, Column) else value)
            if binds(own):
                return unpacked(F.when(gone, accepted(other)).otherwise(own.packed()))
            return Outcome(F.when(gone, other).otherwise(own.value), [hide(p, gone) for p in own.parts])

        return Custom(run, self)

    def fallback(self, value) -> Decoder:
        """`value` (or a function of the issues) for any input with issues."""
        def other(own: Outcome) -> Column:
            return value(published(own.issues())) if callable(value) and not isinstance(value, Column) else lit(value)

        def run(node: Node, path: Path) -> Outcome:
            with judging("a fallback"):
                own = self.compile(node, path)
            return bound(own, lambda own: Outcome(F.when(own.failed(), other(own)).otherwise(own.value)))

        return Custom(run, self)

    def nullable(self) -> Decoder:
        """Null is a value; missing input still goes to the decoder."""
        def run(node: Node, path: Path) -> Outcome:
            own = self.compile(node, path)
            if binds(own):
                return unpacked(F.when(node.null, accepted(F.lit(None))).otherwise(own.packed()))
            return Outcome(F.when(~node.null, own.value), [hide(p, node.null) for p in own.parts])

        return Custom(run, self)

    def strict(self, *fields: str) -> Decoder:
        """Reports members that are not among `fields`, after this decoder's issues."""
        return Strict(self, fields)

    def _then(self, node: Node, path: Path, body: Callable[[Column], Outcome]) -> Outcome:
        def step(own: Outcome) -> Outcome:
            after, failed = body(own.value), own.failed()
            if after.whole is not None:
                return unpacked(F.when(~failed, after.whole).otherwise(rejected(own.issues())))
            return Outcome(F.when(~failed, after.value), [*own.parts, *(hide(p, failed) for p in after.parts)])

        return bound(self.compile(node, path), step)


def hide(part: tuple[str, Column], when: Column) -> tuple[str, Column]:
    kind, c = part
    return (kind, F.when(~when, c)) if kind == "one" else (kind, F.filter(c, lambda x: ~when))


def kept(outcome: Outcome) -> Outcome:
    """A caller's outcome, whose value counts only if it has no issues."""
    return Outcome(F.when(~outcome.failed(), outcome.value), outcome.parts) if outcome.whole is None and outcome.parts else outcome


def rebased(outcome: Outcome, path: Path) -> Outcome:
    """Paths of the issues, relative so far, under `path`."""
    if not path:
        return outcome
    prefix = path_column(path)
    move = lambda i: moved(i, prefix).withField("by_strict", F.lit(False))
    if outcome.whole is not None:
        return unpacked(let(outcome.whole, lambda p: F.struct(p.getField("value").alias("value"), F.transform(p.getField("issues"), move).alias("issues"))))
    return Outcome(outcome.value, [(k, F.when(c.isNotNull(), move(c))) if k == "one" else (k, F.transform(c, move)) for k, c in outcome.parts])


def published(issues: Column) -> Column:
    """Issues as callers see them, without private marks."""
    return F.transform(issues, lambda i: i.withField("by_strict", F.lit(False)))


class Custom(Decoder):
    """`like`: a decoder whose values this one's are, where that is known."""

    def __init__(self, run: Callable[[Node, Path], Outcome], like: Decoder | None = None):
        self._run, self.like = run, like

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        return self._run(node, path)


def base_of(decoder: Decoder) -> Decoder:
    """The decoder whose values a chain of combinators gives, as far as that is known."""
    while isinstance(decoder, Custom) and decoder.like is not None:
        decoder = decoder.like
    return decoder


def new_decoder(f: Callable[[Node], Outcome]) -> Decoder:
    """A decoder of a function of the node; issue paths are relative."""
    return Custom(lambda node, path: rebased(f(node), path))


def new_decoder_with_path(f: Callable[[Node, Path], Outcome]) -> Decoder:
    """A decoder of a function of node and path; issue paths are absolute."""
    return Custom(f)


_open: list = []  # what lazy decoders and encoders are being unrolled, the outermost first
MOST_OPEN = 64


def _value(x):
    try:
        hash(x)
    except TypeError:
        return id(x)
    return x


def same_as(make: Callable) -> tuple:
    """What tells functions apart: their code and what it is closed over."""
    cells = getattr(make, "__closure__", None) or ()
    return getattr(make, "__code__", make), *(_value(c.cell_contents) for c in cells), *map(_value, getattr(make, "__defaults__", None) or ())


@contextmanager
def unrolled(make: Callable):
    """How often `make`, or a function like it, is being unrolled already."""
    key = same_as(make)
    depth = _open.count(key) if sum(k[0] == key[0] for k in _open) < MOST_OPEN else MOST_OPEN
    _open.append(key)
    try:
        yield depth
    finally:
        _open.pop()


def lazy(make: Callable[[], Decoder], max_depth: int = 8) -> Decoder:
    """A decoder that refers to itself. Typed input is as deep as its type. JSON is unrolled to `max_depth`,
    and deeper input is a type mismatch; `decode_tree` has no such bound."""
    def run(node: Node, path: Path) -> Outcome:
        nodes = deferred()
        if nodes is not None:
            return nodes.leave(make, node, path)
        with unrolled(make) as depth:
            if depth >= (MOST_OPEN if isinstance(node, Typed) else max_depth) or isinstance(node, Missing):
                bad = F.when(~node.absent(), issue("type_mismatch", path, {"expected": f"at most {max_depth} levels"})).when(node.absent(), issue("required", path))
                return Outcome(F.lit(None), [("one", bad)])
            return make().compile(node, path)

    return Custom(run)


@contextmanager
def judging(what: str):
    """Within, what comes of a node decides on something: it cannot be left for later."""
    nodes = deferred()
    before = nodes.count if nodes is not None else 0
    yield
    refuse(nodes is not None and nodes.count > before, f"{what} of a lazy decoder needs an end of its depth: not in decode_tree")


class Strict(Decoder):
    """Members that are not declared are issues. A member that an inner strict decoder has reported
    already is reported once, which the private mark on its issues tells."""

    def __init__(self, inner: Decoder, fields: tuple[str, ...]):
        refuse(len(set(fields)) < len(fields), "a field is named twice")
        self.inner, self.fields = inner, fields

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        own = self.inner.compile(node, path)

        def extra(before: Column) -> Column:
            known = F.array(*map(F.lit, self.fields)) if self.fields else F.expr("cast(array() as array<string>)")
            keys = F.filter(F.coalesce(F.when(node.is_object() & ~node.absent(), node.keys()), F.expr("cast(array() as array<string>)")), lambda k: ~F.array_contains(known, k))
            at = path_column(path)
            told = F.transform(F.filter(before, lambda i: i.getField("by_strict")), lambda i: i.getField("path"))
            fresh = F.filter(keys, lambda k: ~F.array_contains(told, F.concat(at, F.array(k))))
            return F.transform(fresh, lambda k: issue("unknown_field", (*path, k), {"field": F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)}, by_strict=True))

        if node.bind or own.whole is not None and binds(own):
            def join(p: Column) -> Column:
                before = p.getField("issues")
                told = F.concat(before, extra(before))
                return let(told, lambda t: F.struct(F.when(settled(t), p.getField("value")).alias("value"), t.alias("issues")))

            return unpacked(let(own.packed(), join))
        issues = let(own.issues(), lambda before: F.concat(before, extra(before)))
        return Outcome(F.when(settled(issues), own.value), [("many", issues)])


def candidates(tried: list[Outcome]) -> Column:
    """What each alternative told, as JSON text."""
    return F.to_json(F.array(*(F.struct(F.lit(k).alias("candidate"), F.transform(published(t.issues()), lambda i: i.dropFields("by_strict")).alias("issues")) for k, t in enumerate(tried))))


def one_of(*alternatives: Decoder, **named: Decoder) -> Decoder:
    """The first alternative that decodes. The values of alternatives given by place have one type; those
    given by name may each have their own, and the value is then struct(tag, a member for each name): the tag
    names the alternative, and its member alone holds a value (see `unwrapped`)."""
    refuse(not alternatives and not named, "one_of needs an alternative")
    refuse(bool(alternatives and named), "alternatives are given by place or by name")
    refuse("tag" in named, "an alternative cannot be named tag")
    names, each = list(named), list(named.values() or alternatives)

    def run(node: Node, path: Path) -> Outcome:
        with judging("one_of"):
            tried = [a.compile(node, path) for a in each]
        if named:
            kinds = [t.value for t in tried]  # name the types; never evaluated
            tried = [bound(t, lambda o, k=k: tagged(names, k, o, kinds)) for k, t in enumerate(tried)]
        failed = lambda ts: issue("one_of_failed", path, {"candidates": candidates(ts)})
        if not any(map(binds, tried)):
            value, bad = None, F.lit(True)
            for t in tried:
                value = F.when(~t.failed(), t.value) if value is None else value.when(~t.failed(), t.value)
                bad = bad & t.failed()
            return Outcome(value, [("one", F.when(bad, failed(tried)))])

        def attempt(k: int, before: list[Outcome]) -> Column:
            """The outcome from alternative k on; each is evaluated once, and only if those before failed."""
            if k == len(tried):
                return rejected(F.array(failed(before)))
            return let(tried[k].packed(), lambda p: F.when(F.size(p.getField("issues")) == 0, p).otherwise(attempt(k + 1, [*before, unpacked(p)])))

        return unpacked(attempt(0, []))

    return Custom(run, alternatives[0] if alternatives else None)


def tagged(names: list[str], k: int, own: Outcome, kinds: list[Column]) -> Outcome:
    """A value of alternative k beside nulls of the others' types."""
    made = F.struct(F.lit(names[k]).alias("tag"), *(own.value.alias(n) if j == k else F.when(F.lit(False), kinds[j]).alias(n) for j, n in enumerate(names)))
    return Outcome(F.when(~own.failed(), made), own.parts)


def unwrapped(v: Column, **each: Callable[[Column], Column]) -> Column:
    """A tagged value by the function of its alternative, which all give one type."""
    made = None
    for name, f in each.items():
        made = (F if made is None else made).when(v.getField("tag") == name, f(v.getField(name)))
    return made


def run_let(decoder: Decoder, node: Node, path: Path) -> Outcome:
    """A decoder's outcome evaluated once."""
    return unpacked(let(decoder.compile(node, path).packed(), lambda p: p))
