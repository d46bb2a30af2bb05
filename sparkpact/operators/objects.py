"""Decoders of objects: declared fields, read in order, with all their issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.outcome import NO_ISSUES, Outcome, Path, binds, bound, issue, json_text, let, rejected, settled, unpacked
from ..sources.nodes import Missing, Node
from .core import Custom, Decoder, Strict, hide, refuse, tagged


class Field:
    """How a member is read: a decoder, one that may be missing, or one in three states."""

    def __init__(self, decoder: Decoder, mode: str = "required"):
        self.decoder, self.mode = decoder, mode

    def compile(self, parent: Node, name: str, path: Path) -> Outcome:
        node = parent.member(name)
        if node.bind:
            return unpacked(node.bound(lambda n: self._read(parent, n, (*path, name)).packed()))
        return self._read(parent, node, (*path, name))

    def _read(self, parent: Node, node: Node, at: Path) -> Outcome:
        is_object = parent.is_object() & ~parent.absent()
        if self.mode == "required":
            own = self.decoder.compile(node, at)
            # of something that is no object every field says so, at the member
            bad = F.when(parent.absent(), issue("required", at)).when(~is_object, issue("type_mismatch", at, {"expected": "object", "actual": json_text(parent.kind)}))
            if node.bind or own.whole is not None and binds(own):
                judge = lambda b: F.when(b.isNull(), own.packed()).otherwise(F.struct(F.lit(None).alias("value"), F.array(b).alias("issues")))
                return unpacked(let(bad, judge))
            return Outcome(F.when(bad.isNull(), own.value), [("one", bad), *(hide(p, bad.isNotNull()) for p in own.parts)])
        gone = node.missing | ~F.coalesce(is_object, F.lit(False))
        skip = gone if self.mode == "optional" else gone | node.null
        own = self.decoder.compile(node, at)
        if node.bind or own.whole is not None and binds(own):
            own = unpacked(let(F.when(~skip, own.packed()), lambda p: F.struct(p.getField("value").alias("value"), F.coalesce(p.getField("issues"), F.expr(NO_ISSUES)).alias("issues"))))
            if self.mode != "presence":
                return own
            state = F.when(gone, "absent").when(node.null, "null").otherwise("present")
            kept = lambda p: F.struct(F.struct(state.alias("state"), p.getField("value").alias("value")).alias("value"), p.getField("issues").alias("issues"))
            return unpacked(let(own.packed(), kept))
        parts = [hide(p, skip) for p in own.parts]
        value = F.when(~skip, own.value)
        if self.mode == "presence":
            state = F.when(gone, "absent").when(node.null, "null").otherwise("present")
            value = F.struct(state.alias("state"), value.alias("value"))
        return Outcome(value, parts)


def optional(decoder: Decoder) -> Field:
    """A member that may be missing; null still goes to the decoder."""
    return Field(decoder, "optional")


def presence(decoder: Decoder) -> Field:
    """struct(state, value) with state absent, null or present."""
    return Field(decoder, "presence")


def presence_of(state: str, value: Column | None = None) -> Column:
    refuse(state not in ("absent", "null", "present"), "no such state")
    return F.struct(F.lit(state).alias("state"), (value if value is not None else F.lit(None)).alias("value"))


def is_given(p: Column) -> Column:
    """Whether the member was there, be it null."""
    return p.getField("state") != "absent"


class Fields:
    """An ordered set of components."""

    def __init__(self, parts: tuple = ()):
        self.parts = parts

    def field(self, name: str, source: Decoder | Field) -> Fields:
        refuse(not name and name != "", "a field needs a name")
        refuse(any(n == name for n, s in self.parts if not isinstance(s, Flat)), f"field {name} is declared twice")
        return Fields((*self.parts, (name, source if isinstance(source, Field) else Field(source))))

    def flat(self, decoder: Decoder, name: str | None = None) -> Fields:
        """`decoder` reads the same object at the same path; its value is a component."""
        return Fields((*self.parts, (name or f"flat{len(self.parts)}", Flat(decoder))))

    def names(self) -> list[str]:
        return [n for n, s in self.parts if isinstance(s, Field)]


class Flat:
    def __init__(self, decoder: Decoder):
        self.decoder = decoder


def fields() -> Fields:
    return Fields()


class Object(Decoder):
    def __init__(self, of: Fields):
        refuse(not isinstance(of, Fields), "an object needs fields")
        self.of = of

    def strict(self, *more: str) -> Decoder:
        refuse(any(isinstance(s, Flat) for _, s in self.of.parts) and not more, "with flat parts the members have to be named")
        return Strict(self, tuple(dict.fromkeys([*self.of.names(), *more])))

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        parts: list = []
        values: list[Column] = []
        failed = F.lit(False)
        each = [(name, source.decoder.compile(node, path) if isinstance(source, Flat) else source.compile(node, name, path)) for name, source in self.of.parts]
        if each and (node.bind or any(own.whole is not None and binds(own) for _, own in each)):
            return self._joined(each)
        for name, own in each:
            parts += own.parts
            failed = failed | own.failed()
            values.append(own.value.alias(name))
        made = F.struct(*values) if values else F.struct(F.lit(True).alias("empty"))
        return Outcome(F.when(~failed, made), parts)

    @staticmethod
    def _joined(each: list[tuple[str, Outcome]]) -> Outcome:
        """As one struct, in which every member is read once."""
        def join(m: Column) -> Column:
            made = F.struct(*(m.getField(f"m{k}").getField("value").alias(name) for k, (name, _) in enumerate(each)))
            told = F.concat(*(m.getField(f"m{k}").getField("issues") for k in range(len(each))))
            return let(told, lambda t: F.struct(F.when(settled(t), made).alias("value"), t.alias("issues")))

        return unpacked(let(F.struct(*(own.packed().alias(f"m{k}") for k, (_, own) in enumerate(each))), join))


def object_of(of: Fields | None = None, **sources: Decoder | Field) -> Object:
    """An object decoder from Fields, or from keyword arguments in order."""
    made = of or Fields()
    for name, source in sources.items():
        made = made.field(name, source)
    return Object(made)


def discriminate(tag: str | Decoder | Callable, variants: dict[str, Decoder], tag_name: str | None = None, union: bool = False) -> Decoder:
    """The tag member picks the decoder of the whole object. `tag` is a member's name, or, with
    `tag_name`, a string decoder of that member; a decoder alone sees the whole input. All variants'
    values have one type, unless it is a `union`: then the value is struct(tag, a member for each variant), of
    which only the one that the tag names holds a value (see `unwrapped`)."""
    refuse(not variants, "a variant is needed")
    refuse(union and "tag" in variants, "a variant of a union cannot be named tag")
    names = sorted(variants)

    def run(node: Node, path: Path) -> Outcome:
        from .scalars import string

        member = tag if isinstance(tag, str) else tag_name
        if member is not None:
            own = Field(string() if isinstance(tag, str) else tag).compile(node, member, path)
            at = (*path, member)
        else:
            own, at = tag.compile(node, path), path
        compiled = {name: decoder.compile(node, path) for name, decoder in variants.items()}
        if union:
            kinds = [c.value for c in compiled.values()]  # name the types; never evaluated
            compiled = {n: bound(c, lambda o, k=k: tagged(list(variants), k, o, kinds)) for k, (n, c) in enumerate(compiled.items())}
        unknown = lambda v: issue("not_allowed", at, {"allowed": names, "actual": json_text(v)})
        if binds(own):
            def pick(p: Column) -> Column:
                v = p.getField("value")
                made = F.when(~settled(p.getField("issues")), rejected(p.getField("issues")))
                for name, inner in compiled.items():
                    made = made.when(v == name, inner.packed())
                return made.otherwise(rejected(F.array(unknown(v))))

            return unpacked(let(own.packed(), pick))
        chosen = F.when(~own.failed(), own.value)
        parts, value = [*own.parts, ("one", F.when(chosen.isNotNull() & ~chosen.isin(names), unknown(chosen)))], None
        for name, inner in compiled.items():
            here = F.coalesce(chosen == name, F.lit(False))
            parts += [hide(p, ~here) for p in inner.parts]
            value = F.when(here, inner.value) if value is None else value.when(here, inner.value)
        return Outcome(value, parts)

    return Custom(run)


def enum_of(values: dict[str, object], source: Decoder | None = None, message: str | None = None) -> Decoder:
    """A name, whatever the case of its ASCII letters, to its value."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = {k.translate(fold): v for k, v in values.items()}
    refuse(not values, "an enum needs a name")
    refuse(len(folded) < len(values), "two names differ in case only")
    return Picked(source, folded, {"allowed": sorted(values)}, "invalid_format.enum", message, True)


def literal(text: str, source: Decoder | None = None, message: str | None = None) -> Decoder:
    """Exactly this string."""
    return Picked(source, {text: text}, {"expected": text}, "invalid_format.literal", message, False)


class Picked(Decoder):
    def __init__(self, source, table: dict, meta: dict, key: str, text: str | None, fold: bool):
        self.source, self.table, self.meta, self.key, self.text, self.fold = source, table, meta, key, text, fold

    def message(self, text: str) -> Picked:
        return Picked(self.source, self.table, self.meta, self.key, text, self.fold)

    def compile(self, node: Node, path: Path = ()) -> Outcome:
        from .scalars import string

        def pick(own: Outcome) -> Outcome:
            name = F.translate(own.value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if self.fold else own.value
            bad = F.when(~own.failed() & ~F.coalesce(name.isin(list(self.table)), F.lit(False)), issue("invalid_format", path, self.meta, self.key, self.text))
            picked = F.try_element_at(F.create_map(*(F.lit(x) for kv in self.table.items() for x in kv)), name)
            return Outcome(F.when(~own.failed() & bad.isNull(), picked), [*own.parts, ("one", bad)], light=own.light)

        return bound((self.source or string()).compile(node, path), pick)


__all__ = ["Fields", "Field", "Missing", "Object", "discriminate", "enum_of", "fields", "is_given", "literal", "object_of", "optional", "presence", "presence_of"]
