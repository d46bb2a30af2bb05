"""Inputs of decoders: typed columns, JSON as a variant (fast), and JSON as a tagged tree (lossless)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.outcome import let

FALSE, TRUE = F.lit, F.lit


def shortest(v: Column, kind: str = "double") -> Column:
    """The fewest digits that read back as the number, in the notation of the JVM: 1.0E23 where older JVMs write
    9.999999999999999E22. By the library with which Spark writes JSON."""
    name = "Double" if kind == "double" else "Float"
    text = F.reflect(F.lit(f"com.fasterxml.jackson.core.io.schubfach.{name}ToDecimal"), F.lit("toString"), F.coalesce(v.cast(kind), F.lit(0.0).cast(kind)))
    return F.when(v.isNotNull(), text)


class Node:
    """One input value. `null` and `missing` are conditions; readers give (condition of the right kind,
    value). `kind` is the kind's name as issues have it."""

    null: Column
    missing: Column
    #: whether decoders bind what they read of this node, so that it is evaluated once
    bind = False

    def absent(self) -> Column:
        return self.null | self.missing

    def inexact(self) -> Column:
        """Whether a number is there whose digits are not the ones written."""
        return F.lit(False)


class Missing(Node):
    """A member that the input does not have, known when the plan is made."""

    def __init__(self):
        self.null, self.missing, self.kind = F.lit(False), F.lit(True), F.lit("missing")

    def _none(self, kind: str) -> tuple[Column, Column]:
        return F.lit(False), F.lit(None).cast(kind)

    def string(self):
        return self._none("string")

    def boolean(self):
        return self._none("boolean")

    def binary(self):
        return self._none("binary")

    def integer(self):
        return (*self._none("decimal(38,0)"), F.lit(False))

    def floating(self, kind: str):
        return self._none(kind)

    def number_text(self):
        return self._none("string")

    def elements(self):
        return F.lit(False), F.expr("cast(array() as array<string>)"), lambda x: Missing()

    def is_object(self):
        return F.lit(False)

    def keys(self):
        return F.expr("cast(array() as array<string>)")

    def member(self, name: str) -> Node:
        return self

    def entries(self):
        return F.lit(False), F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda x: Missing()


class Typed(Node):
    """A column of a known type."""

    NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

    def __init__(self, column: Column, dtype: T.DataType):
        self.column, self.dtype = column, dtype
        self.null, self.missing = column.isNull(), F.lit(False)
        names = ((T.BooleanType, "boolean"), (T.StringType, "string"), (self.NUMBERS, "number"), (T.ArrayType, "array"), (T.BinaryType, "byte[]"), ((T.StructType, T.MapType), "object"))
        self.name = next((n for t, n in names if isinstance(dtype, t)), "null" if isinstance(dtype, T.NullType) else "unknown")
        self.kind = F.when(self.null, F.lit("null")).otherwise(F.lit(self.name))

    def _read(self, name: str, none: str) -> tuple[Column, Column]:
        return (F.lit(True), self.column) if self.name == name else (F.lit(False), F.lit(None).cast(none))

    def string(self):
        ok, value = self._read("string", "string")
        return (F.expr("true") if self.name != "string" else F.is_valid_utf8(value)) & ok, value

    def boolean(self):
        return self._read("boolean", "boolean")

    def binary(self):
        return self._read("byte[]", "binary")

    def integer(self):
        """(right kind, value as decimal(38,0) or null where out of it, whether it is out of that range)."""
        if self.name != "number" or isinstance(self.dtype, T.DecimalType) and self.dtype.scale > 0:
            return F.lit(False), F.lit(None).cast("decimal(38,0)"), F.lit(False)
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            whole = (self.column == F.floor(self.column.cast("double")).cast("double")) & ~F.isnan(self.column) & (F.abs(self.column) != float("inf"))
            whole = (F.rint(self.column.cast("double")) == self.column) & (F.abs(self.column) < float("inf")) & ~F.isnan(self.column)
            value = self.column.try_cast("decimal(38,0)")
            return whole, value, whole & value.isNull()
        if isinstance(self.dtype, T.DecimalType):
            return F.lit(True), self.column.cast("decimal(38,0)"), F.lit(False)
        return F.lit(True), self.column.cast("long"), F.lit(False)

    def floating(self, kind: str):
        if self.name != "number":
            return F.lit(False), F.lit(None).cast(kind)
        if isinstance(self.dtype, T.DecimalType):
            return F.lit(True), self.column.cast("string").cast(kind)
        return F.lit(True), self.column.cast(kind)

    def number_text(self):
        """A number as written; doubles by their shortest digits, not finite ones are no numbers."""
        if self.name != "number":
            return F.lit(False), F.lit(None).cast("string")
        text = self.column.cast("string")
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            text = F.regexp_replace(shortest(self.column, self.dtype.typeName()), r"\.0(?=E|$)", "")
            return (F.abs(self.column) < float("inf")) & ~F.isnan(self.column), text
        return F.lit(True), text

    def decimal_parts(self) -> Column | None:
        """struct(neg, digits, scale) of a decimal or whole column, without a grammar; None for other types."""
        scale = self.dtype.scale if isinstance(self.dtype, T.DecimalType) else 0
        if self.name != "number" or isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            return None
        digits = F.ltrim(F.replace(F.abs(self.column.cast(f"decimal(38,{scale})")).cast("string"), F.lit("."), F.lit("")), F.lit("0"))
        return F.when(self.column.isNotNull(), F.struct((self.column < 0).alias("neg"), F.when(digits == "", "0").otherwise(digits).alias("digits"), F.lit(scale).alias("scale")))

    def elements(self):
        if self.name != "array":
            return Missing().elements()
        inner = self.dtype.elementType
        return F.lit(True), self.column, lambda x: Typed(x, inner)

    def is_object(self):
        return F.lit(self.name == "object")

    def keys(self):
        if isinstance(self.dtype, T.StructType):
            return F.array(*map(F.lit, self.dtype.names)) if self.dtype.names else Missing().keys()
        return F.map_keys(self.column) if isinstance(self.dtype, T.MapType) else Missing().keys()

    def member(self, name: str) -> Node:
        if isinstance(self.dtype, T.StructType):
            return Typed(self.column.getField(name), self.dtype[name].dataType) if name in self.dtype.names else Missing()
        if isinstance(self.dtype, T.MapType):
            return OfMap(self.column, name, self.dtype.valueType)
        return Missing()

    def entries(self):
        """(is an object, entries as structs, node of an entry); a struct's members in name order."""
        if isinstance(self.dtype, T.MapType):
            inner = self.dtype.valueType
            return F.lit(True), F.map_entries(self.column), lambda e: Typed(e.getField("value"), inner)
        if isinstance(self.dtype, T.StructType) and self.dtype.names:
            names = sorted(self.dtype.names)
            inner = self.dtype[names[0]].dataType
            made = F.array(*(F.struct(F.lit(n).alias("key"), self.column.getField(n).alias("value")) for n in names))
            return F.lit(True), made, lambda e: Typed(e.getField("value"), inner)
        ok, entries, of = Missing().entries()
        return F.lit(self.name == "object"), entries, of


class OfMap(Typed):
    """A member of a map column, missing where the map lacks the key."""

    def __init__(self, column: Column, name: str, dtype: T.DataType):
        super().__init__(F.try_element_at(column, F.lit(name)), dtype)
        self.missing = ~F.coalesce(F.map_contains_key(column, F.lit(name)), F.lit(False))
        self.null = self.null & ~self.missing
        self.kind = F.when(self.missing, F.lit("missing")).otherwise(self.kind)


def kind_of(variant: Column, lossless: bool = False) -> Column:
    """What a variant is. In lossless trees an object and a number have a tag of their own."""
    plain = F.coalesce(F.schema_of_variant(variant), F.lit("missing"))
    if not lossless:
        return plain
    tagged = lambda tag: F.try_variant_get(variant, f"$.{tag}", "variant").isNotNull()
    return F.when(tagged("o"), "OBJECT").when(tagged("n"), "NUMBER").otherwise(plain)


class Json(Node):
    """A JSON value held as a variant. Lossless trees hold a number as {"n": text} and an object as
    {"o": members}, each {"p": place, "v": value}."""

    def __init__(self, variant: Column, lossless: bool = False, kind: Column | None = None, bind: bool = True):
        """`kind`: kind_of(variant), where the caller has it already."""
        self.v, self.lossless, self.bind = variant, lossless, bind
        self.missing = variant.isNull()
        self.null = F.coalesce(F.is_variant_null(variant), F.lit(False))
        self.type = kind_of(variant, lossless) if kind is None else kind
        self.number = self.type == "NUMBER" if lossless else self.type.isin("BIGINT", "DOUBLE", "FLOAT") | self.type.startswith("DECIMAL")
        self.object = self.type.startswith("OBJECT")
        self.kind = (
            F.when(self.missing, "missing").when(self.null, "null").when(self.type == "BOOLEAN", "boolean").when(self.type == "STRING", "string")
            .when(self.number, "number").when(self.type.startswith("ARRAY"), "array").when(self.object, "object").otherwise("unknown")
        )

    def bound(self, body: Callable[[Json], Column]) -> Column:
        """`body` of this node, whose variant and kind are found once."""
        facts = let(self.v, lambda v: F.struct(v.alias("v"), kind_of(v, self.lossless).alias("type")))
        return let(facts, lambda n: body(Json(n.getField("v"), self.lossless, n.getField("type"))))

    def string(self):
        return self.type == "STRING", F.try_variant_get(self.v, "$", "string")

    def boolean(self):
        return self.type == "BOOLEAN", F.try_variant_get(self.v, "$", "boolean")

    def binary(self):
        return F.lit(False), F.lit(None).cast("binary")

    def _text(self) -> Column:
        return F.try_variant_get(self.v, "$.n" if self.lossless else "$", "string")

    def integer(self):
        if self.lossless:
            text = self._text()
            whole = self.number & text.rlike(r"\A-?[0-9]+\z")
            bare = F.regexp_replace(text, r"\A(-?)0+(?=[0-9])", "$1")
            value = F.when(F.length(bare) <= 21, bare).try_cast("decimal(38,0)")
            return whole, value, whole & value.isNull()
        value = F.try_variant_get(self.v, "$", "decimal(38,0)")
        # a short decimal without scale was written with a fraction of zeros
        long_ = (self.type.rlike(r"\ADECIMAL\([0-9]+,0\)\z") & (F.abs(value) > 9223372036854775807))
        wide = (self.type == "DOUBLE") & (F.abs(F.try_variant_get(self.v, "$", "double")) >= 1e38)
        return (self.type == "BIGINT") | long_ | wide, value, wide & value.isNull()

    def floating(self, kind: str):
        return self.number, self._text().try_cast(kind)

    def number_text(self):
        return self.number, self._text()

    def inexact(self):
        """The fast parser keeps numbers with an exponent or of more than 38 digits as doubles."""
        return F.lit(False) if self.lossless else self.type.isin("DOUBLE", "FLOAT")

    def elements(self):
        return self.type.startswith("ARRAY"), F.try_variant_get(self.v, "$", "array<variant>"), lambda x: Json(x, self.lossless, bind=self.bind)

    def is_object(self):
        return self.object

    def keys(self):
        if self.lossless:
            return F.transform(self._placed(), lambda e: e.getField("k"))
        return F.map_keys(F.try_variant_get(self.v, "$", "map<string,variant>"))

    def member(self, name: str) -> Node:
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        at = f'$.o["{quoted}"].v' if self.lossless else f'$["{quoted}"]'
        return Json(F.try_variant_get(self.v, at, "variant"), self.lossless, bind=self.bind)

    def _placed(self) -> Column:
        """Members of an object of a lossless tree as structs (place, k, value), in written order."""
        entries = F.map_entries(F.try_variant_get(self.v, "$.o", "map<string,struct<p:int,v:variant>>"))
        # variants have no order: places are sorted alone, and members looked up by them
        placed = lambda es: F.array_sort(F.transform(es, lambda e, i: F.struct(e.getField("value").getField("p").alias("p"), i.alias("i"))))
        return let(entries, lambda es: F.transform(placed(es), lambda p: F.struct(F.get(es, p.getField("i")).getField("key").alias("k"), F.get(es, p.getField("i")).getField("value").getField("v").alias("v"))))

    def entries(self):
        """In lossless trees in the order of the keys as written."""
        if self.lossless:
            made = F.transform(self._placed(), lambda e: F.struct(e.getField("k").alias("key"), e.getField("v").alias("value")))
        else:
            made = F.map_entries(F.try_variant_get(self.v, "$", "map<string,variant>"))
        return self.object, made, lambda e: Json(e.getField("value"), self.lossless, bind=self.bind)


NodeMaker = Callable[[Column], Node]
