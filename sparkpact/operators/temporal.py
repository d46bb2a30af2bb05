"""Temporal decoders by integer arithmetic, so that nanoseconds, 24:00:00 and far years keep.

Values are structs: date (epoch_day), time (nano_of_day), date_time (epoch_day, nano_of_day), instant
(epoch_second, nano) and offset_date_time (epoch_second, nano, offset_second)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..plans.outcome import json_text, let
from .core import refuse
from .scalars import Scalar

GRAMMAR = {"date": G.DATE, "time": G.TIME, "date_time": G.DATE_TIME, "instant": G.INSTANT, "offset_date_time": G.OFFSET_DATE_TIME}
ORDER = {"date": ("epoch_day",), "time": ("nano_of_day",), "date_time": ("epoch_day", "nano_of_day")}
INSTANT = ("epoch_second", "nano")


def _div(a: Column, n: int) -> Column:
    """Floor division of whole numbers below 2^53."""
    return F.floor(a / F.lit(n)).cast("long")


def epoch_day(y: Column, m: Column, d: Column) -> Column:
    """Of values that are cheap to name again."""
    doy = _div(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 1

    def days(yy: Column) -> Column:
        return let(F.struct(yy.alias("yy"), _div(yy, 400).alias("era")), lambda a: let(
            F.struct(a.era.alias("era"), (a.yy - a.era * 400).alias("yoe")), lambda e: e.era * 146097 + e.yoe * 365 + _div(e.yoe, 4) - _div(e.yoe, 100)))

    return let(y - F.when(m <= 2, 1).otherwise(0), days) + doy - 719468


def plain_grammar(kind: str) -> str:
    """Of years 0000 to 9999."""
    return GRAMMAR[kind].replace(G.YEAR, "([0-9]{4})")


def parse(v: Column, kind: str) -> Column:
    """A text's value; null where it is no such text or no day of the calendar. Years of four digits go by
    the engine's calendar, the others by arithmetic of our own."""
    plain = F.when(v.rlike(plain_grammar(kind)), _plain(v, kind))
    return plain if kind == "time" else plain.otherwise(_far(v, kind))


def _plain(v: Column, kind: str) -> Column:
    at = 1 if kind == "time" else 12
    two = lambda k: F.substring(v, k, 2).cast("long")
    day = F.unix_date(F.substring(v, 1, 10).try_cast("date")).cast("long")
    has_seconds = F.substring(v, at + 5, 1) == ":"
    seconds = two(at) * 3600 + two(at + 3) * 60 + F.when(has_seconds, two(at + 6)).otherwise(0)
    nano = F.when(F.substring(v, at + 8, 1) == ".", F.rpad(F.regexp_extract(v, r"\.([0-9]+)", 1), 9, "0").cast("long")).otherwise(F.lit(0).cast("long"))
    mark = lambda back: F.substring(v, -back, 1)
    part = lambda back: F.substring(v, -back, 2).cast("long")
    signed = lambda back, of: F.when(mark(back) == "-", -of).otherwise(of)
    shift = F.when(v.endswith("Z"), F.lit(0).cast("long")).when(mark(6).isin("+", "-"), signed(6, part(5) * 3600 + part(2) * 60)).otherwise(signed(9, part(8) * 3600 + part(5) * 60 + part(2)))
    fields = {
        "date": [day.alias("epoch_day")], "time": [(seconds * 1_000_000_000 + nano).alias("nano_of_day")],
        "date_time": [day.alias("epoch_day"), (seconds * 1_000_000_000 + nano).alias("nano_of_day")],
        "instant": [(day * 86400 + seconds - shift).alias("epoch_second"), nano.cast("int").alias("nano")],
        "offset_date_time": [(day * 86400 + seconds - shift).alias("epoch_second"), nano.cast("int").alias("nano"), shift.cast("int").alias("offset_second")],
    }[kind]
    made = F.struct(*fields)
    return made if kind == "time" else F.when(day.isNotNull(), made)


def _far(v: Column, kind: str) -> Column:
    grammar = GRAMMAR[kind]
    count = {"date": 3, "time": 4, "date_time": 7, "instant": 9, "offset_date_time": 8}[kind]
    return let(v, lambda text: let(F.struct(text.rlike(grammar).alias("ok"), *(F.regexp_extract(text, grammar, k + 1).alias(f"g{k}") for k in range(count))), lambda g: _value(g, kind)))


def _value(groups: Column, kind: str) -> Column:
    def number(k: int) -> Column:
        return F.coalesce(F.regexp_replace(groups.getField(f"g{k}"), r"\A\+", "").try_cast("long"), F.lit(0).cast("long"))

    at = 0 if kind == "time" else 3
    pieces = []
    if kind != "time":
        pieces += [number(k).alias(n) for k, n in enumerate("ymd")]
    if kind != "date":
        hour = number(at) + (number(at + 4) if kind == "instant" else 0)
        nano = F.coalesce(F.rpad(groups.getField(f"g{at + 3}"), 9, "0").try_cast("long"), F.lit(0).cast("long"))
        pieces += [(hour * 3600 + number(at + 1) * 60 + number(at + 2)).alias("seconds"), nano.alias("nano")]
    if kind in ("instant", "offset_date_time"):
        offset = groups.getField(f"g{at + (5 if kind == 'instant' else 4)}")
        part = lambda k: F.coalesce(F.regexp_extract(offset, r"\A[+-](\d\d):(\d\d)(?::(\d\d))?", k).try_cast("long"), F.lit(0).cast("long"))
        pieces.append(((part(1) * 3600 + part(2) * 60 + part(3)) * F.when(offset.startswith("-"), -1).otherwise(1)).alias("shift"))

    def made(p: Column) -> Column:
        ok = groups.getField("ok")
        fields = []
        if kind != "time":
            leap = (p.y % 4 == 0) & ((p.y % 100 != 0) | (p.y % 400 == 0))
            last = F.when(p.m == 2, F.when(leap, 29).otherwise(28)).when(p.m.isin(4, 6, 9, 11), 30).otherwise(31)
            ok = ok & (p.d <= last)
            day = epoch_day(p.y, p.m, p.d)
            if kind in ("date", "date_time"):
                fields.append(day.alias("epoch_day"))
        if kind in ("time", "date_time"):
            fields.append((p.seconds * 1_000_000_000 + p.nano).alias("nano_of_day"))
        if kind in ("instant", "offset_date_time"):
            fields += [(day * 86400 + p.seconds - p.shift).alias("epoch_second"), p.nano.cast("int").alias("nano")]
        if kind == "offset_date_time":
            fields.append(p.shift.cast("int").alias("offset_second"))
        return F.when(ok, F.struct(*fields))

    return let(F.struct(*pieces), made)


def civil(day: Column) -> Column:
    """struct(y, m, d) of an epoch day."""
    def era(a: Column) -> Column:
        return F.struct(a.era.alias("era"), (a.z - a.era * 146097).alias("doe"))

    def year(b: Column) -> Column:
        return F.struct(b.era.alias("era"), b.doe.alias("doe"), _div(b.doe - _div(b.doe, 1460) + _div(b.doe, 36524) - _div(b.doe, 146096), 365).alias("yoe"))

    def in_year(c: Column) -> Column:
        return F.struct((c.yoe + c.era * 400).alias("y"), (c.doe - (365 * c.yoe + _div(c.yoe, 4) - _div(c.yoe, 100))).alias("doy"))

    def month(d: Column) -> Column:
        return F.struct(d.y.alias("y"), d.doy.alias("doy"), _div(5 * d.doy + 2, 153).alias("mp"))

    def whole(e: Column) -> Column:
        m = e.mp + F.when(e.mp < 10, 3).otherwise(-9)
        return F.struct((e.y + F.when(m <= 2, 1).otherwise(0)).alias("y"), m.alias("m"), (e.doy - _div(153 * e.mp + 2, 5) + 1).alias("d"))

    start = let(day + 719468, lambda z: F.struct(z.alias("z"), _div(z, 146097).alias("era")))
    return let(start, lambda a: let(era(a), lambda b: let(year(b), lambda c: let(in_year(c), lambda d: let(month(d), whole)))))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def date_text(day: Column) -> Column:
    """Years 0000 to 9999 by the engine's calendar."""
    plain = F.when(day.between(-719_528, 2_932_896), F.date_from_unix_date(day.cast("int")).cast("string"))
    return plain.otherwise(let(civil(day), lambda c: _date_text(c.y, c.m, c.d)))


def _date_text(y: Column, m: Column, d: Column) -> Column:
    year = F.when(F.abs(y) > 9999, F.concat(F.when(y > 0, "+").otherwise("-"), F.abs(y).cast("string"))).otherwise(F.concat(F.when(y < 0, "-").otherwise(""), F.lpad(F.abs(y).cast("string"), 4, "0")))
    return F.concat(year, F.lit("-"), _two(m), F.lit("-"), _two(d))


def time_text(nanos: Column, seconds: str = "short") -> Column:
    """HH:mm[:ss[.fraction]]: `short` leaves seconds out where they and the fraction are zero; a
    fraction has 3, 6 or 9 digits."""
    parts = let(nanos, lambda n: F.struct(_div(n, 1_000_000_000).alias("second"), (n % 1_000_000_000).alias("nano")))
    return let(parts, lambda p: _time_text(p.second, p.nano, seconds))


def _time_text(second: Column, nano: Column, seconds: str) -> Column:
    fraction = F.lpad(nano.cast("string"), 9, "0")
    cut = F.when(nano == 0, "").when(nano % 1_000_000 == 0, F.substring(fraction, 1, 3)).when(nano % 1000 == 0, F.substring(fraction, 1, 6)).otherwise(fraction)
    tail = F.concat(F.lit(":"), _two(second % 60), F.when(nano == 0, "").otherwise(F.concat(F.lit("."), cut)))
    if seconds == "short":
        tail = F.when((second % 60 == 0) & (nano == 0), "").otherwise(tail)
    return F.concat(_two(_div(second, 3600)), F.lit(":"), _two(_div(second, 60) % 60), tail)


def offset_text(shift: Column) -> Column:
    a = F.abs(shift)
    return F.when(shift == 0, "Z").otherwise(F.concat(F.when(shift < 0, "-").otherwise("+"), _two(_div(a, 3600)), F.lit(":"), _two(_div(a, 60) % 60), F.when(a % 60 == 0, "").otherwise(F.concat(F.lit(":"), _two(a % 60)))))


def to_text(v: Column, kind: str, seconds: str | None = None) -> Column:
    """As Java's toString writes it."""
    if kind == "date":
        return date_text(v.getField("epoch_day"))
    if kind == "time":
        return time_text(v.getField("nano_of_day"), seconds or "short")
    if kind == "date_time":
        return F.concat(date_text(v.getField("epoch_day")), F.lit("T"), time_text(v.getField("nano_of_day"), seconds or "short"))
    return let(v, lambda x: _instant_text(x, kind, seconds))


def _instant_text(v: Column, kind: str, seconds: str | None) -> Column:
    shift = v.getField("offset_second").cast("long") if kind == "offset_date_time" else F.lit(0).cast("long")
    local = v.getField("epoch_second") + shift
    day = _div(local, 86400)
    nanos = F.pmod(local, F.lit(86400)) * 1_000_000_000 + v.getField("nano").cast("long")
    return F.concat(date_text(day), F.lit("T"), time_text(nanos, seconds or ("full" if kind == "instant" else "short")), offset_text(shift))


class Temporal(Scalar):
    """Compared by the value: an offset date-time by its instant."""

    kind: str

    def _order(self, v: Column) -> Column:
        return F.struct(*(v.getField(n).alias(n) for n in ORDER.get(self.kind, INSTANT)))

    def _bound(self, text: str) -> tuple[str, tuple, Callable[[], Column]]:
        """The bound as written, its value, and the value as a column; all known when the plan is made."""
        value = value_of(text, self.kind)
        refuse(value is None, f"{text} is no {self.kind}")
        kinds = {"date": ("long",), "time": ("long",), "date_time": ("long", "long")}.get(self.kind, ("long", "int"))
        return text, value, lambda: F.struct(*(F.lit(x).cast(k).alias(n) for x, k, n in zip(value, kinds, ORDER.get(self.kind, INSTANT))))

    def _limit(self, name: str, ok: Callable[[Column], Column], meta: dict):
        # bound, so that a text is parsed once for each
        told = lambda v: meta | {"actual": let(v, lambda x: json_text(to_text(x, self.kind, "full")))}
        return self._check(lambda v: let(v, lambda x: ok(self._order(x))), "out_of_range", told, f"out_of_range.{name}")

    def before(self, text: str):
        text, _, b = self._bound(text)
        return self._limit("before", lambda v: v < b(), {"before": text})

    def after(self, text: str):
        text, _, b = self._bound(text)
        return self._limit("after", lambda v: v > b(), {"after": text})

    def between(self, low: str, high: str):
        (a, first, lo), (b, last, hi) = self._bound(low), self._bound(high)
        refuse(first > last, "the range is empty")
        return self._limit("between", lambda v: (v >= lo()) & (v <= hi()), {"from": a, "to": b})


def value_of(text: str, kind: str) -> tuple | None:
    """What orders a bound, on the driver: the fields of ORDER or INSTANT; None if it is no such text."""
    m = re.match(GRAMMAR[kind].replace(r"\z", r"\Z"), text)
    if not m:
        return None
    g = list(m.groups())
    day = 0
    if kind != "time":
        y, month, d = int(g[0]), int(g[1]), int(g[2])
        whole, year = divmod(y, 400)  # the calendar repeats after 400 years of 146,097 days
        try:
            day = (datetime.date(year + 400, month, d) - datetime.date(1970, 1, 1)).days + (whole - 1) * 146_097
        except ValueError:
            return None
        g = g[3:]
    if kind == "date":
        return (day,)
    seconds = int(g[0] or 0) * 3600 + int(g[1] or 0) * 60 + int(g[2] or 0)
    nano = int((g[3] or "0").ljust(9, "0"))
    if kind == "instant" and g[4]:
        seconds = 86400
    if kind in ("time", "date_time"):
        nanos = seconds * 1_000_000_000 + nano
        return (nanos,) if kind == "time" else (day, nanos)
    shift = re.match(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", g[-1])
    off = 0 if not shift else (int(shift[2]) * 3600 + int(shift[3]) * 60 + int(shift[4] or 0)) * (-1 if shift[1] == "-" else 1)
    return day * 86400 + seconds - off, nano


def valid(v: Column, kind: str) -> Column:
    """Whether parse finds a value, without making it."""
    if kind == "time":
        return v.rlike(GRAMMAR[kind])
    day = F.unix_date(F.substring(v, 1, 10).try_cast("date"))
    return F.when(v.rlike(plain_grammar(kind)), day.isNotNull()).otherwise(v.rlike(GRAMMAR[kind]) & _far(v, kind).isNotNull())


def conversion(source: Scalar, kind: str) -> Temporal:
    made = source._check(lambda v: valid(v, kind), "invalid_format", None, f"invalid_format.{kind}")
    made = made._change(lambda v: parse(v, kind), Temporal)
    made.kind = kind
    return made
