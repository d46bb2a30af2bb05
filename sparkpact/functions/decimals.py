"""Exact decimals as struct(neg, digits, scale): any number of digits, a 32-bit scale of each value's own."""

from __future__ import annotations

from decimal import Decimal as Exact

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.outcome import let
from .grammar import DECIMAL

TYPE = "struct<neg:boolean,digits:string,scale:int>"


def bare(v: Column) -> Column:
    """Integer text without plus sign and leading zeros."""
    return F.regexp_replace(F.regexp_replace(v, r"\A\+", ""), r"\A(-?)0+(?=[0-9])", "$1")


def parse(v: Column) -> Column:
    """A decimal's parts; null if the text is none, or its scale leaves 32 bits. An exponent of more
    than ten digits is refused unread. The grammar is matched once; what follows can then rely on it."""
    text = F.lower(v)
    split = F.struct(F.ltrim(F.substring_index(text, "e", 1), F.lit("+-")).alias("whole"), F.when(F.contains(text, F.lit("e")), F.ltrim(F.substring_index(text, "e", -1), F.lit("+"))).alias("power"))

    def parts(p: Column) -> Column:
        point, given = F.instr(p["whole"], "."), p["power"]
        power = F.when(given.isNull(), F.lit(0)).when(F.length(F.ltrim(given, F.lit("-"))) <= 10, given.try_cast("long"))
        fraction = F.when(point > 0, F.length(p["whole"]) - point).otherwise(0).cast("long")
        return F.struct(F.ltrim(F.replace(p["whole"], F.lit("."), F.lit("")), F.lit("0")).alias("digits"), (fraction - power).alias("scale"))

    def made(p: Column) -> Column:
        zero = p["digits"] == ""
        kept = F.struct((v.startswith("-") & ~zero).alias("neg"), F.when(zero, "0").otherwise(p["digits"]).alias("digits"), p["scale"].try_cast("int").alias("scale"))
        return F.when(p["scale"].between(-(1 << 31), (1 << 31) - 1), kept)

    return F.when(v.rlike(DECIMAL), let(let(split, parts), made))


def exact(n: Exact) -> Column:
    """The parts of a given number, as `parse` gives those of a text."""
    negative, digits, power = n.as_tuple()
    text = "".join(map(str, digits)).lstrip("0") or "0"
    return F.struct(F.lit(bool(negative) and text != "0").alias("neg"), F.lit(text).alias("digits"), F.lit(-power).cast("int").alias("scale"))


def sign(d: Column) -> Column:
    return F.when(d.getField("digits") == "0", 0).when(d.getField("neg"), -1).otherwise(1)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by value; digits are compared as text, no power of ten is made."""
    def magnitude(x: Column) -> Column:
        return F.length(x.getField("digits")).cast("long") - x.getField("scale").cast("long")

    da, db = (F.rtrim(x.getField("digits"), F.lit("0")) for x in (a, b))
    larger = F.when(magnitude(a) != magnitude(b), F.signum(magnitude(a) - magnitude(b)).cast("int"))
    larger = larger.when(da > db, 1).when(da < db, -1).otherwise(0)
    sa, sb = sign(a), sign(b)
    return F.when(sa != sb, F.signum(sa - sb).cast("int")).when(sa == 0, 0).otherwise(larger * sa)


LIMB, PIECE, PIECES = 9, 6, 64  # digits of a limb and of a piece; pieces reduced at once


def long_divisible(text: Column, by: int) -> Column:
    """Whether digits are a multiple of a number of any length. The last digits are taken as limbs as they are, those before in
    pieces, each times what is left of its power of ten divided by the number: a sum that leaves as much. It is less than 2^31 times
    the number, so its leading digits tell the only quotient that can be exact, and that is multiplied back. Longer
    texts are first reduced from the front. Arrays of limbs have the lowest first."""
    base = 10**LIMB
    count = -(-len(str(by)) // LIMB)
    own = count * LIMB
    left = [pow(10, own + PIECE * i, by) for i in range(PIECES)]
    longs = lambda made: F.expr(f"array({', '.join(f'{x}L' for x in made)})")
    limb = lambda x, k: x // base**k % base
    call = F.call_function

    def sums(text: Column) -> Column:
        """Of at most own + PIECE * PIECES digits."""
        wide = F.lpad(text, own + (F.greatest(F.lit(0), F.ceil((F.length(text) - own) / PIECE)) * PIECE).cast("int"), F.lit("0"))

        def summed(t: Column) -> Column:
            ahead = F.length(t) - own
            cut = F.transform(F.sequence(F.lit(1), (ahead / PIECE).cast("int")), lambda i: F.substring(t, ahead - i * PIECE + 1, F.lit(PIECE)).cast("long"))
            kept = [F.substring(t, ahead + (count - 1 - k) * LIMB + 1, F.lit(LIMB)).cast("long") for k in range(count)]

            def total(p: Column) -> Column:
                return F.array(*(F.aggregate(F.zip_with(p, F.slice(longs(limb(x, k) for x in left), 1, F.size(p)), lambda c, r: c * r), kept[k], lambda s, x: s + x) for k in range(count)))

            return F.when(ahead > 0, let(cut, total)).otherwise(F.array(*kept))

        return let(wide, summed)

    def text_of(limbs: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))
        step = lambda s, x: F.struct(call("div", x + s["carry"], F.lit(base)).alias("carry"), F.concat(F.lpad(((x + s["carry"]) % base).cast("string"), LIMB, "0"), s["text"]).alias("text"))
        return F.aggregate(limbs, begin, step, lambda s: F.concat(s["carry"].cast("string"), s["text"]))

    def nothing_left(limbs: Column) -> Column:
        weights = F.array(*(F.lit(base**k / by) for k in range(count)))
        quotient = F.rint(F.aggregate(F.zip_with(limbs, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)).cast("long")
        begin = F.struct(F.lit(0).cast("long").alias("carry"), F.lit(True).alias("even"))
        step = lambda s, x: F.struct(call("div", x + s["carry"], F.lit(base)).alias("carry"), (s["even"] & ((x + s["carry"]) % base == 0)).alias("even"))
        return let(quotient, lambda q: F.aggregate(F.zip_with(limbs, longs(limb(by, k) for k in range(count)), lambda x, n: x - q * n), begin, step, lambda s: s["even"] & (s["carry"] == 0)))

    def short(t: Column) -> Column:
        front = F.regexp_extract_all(t, F.lit(f"[0-9]{{1,{PIECE * PIECES - LIMB - 1}}}"), F.lit(0))
        return F.when(F.length(t) <= own + PIECE * PIECES, t).otherwise(F.aggregate(front, F.lit(""), lambda s, x: text_of(sums(F.concat(s, x)))))

    return let(let(text, short), lambda t: let(sums(t), nothing_left))


def divisible(d: Column, divisor: Exact) -> Column:
    """Whether d is a multiple of the divisor, by a running remainder over its digits."""
    _, parts, power = divisor.as_tuple()
    n = int("".join(map(str, parts)))
    digits, scale = d.getField("digits"), d.getField("scale").cast("long")
    shift = -scale - power  # d / 10^power = digits * 10^shift
    while n % 10 == 0:
        n, power = n // 10, power + 1
        shift = shift - 1
    twos = fives = 0
    rest = n
    while rest % 2 == 0:
        rest, twos = rest // 2, twos + 1
    while rest % 5 == 0:
        rest, fives = rest // 5, fives + 1
    def remainder(text: Column, by: int) -> Column:
        """By the engine's own remainder where the digits fit, by a running one over pieces of them or by limbs beyond."""
        if by == 1:
            return F.lit(0)
        if by >= 1 << 59:
            long, of = F.when(long_divisible(text, by), 0).otherwise(1), F.lit(str(by)).cast("decimal(38,0)")
            return F.when(F.length(text) <= 38, text.try_cast("decimal(38,0)") % of).otherwise(long) if by < 10**36 else long
        step = len(str((1 << 62) // by)) - 1
        of, zero = F.lit(by).cast("long"), F.lit(0).cast("long")
        padded = F.lpad(text, (F.ceil(F.length(text) / step) * step).cast("int"), F.lit("0"))
        pieces = F.transform(F.sequence(F.lit(0), (F.length(padded) / step).cast("int") - 1), lambda i: F.substring(padded, i * step + 1, F.lit(step)))
        running = F.aggregate(pieces, zero, lambda s, c: (s * F.lit(10**step).cast("long") + c.cast("long")) % of)
        return F.when(F.length(text) <= 18, text.try_cast("long") % of).otherwise(running)

    # with zeros behind, factors 2 and 5 are gone after enough of them
    enough = max(twos, fives)
    few = F.greatest(F.lit(0), F.least(shift, F.lit(enough)))
    padded = F.concat(digits, F.repeat(F.lit("0"), few.cast("int")))
    # digits behind the divisor's last place have to be zeros
    cut = F.least(-shift, F.length(digits).cast("long") + 1).cast("int")
    head = F.when(cut < F.length(digits), F.substring(digits, F.lit(1), F.length(digits) - cut)).otherwise("0")
    tail = F.substring(digits, F.greatest(F.lit(1), F.length(digits) - cut + 1), F.length(digits))
    cuts = (shift < 0) & ~tail.rlike(r"\A0*\z")
    return F.when(digits == "0", True).when(cuts, False).otherwise(let(F.when(shift >= 0, padded).otherwise(head), lambda text: remainder(text, n) == 0))


def to_text(d: Column) -> Column:
    """As Java's BigDecimal.toString: an exponent where the scale is negative or the value very small."""
    digits, scale = d.getField("digits"), d.getField("scale").cast("long")
    n = F.length(digits).cast("long")
    adjusted = n - 1 - scale
    minus = F.when(d.getField("neg"), "-").otherwise("")
    plain = F.when(scale == 0, digits).when(
        n > scale, F.concat(F.substring(digits, F.lit(1), (n - scale).cast("int")), F.lit("."), F.substring(digits, (n - scale + 1).cast("int"), scale.cast("int")))
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.least(scale - n, F.lit(8)).cast("int")), digits))
    power = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n.cast("int")))).otherwise(""), F.when(adjusted != 0, F.concat(F.lit("E"), F.when(adjusted > 0, "+").otherwise(""), adjusted.cast("string"))).otherwise(""))
    return F.concat(minus, F.when((scale >= 0) & (adjusted >= -6), plain).otherwise(power))


def to_plain(d: Column) -> Column:
    """Text that a cast to decimal reads."""
    return F.concat(F.when(d.getField("neg"), "-").otherwise(""), d.getField("digits"), F.lit("E"), (-d.getField("scale").cast("long")).cast("string"))
