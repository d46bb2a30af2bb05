"""JSON text columns: a fast reader, and a lossless one that keeps what the fast one loses. Both in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.outcome import let


def fast(text: Column) -> Column:
    """A variant by the JVM's parser, null where the text is not one JSON value. Duplicate members are
    refused; number text and member order are lost.

    The parser stops behind the first value. So the text is read as the first of an array's two elements;
    the second is a digest of the text, which nothing in the text itself can stand for."""
    seal = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))

    def whole(p: Column) -> Column:
        sealed = (F.try_variant_get(p, "$[1]", "string") == seal) & F.try_variant_get(p, "$[2]", "variant").isNull()
        return F.when(sealed, F.try_variant_get(p, "$[0]", "variant"))

    return let(pair, whole)


# The tokens of JSON. What is none is a token of its own, which the parser refuses.
STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrtu])*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
BLANK = r"[ \t\n\r]"
TOKEN = rf'{STRING}|{NUMBER}(?![^\[\]{{}}:, \t\n\r"])|[\[\]{{}}:,]|[^\[\]{{}}:, \t\n\r"]++|"'


def tokens(text: Column, blanks: bool = False) -> Column:
    """In order; without `blanks`, what parts them is passed over."""
    return F.regexp_extract_all(text, F.lit(f"{TOKEN}|{BLANK}++" if blanks else TOKEN), F.lit(0))


def is_number(x: Column) -> Column:
    return F.ascii(x).between(45, 57) & x.rlike(rf"\A{NUMBER}\z")  # - to 9: most tokens end here


def lossless(text: Column) -> Column:
    """A variant in which a number is {"n": its text} and an object {"o": members, each {"p": place, "v": value}}, so
    that digits and order stay; null where the text is not one JSON value.

    Each token is written anew by itself and its neighbours: a comma is one between members if a name and a colon
    follow. All that the rules of JSON refuse is refused in this form, too, as every bracket and colon opens
    or closes its own part of it."""
    def anew(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return (
                F.when(x == "{", '{"o":{').when(x == "}", F.when(F.get(w, i - 1) == "{", "}}").otherwise("}}}"))
                .when(x == ":", F.concat(F.lit(':{"p":'), i.cast("string"), F.lit(',"v":')))
                .when(x == ",", F.when((F.get(w, i + 2) == ":") & F.startswith(F.get(w, i + 1), F.lit('"')), "},").otherwise(","))
                .when(x == '"', "'")  # a quote without its other: nothing that is put beside it may close it
                .when(is_number(x), F.concat(F.lit('{"n":"'), x, F.lit('"}'))).otherwise(x)
            )

        return F.array_join(F.transform(w, one), " ")

    return let(let(tokens(text), anew), fast)


def place(text: Column) -> Column:
    """struct(line, column), from 1, of the first token that cannot stand where it stands, or of the end if the text ends
    too early, or else of the first member name that its object has already.

    A fold over the tokens with the open brackets as a stack. What may come next: 0 a value, 1 a value or ],
    2 a name or }, 3 a name, 4 a colon, 5 a comma, a closing bracket or the end."""
    state = lambda s, stack, at, bad: F.struct(s.cast("int").alias("s"), stack.alias("stack"), at.cast("long").alias("at"), bad.cast("long").alias("bad"))
    ok = F.lit(-1)

    def step(a: Column, x: Column) -> Column:
        s, stack, at = a["s"], a["stack"], a["at"]
        top, after = F.substring(stack, 1, 1), at + F.length(x)
        go = lambda to, st=stack: state(F.lit(to), st, after, ok)
        below = F.substring(stack, F.lit(2), F.length(stack))
        moved = (
            F.when(F.ascii(x).isin(9, 10, 13, 32), state(s, stack, after, ok))
            .when((x == ":") & (s == 4), go(0)).when((x == ",") & (s == 5), F.when(top == "[", go(0)).when(top == "{", go(3)).otherwise(state(s, stack, at, at)))
            .when((x == "{") & (s < 2), go(2, F.concat(F.lit("{"), stack))).when((x == "[") & (s < 2), go(1, F.concat(F.lit("["), stack)))
            .when((x == "}") & ((s == 2) | (s == 5) & (top == "{")), go(5, below)).when((x == "]") & ((s == 1) | (s == 5) & (top == "[")), go(5, below))
            .when((s < 2) & (_text(x) | x.isin("true", "false", "null") | is_number(x)), go(5)).when(s.isin(2, 3) & _text(x), go(4)).otherwise(state(s, stack, at, at))
        )
        return F.when(a["bad"] >= 0, a).otherwise(moved)

    def told(a: Column) -> Column:
        at = F.when(a["bad"] >= 0, a["bad"]).when((a["s"] != 5) | (a["stack"] != ""), a["at"]).otherwise(_repeat(tokens(text, True)))
        return let(F.substring(text, F.lit(1), at.cast("int")), lambda before: F.struct(
            (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column")
        ))

    return let(F.aggregate(tokens(F.coalesce(text, F.lit("")), True), state(F.lit(0), F.lit(""), F.lit(0), ok), step), told)


def _text(x: Column) -> Column:
    return x.startswith('"') & (F.length(x) > 1)


def _repeat(found: Column) -> Column:
    """How many characters come before the first name that its object has already, in a text whose brackets match;
    0 if there is none. Each open bracket has the names seen in it."""
    nothing = F.expr("cast(array() as array<string>)")
    state = lambda seen, last, at, bad: F.struct(seen.alias("seen"), last.alias("last"), at.cast("long").alias("at"), bad.cast("long").alias("bad"))

    def step(a: Column, x: Column) -> Column:
        seen, after = a["seen"], a["at"] + F.length(x)
        rest = F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(1)))
        name = F.get(F.from_json(F.concat(F.lit("["), a["last"], F.lit("]")), "array<string>"), F.lit(0))
        named = F.when(F.array_contains(F.get(seen, F.lit(0)), name), state(seen, a["last"], a["at"], a["bad"] * -1)).otherwise(
            state(F.concat(F.array(F.array_append(F.get(seen, F.lit(0)), name)), F.slice(seen, 2, F.size(seen))), F.lit(""), after, F.lit(0)))
        return (
            F.when(a["bad"] > 0, a).when(x.isin("{", "["), state(F.concat(F.array(nothing), seen), F.lit(""), after, F.lit(0)))
            .when(x.isin("}", "]"), state(rest, F.lit(""), after, F.lit(0))).when(_text(x), state(seen, x, after, -a["at"] - 1))
            .when((x == ":") & (a["last"] != ""), named).otherwise(state(seen, a["last"], after, a["bad"]))
        )

    begin = state(F.expr("cast(array() as array<array<string>>)"), F.lit(""), F.lit(0), F.lit(0))
    return F.aggregate(found, begin, step, lambda a: F.when(a["bad"] > 0, a["bad"] - 1).otherwise(0))


def ordered(text: Column) -> Column:
    """JSON text written anew as it was read: members in written order, numbers as written; null where it is not JSON."""
    def plain(x: Column) -> Column:
        said = F.to_json(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"))
        return F.when(x.startswith('"'), F.substring(said, F.lit(2), F.length(said) - 2)).otherwise(x)

    return F.when(lossless(text).isNotNull(), F.array_join(F.transform(tokens(text), plain), ""))
