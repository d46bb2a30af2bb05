"""Patterns in time linear in the text, without recursion over it.

A pattern is read to a tree when the contract is built. If at every choice the next character tells which way to
go (after stars of stars are flattened), nothing ever has to be taken back: then it runs as a regular
expression whose repeats are possessive, which the JVM's matcher runs in a loop. All others run as an automaton,
a fold over the text's characters: over a table of states if these are few enough, else over the set of
places in the pattern that the text may have come to."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import checked_pattern

TOP = 0x10FFFF
Ranges = tuple  # of (first, last) code points, rising, apart
MOST_NODES, MOST_TABLE, MOST_FOLLOW = 1_000, 1 << 17, 1_000_000


def united(ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple(map(tuple, out))


def others(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in ranges:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return tuple(out + [(at, TOP)] if at <= TOP else out)


def apart(x: Ranges, y: Ranges) -> bool:
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i][0] <= y[j][1] and y[j][0] <= x[i][1]:
            return False
        if x[i][1] < y[j][1]:
            i += 1
        else:
            j += 1
    return True


def _of(text: str) -> Ranges:
    return united((ord(c), ord(c)) for c in text)


NAMED = {"d": ((48, 57),), "w": ((48, 57), (65, 90), (95, 95), (97, 122)), "s": ((9, 13), (32, 32))}
NAMED |= {k.upper(): others(v) for k, v in NAMED.items()} | {k: _of(c) for k, c in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("f", "\f"))}
ANY = others(_of("\n\r\x85\u2028\u2029"))


@dataclass(frozen=True)
class Chars:
    of: Ranges


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    body: object
    least: int
    most: int | None  # none: no end


EMPTY = Seq(())


class Reader:
    """A checked pattern's tree."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.item()))
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    def repeated(self, item):
        bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(self.peek())
        if bounds:
            self.take()
        elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
            self.at = m.end()
            bounds = int(m[1]), (int(m[3]) if m[3] else None) if m[2] else int(m[1])
        else:
            return item
        if self.peek() == "?":  # which way is tried first is no matter for a whole match
            self.take()
        return Repeat(item, *bounds)

    def escaped(self) -> Ranges:
        c = self.take()
        return NAMED.get(c, _of(c))

    def item(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.choice()
            self.take()
            return inner
        if c == "[":
            return Chars(self.members())
        return Chars(ANY if c == "." else self.escaped() if c == "\\" else _of(c))

    def members(self) -> Ranges:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found, first = [], True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escaped() if c == "\\" else _of(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                c = self.take()
                low = ((low[0][0], (self.escaped() if c == "\\" else _of(c))[0][1]),)
            found += low
        self.take()
        return others(united(found)) if negated else united(found)


def nullable(x) -> bool:
    if isinstance(x, Chars):
        return False
    if isinstance(x, Repeat):
        return x.least == 0 or nullable(x.body)
    return (all if isinstance(x, Seq) else any)(map(nullable, x.parts))


def _alternatives(parts):
    found = tuple(p for p in parts if p != EMPTY)
    return found[0] if len(found) == 1 else Alt(found) if found else EMPTY


def starred(x):
    """A tree whose star is the star of x, and which cannot be empty unless x is nothing else."""
    if isinstance(x, Alt) or isinstance(x, Seq) and nullable(x):
        return _alternatives(map(starred, x.parts))
    if isinstance(x, Repeat) and (nullable(x) or x.most is None and x.least == 1):
        return starred(x.body)
    return x


def flattened(x):
    """The same language, without stars of what may be empty or is a star itself."""
    if isinstance(x, Chars):
        return x
    if not isinstance(x, Repeat):
        return type(x)(tuple(map(flattened, x.parts)))
    body = flattened(x.body)
    if x.most == 0:
        return EMPTY
    if x.most is None and (nullable(body) or x.least <= 1):
        inner = starred(body)
        return EMPTY if inner == EMPTY else Repeat(inner, 0 if nullable(body) else x.least, None)
    if (x.least, x.most) == (0, 1) and nullable(body) or (x.least, x.most) == (1, 1):
        return body
    return Repeat(body, x.least, x.most)


def firsts(x) -> Ranges:
    if isinstance(x, Chars):
        return x.of
    if isinstance(x, Repeat):
        return firsts(x.body) if x.most != 0 else ()
    found: list = []
    for p in x.parts:
        found += firsts(p)
        if isinstance(x, Seq) and not nullable(p):
            break
    return united(found)


def _class(ranges: Ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]" if ranges else "(?!)"


def possessive(x, behind: Ranges = (), room: list | None = None) -> str | None:
    """A regular expression that never tries a second way; none if a choice needs more than the next
    character. `behind`: what may come after x."""
    room = room if room is not None else [MOST_NODES]
    room[0] -= 1
    if room[0] < 0:
        return None
    if isinstance(x, Chars):
        return _class(x.of)
    if isinstance(x, Repeat):
        if x.most == 0:
            return ""
        own = firsts(x.body)
        if nullable(x.body) or x.most != x.least and not apart(own, behind):
            return None
        inner = possessive(x.body, united([*own, *behind]) if x.most != 1 else behind, room)
        return None if inner is None else f"(?:{inner}){{{x.least},{'' if x.most is None else x.most}}}+"
    if isinstance(x, Seq):
        made = []
        for p in reversed(x.parts):
            made.append(possessive(p, behind, room))
            if made[-1] is None:
                return None
            behind = united([*firsts(p), *behind]) if nullable(p) else firsts(p)
        return "".join(reversed(made))
    empty = [p for p in x.parts if nullable(p)]
    seen: Ranges = behind if empty else ()
    for p in x.parts:
        if not apart(firsts(p), seen):
            return None
        seen = united([*seen, *firsts(p)])
    if len(empty) > 1:
        return None
    made = [possessive(p, behind, room) for p in [*(p for p in x.parts if not nullable(p)), *empty]]
    return None if None in made else "(?:" + "|".join(made) + ")"


class Automaton:
    """Places are the characters of the pattern with repeats written out; `follow` has the places that may
    come next. Place 0 is before the text."""

    def __init__(self, tree):
        self.sets: list[Ranges] = [()]
        self.follow: list[list[int]] = [[]]
        self.edges = 0
        empty, first, last = self._add(tree)
        self._join([0], first)
        self.ends = set(last) | ({0} if empty else set())
        cuts = sorted({c for s in set(self.sets) for a, b in s for c in (a, b + 1)} | {0})
        kinds = sorted(set(self.sets))
        of: dict[tuple, int] = {}
        self.cuts = [c for c in cuts if c <= TOP]
        self.classes = [of.setdefault(tuple(any(a <= c <= b for a, b in s) for s in kinds), len(of)) for c in self.cuts]
        self.n = len(of)
        holds = {s: [k for t, k in of.items() if t[kinds.index(s)]] for s in kinds}
        self.takes = [set(holds[s]) for s in self.sets]

    def _join(self, last: list[int], first: list[int]) -> None:
        self.edges += len(last) * len(first)
        if self.edges > MOST_FOLLOW:
            raise ValueError("pattern: too many ways through its repeats")
        for p in last:
            self.follow[p] += first

    def _add(self, x) -> tuple[bool, list[int], list[int]]:
        """(may be empty, first places, last places)."""
        if isinstance(x, Chars):
            self.sets.append(x.of)
            self.follow.append([])
            return False, [len(self.sets) - 1], [len(self.sets) - 1]
        if isinstance(x, Alt):
            each = [self._add(p) for p in x.parts]
            return any(e for e, _, _ in each), [p for _, f, _ in each for p in f], [p for _, _, e in each for p in e]
        if isinstance(x, Seq):
            empty, first, last = True, [], []
            for p in x.parts:
                e, f, l = self._add(p)
                self._join(last, f)
                first = first + f if empty else first
                last = last + l if e else l
                empty = empty and e
            return empty, first, last
        return self._repeat(x)

    def _repeat(self, x: Repeat) -> tuple[bool, list[int], list[int]]:
        """Copies one behind the other; from the least-th on each may be the last, without end the last one loops."""
        empty, first, last, before = nullable(x), [], [], []
        for k in range(max(x.least, 1) if x.most is None else x.most):
            _, f, l = self._add(x.body)
            self._join(before, f)
            first = first if k else f
            last = last + l if k >= x.least or nullable(x.body) else l
            before = l
            if len(self.sets) > MOST_FOLLOW:
                raise ValueError("pattern: too many states")
        if x.most is None:
            self._join(before, f)
        return empty, first, last

    def table(self) -> tuple[list[int], list[bool]] | None:
        """States row by row, a column for each class, and which of them end; none if there are too many."""
        states, todo, rows = {frozenset([0]): 0}, [frozenset([0])], []
        work = 0
        while len(rows) < len(todo):
            here = todo[len(rows)]
            ahead: set[int] = set()
            for p in here:
                ahead.update(self.follow[p])
            by_class: list[set[int]] = [set() for _ in range(self.n)]
            for q in ahead:
                for c in self.takes[q]:
                    by_class[c].add(q)
                    work += 1
            rows.append([])
            for s in map(frozenset, by_class):
                if s not in states:
                    states[s] = len(states)
                    todo.append(s)
                rows[-1].append(states[s])
            if len(states) * self.n > MOST_TABLE or work > 20 * MOST_TABLE:
                return None
        return [s for r in rows for s in r], [bool(s & self.ends) for s in todo]


def numbers(values) -> Column:
    """An array of whole numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def class_of(c: Column, cuts: list[int], classes: list[int]) -> Column:
    """The class of a character, by its code point."""
    point = F.ascii(c)
    low = [classes[bisect_right(cuts, p) - 1] for p in range(256)]
    high = [(a, k) for a, k in zip(cuts, classes) if a >= 256]
    base = F.lit(classes[bisect_right(cuts, 256) - 1])
    if len(high) <= 12:
        late = base
        for a, k in high:
            late = F.when(point >= a, k).otherwise(late)
    else:
        at = F.size(F.filter(numbers(a for a, _ in high), lambda a: a <= point))
        late = F.when(at == 0, base).otherwise(F.get(numbers(k for _, k in high), at - 1))
    return F.when(point < 256, F.get(numbers(low), point)).otherwise(late)


def by_table(machine: Automaton, table: list[int], ends: list[bool]) -> Callable[[Column], Column]:
    def run(v: Column) -> Column:
        step = lambda s, c: F.get(numbers(table), s * machine.n + class_of(c, machine.cuts, machine.classes))
        walked = F.aggregate(F.split(v, ""), F.lit(0), step, lambda s: F.get(numbers(map(int, ends)), s) == 1)
        return F.when(v == "", F.lit(ends[0])).otherwise(walked)

    return run


def by_places(machine: Automaton) -> Callable[[Column], Column]:
    """Of every class the places that take it; a step keeps those of them that follow a place held."""
    follow = json.dumps(machine.follow)
    takes = json.dumps([[p for p in range(len(machine.sets)) if k in machine.takes[p]] for k in range(machine.n)])

    def at(text: str, k: Column) -> Column:
        return F.get(F.from_json(F.lit(text), "array<array<int>>"), k)  # a literal by the time it runs

    def run(v: Column) -> Column:
        def step(held: Column, c: Column) -> Column:
            ahead = F.flatten(F.transform(held, lambda p: at(follow, p)))
            return F.array_intersect(ahead, at(takes, class_of(c, machine.cuts, machine.classes)))

        walked = F.aggregate(F.split(v, ""), numbers([0]), step, lambda held: F.arrays_overlap(held, numbers(sorted(machine.ends) or [-1])))
        return F.when(v == "", F.lit(0 in machine.ends)).otherwise(walked)

    return run


def matcher(pattern: str) -> Callable[[Column], Column]:
    """Whether a whole text is of a pattern of the language, in time linear in the text."""
    checked_pattern(pattern)
    tree = flattened(Reader(pattern).choice())
    simple = possessive(tree)
    if simple is not None:
        return lambda v: v.rlike(rf"\A{simple}\z")
    machine = Automaton(tree)
    made = machine.table()
    return by_places(machine) if made is None else by_table(machine, *made)
