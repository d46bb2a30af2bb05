"""Text grammars as regular expressions for the JVM, and the checks on a pattern given by a caller."""

from __future__ import annotations

import re

# Grammars of RFC 5321, 3986, 4291 and ISO 8601 profiles.
_AT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"\A(?=.{{1,254}}\z)(?=[^@]{{1,64}}@){_AT}(?:\.{_AT})*@{_LABEL}(?:\.{_LABEL})*\z"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"\A{_V4}\z"
_H = "[0-9A-Fa-f]{1,4}"
_LAST = f"(?:{_H}:{_H}|{_V4})"
_V6 = "(?:" + "|".join(
    [f"(?:{_H}:){{6}}{_LAST}", f"::(?:{_H}:){{5}}{_LAST}"]
    + [f"(?:(?:{_H}:){{0,{n}}}{_H})?::(?:{_H}:){{{4 - n}}}{_LAST}" for n in range(5)]
    + [f"(?:(?:{_H}:){{0,5}}{_H})?::{_H}", f"(?:(?:{_H}:){{0,6}}{_H})?::"]
) + ")"
_ZONED = rf"(?=[fF][eE][89abAB][0-9A-Fa-f]:|[fF]{{2}}[0-9A-Fa-f][1-9a-dA-D]:){_V6}%[^%\x00]+"
IPV6 = rf"\A(?:{_V6}|{_ZONED})\z"
IP = rf"\A(?:{_V4}|{_V6}|{_ZONED})\z"
ULID = r"\A[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}\z"
CUID = r"\Ac[0-9a-z]{24}\z"
UUID = r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"


def _chars(more: str) -> str:
    """Unreserved, sub-delimiters, `more`, or percent-encoded; possessive, so linear."""
    return rf"(?:[A-Za-z0-9\-._~!$&'()*+,;={more}]++|%[0-9A-Fa-f]{{2}})*+"


_FUTURE = r"[vV][0-9A-Fa-f]+\.[A-Za-z0-9\-._~!$&'()*+,;=:]+"
_HOST = rf"(?:\[(?:{_V6}|{_FUTURE})\]|{_chars('')})"
_AUTHORITY = rf"((?:{_chars(':')}@)?({{host}})(?::[0-9]*)?)"
_TAIL = rf"(?:\?({_chars(':@/?')}))?(?:#({_chars(':@/?')}))?\z"
#: groups: scheme, authority, host, path after an authority, path without one, query, fragment
URI = rf"\A([A-Za-z][A-Za-z0-9+.\-]*):(?://{_AUTHORITY.replace('{host}', _HOST)}(?=[/?#]|\z)({_chars(':@/')})|(?!//)({_chars(':@/')})){_TAIL}"
URL = rf"\A[hH][tT][tT][pP][sS]?://{_AUTHORITY.replace('{host}', '(?=[^/?#:])' + _HOST)}(?=[/?#]|\z){_chars(':@/')}{_TAIL}"
_SPACE = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: the same 25 characters one by one, and a character that is none of them
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_SPACE = rf"[^{_SPACE}]"
INTEGER = r"\A[+-]?[0-9]+\z"
DECIMAL = r"\A([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]+))?\z"
YEAR = r"([0-9]{4}|-(?!0000)[0-9]{4}|[+-][1-9][0-9]{4,9})"
_DATE = rf"{YEAR}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_TIME = r"([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:\.([0-9]{1,9}))?)?"
_OFFSET = r"(Z|[+-](?:(?:0[0-9]|1[0-7]):[0-5][0-9](?::[0-5][0-9])?|18:00(?::00)?))"
_SECONDS = r"(?:([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])(?:\.([0-9]{1,9}))?|(24):00:00)"
DATE, TIME = rf"\A{_DATE}\z", rf"\A{_TIME}\z"
DATE_TIME, OFFSET_DATE_TIME = rf"\A{_DATE}T{_TIME}\z", rf"\A{_DATE}T{_TIME}{_OFFSET}\z"
INSTANT = rf"\A{_DATE}T{_SECONDS}{_OFFSET}\z"

MOST_REPEATS, MOST_NESTING, MOST_STATES = 134_217_727, 200, 250_000


def checked_pattern(pattern: str) -> str:
    """A pattern of literals, classes, groups, `| * + ? {m,n}` and ASCII \\d \\w \\s, as a whole match.

    Back references, lookaround, property classes, flags and anchors are refused, as are repeats, nesting
    and states over the limits. States are counted with repeats written out: one for a literal or class, one
    for each choice or loop, and two for both ends."""
    depth, k = 0, 0
    open_, last = [0], 0  # states of the groups that are open, and of the last item
    while k < len(pattern):
        c = pattern[k]
        if c in "|*+?":
            open_[-1] += 1
        elif c == "(":
            open_.append(0)
        elif c == ")" and len(open_) > 1:
            last = open_.pop()
            open_[-1] += last
        elif c not in "){":
            last = 1
            open_[-1] += 1
        if c == "\\":
            n = pattern[k + 1 : k + 2]
            if not n or n.isalnum() and n not in "dDwWsStnrf":
                raise ValueError(f"pattern: \\{n} is not part of the pattern language")
            k += 1
        elif c == "(":
            if pattern[k + 1 : k + 2] == "?":
                if pattern[k + 1 : k + 3] != "?:":
                    raise ValueError("pattern: only plain groups are part of the pattern language")
                k += 2
            depth += 1
            if depth > MOST_NESTING:
                raise ValueError("pattern: nested too deeply")
        elif c == ")":
            depth -= 1
        elif c in "^$":
            raise ValueError("pattern: anchors are not part of the pattern language")
        elif c == "{":
            m = re.match(r"\{(\d+)(?:,(\d*))?\}", pattern[k:])
            if not m or any(int(n) > MOST_REPEATS for n in m.groups() if n):
                raise ValueError("pattern: bad repetition")
            least, open_end = int(m[1]), m[2] == ""
            most = int(m[2]) if m[2] else least
            grown = least * last + max(0, most - least) * (last + 1) + open_end
            open_[-1], last = open_[-1] - last + grown, grown
            k += m.end() - 1
        elif c == "[":
            end = k + 1 + (pattern[k + 1 : k + 2] == "^")
            while end < len(pattern) and (pattern[end] != "]" or end == k + 1):
                if pattern[end] == "\\" and pattern[end + 1 : end + 2].isalnum() and pattern[end + 1] not in "dDwWsStnrf":
                    raise ValueError("pattern: escape in a class")
                if pattern[end] == "[" or pattern[end : end + 2] == "&&":
                    raise ValueError("pattern: nested classes are not part of the pattern language")
                end += 2 if pattern[end] == "\\" else 1
            k = end
        if c in "*+?}" and pattern[k + 1 : k + 2] == "+":
            raise ValueError("pattern: possessive repeats are not part of the pattern language")
        k += 1
        if sum(open_) + 2 > MOST_STATES:
            raise ValueError(f"pattern: more than {MOST_STATES} states")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"pattern: {e}") from None
    return rf"\A(?:{pattern})\z"
