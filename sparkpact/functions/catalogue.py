"""Message catalogues: templates by message key, layered, with interpolation."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

# The English templates, in the properties format.
ENGLISH_TEXT = """
required=is required
blank=must not be blank
too_short=must be at least {min} characters
too_long=must be at most {max} characters
invalid_length=must be exactly {expected} characters
out_of_range=must be between {min} and {max}
out_of_range.minimum=must be at least {min}
out_of_range.maximum=must be at most {max}
out_of_range.range=must be between {min} and {max}
out_of_range.positive=must be positive
out_of_range.negative=must be negative
out_of_range.non_negative=must be non-negative
out_of_range.non_positive=must be non-positive
out_of_range.before=must be before {before}
out_of_range.after=must be after {after}
out_of_range.between=must be between {from} and {to}
not_multiple_of=must be a multiple of {divisor}
invalid_scale=too many decimal places (max {maxScale})
too_small=must have at least {min} elements
too_small.nonempty=must not be empty
too_big=must have at most {max} elements
invalid_size=must have exactly {expected} elements
invalid_value=must be {expected}
missing_element=must contain {expected}
missing_elements=must contain all of {expected} (missing: {missing})
duplicate_element=must not contain duplicates: {duplicates}
not_allowed=must be one of {allowed}
invalid_format=invalid format
invalid_format.email=not a valid email
invalid_format.url=not a valid URL
invalid_format.uri=not a valid URI
invalid_format.uuid=not a valid UUID
invalid_format.ip=not a valid IP address
invalid_format.ipv4=not a valid IPv4 address
invalid_format.ipv6=not a valid IPv6 address
invalid_format.ulid=not a valid ULID
invalid_format.cuid=not a valid CUID
invalid_format.starts_with=must start with "{prefix}"
invalid_format.ends_with=must end with "{suffix}"
invalid_format.includes=must include "{substring}"
invalid_format.enum=invalid value
invalid_format.literal=invalid value
invalid_format.instant=not a valid ISO 8601 instant
invalid_format.date=not a valid ISO-8601 date (e.g., 2024-01-15)
invalid_format.time=not a valid ISO-8601 local time (e.g., 10:30 or 10:30:45)
invalid_format.date_time=not a valid ISO-8601 local date-time (e.g., 2024-01-15T10:30 or 2024-01-15T10:30:45)
invalid_format.offset_date_time=not a valid ISO-8601 offset date-time (e.g., 2024-01-15T10:30:00+09:00)
type_mismatch=expected {expected}
type_mismatch.string_keys=expected object with string keys, found {actual} key
type_mismatch.numeric_range=value is outside the {expected} range
unknown_field=unknown field
one_of_failed=no variant matched
missing_field=field is missing
"""

# The Japanese templates, in the properties format.
JAPANESE_TEXT = """
required=必須です
blank=空白は許可されていません
too_short={min}文字以上で入力してください
too_long={max}文字以内で入力してください
invalid_length={expected}文字で入力してください
out_of_range={min}以上{max}以下で入力してください
out_of_range.minimum={min}以上で入力してください
out_of_range.maximum={max}以下で入力してください
out_of_range.range={min}以上{max}以下で入力してください
out_of_range.positive=正の値で入力してください
out_of_range.negative=負の値で入力してください
out_of_range.non_negative=0以上で入力してください
out_of_range.non_positive=0以下で入力してください
out_of_range.before={before}より前で入力してください
out_of_range.after={after}より後で入力してください
out_of_range.between={from}から{to}の範囲で入力してください
not_multiple_of={divisor}の倍数で入力してください
invalid_scale=小数点以下は{maxScale}桁までです
too_small={min}個以上の要素が必要です
too_small.nonempty=空にはできません
too_big={max}個以内の要素が必要です
invalid_size={expected}個の要素が必要です
invalid_value={expected}でなければなりません
missing_element={expected}を含む必要があります
missing_elements={expected}をすべて含む必要があります（不足: {missing}）
duplicate_element=重複があります: {duplicates}
not_allowed={allowed}のいずれかで入力してください
invalid_format=形式が不正です
invalid_format.email=メールアドレスの形式が不正です
invalid_format.url=URLの形式が不正です
invalid_format.uri=URIの形式が不正です
invalid_format.uuid=UUIDの形式が不正です
invalid_format.ip=IPアドレスの形式が不正です
invalid_format.ipv4=IPv4アドレスの形式が不正です
invalid_format.ipv6=IPv6アドレスの形式が不正です
invalid_format.ulid=ULIDの形式が不正です
invalid_format.cuid=CUIDの形式が不正です
invalid_format.starts_with=「{prefix}」で始まる必要があります
invalid_format.ends_with=「{suffix}」で終わる必要があります
invalid_format.includes=「{substring}」を含む必要があります
invalid_format.enum=値が不正です
invalid_format.literal=値が不正です
invalid_format.instant=日時の形式が不正です（例: 2024-01-15T01:30:00Z）
invalid_format.date=日付の形式が不正です（例: 2024-01-15）
invalid_format.time=時刻の形式が不正です（例: 10:30 または 10:30:45）
invalid_format.date_time=日時の形式が不正です（例: 2024-01-15T10:30 または 2024-01-15T10:30:45）
invalid_format.offset_date_time=オフセット付き日時の形式が不正です（例: 2024-01-15T10:30:00+09:00）
type_mismatch={expected}型が必要です
type_mismatch.string_keys=キーがすべて文字列のオブジェクトが必要です（キーの型: {actual}）
type_mismatch.numeric_range={expected}型の範囲外の値です
unknown_field=不明なフィールドです
one_of_failed=いずれのバリアントにも一致しませんでした
missing_field=フィールドが見つかりません
"""


class PropertiesError(ValueError):
    """Malformed properties text; `line` is where the entry starts, from 1."""

    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line = line


def _logical_lines(text: str):
    """(line number, entry) with continuations joined, comments and blank lines left out."""
    lines = re.split("\r\n|\n|\r", text)
    k = 0
    while k < len(lines):
        first, entry = k + 1, lines[k].lstrip(" \t\f")
        k += 1
        if not entry or entry[0] in "#!":
            continue
        while re.search(r"(?<!\\)(?:\\\\)*\\$", entry):
            entry = entry[:-1] + (lines[k].lstrip(" \t\f") if k < len(lines) else "")
            k += 1
            if k > len(lines):
                break
        yield first, entry


def _plain(text: str, line: int) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "u":
            if len(c) != 5 or not re.fullmatch("u[0-9A-Fa-f]{4}", c):
                raise PropertiesError(line, "malformed \\uXXXX")
            return chr(int(c[1:], 16))
        return {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(c, c)

    made = re.sub(r"\\(u.{0,4}|.)", one, text, flags=re.S)
    return made.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_properties(text: str) -> dict[str, str]:
    """Entries of properties text: key and value parted by '=', ':' or white space; the last of a key
    wins. A malformed escape is a PropertiesError."""
    found: dict[str, str] = {}
    for line, entry in _logical_lines(text):
        m = re.match(r"((?:\\.|[^\\=: \t\f])*)(?:[ \t\f]*[=:][ \t\f]*|[ \t\f]+|$)(.*)", entry, re.S)
        found[_plain(m[1], line)] = _plain(m[2], line)
    return found


def java_double(v: float) -> str:
    """A double as Java's Double.toString writes it."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    sign = "-" if math.copysign(1, v) < 0 else ""
    v = abs(v)
    if v == 0:
        return sign + "0.0"
    mantissa, _, power = f"{v!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    exponent = (int(power) if power else 0) + (len(whole) - 1 if whole.strip("0") else -1 - (len(fraction) - len(fraction.lstrip("0"))))
    digits = digits.rstrip("0") or "0"
    if len(digits) == 1:  # of two digits that read back the closest is taken
        two = f"{v:.1e}"
        if float(two) == v:
            digits = two[0] + two[2] if two[2] != "0" else two[0]
            exponent = int(two.partition("e")[2])
    if 1e-3 <= v < 1e7:
        point = exponent + 1
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        digits = digits.ljust(point, "0")
        return f"{sign}{digits[:point]}.{digits[point:] or '0'}"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}E{exponent}"


def display(v) -> str:
    """A metadata value as messages write it."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return java_double(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(display, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={display(v[k])}" for k in sorted(v)) + "}"
    return str(v)


PLACE = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.-]*)\}")


def interpolate(template: str, meta: dict) -> str:
    """`template` with each {name} replaced once; names without an entry stay as written."""
    return PLACE.sub(lambda m: display(meta[m[1]]) if m[1] in meta else m[0], template)


def interpolate_fully(template: str, meta: dict) -> str | None:
    """As interpolate; None if an entry is missing."""
    return interpolate(template, meta) if all(n in meta for n in PLACE.findall(template)) else None


@dataclass(frozen=True)
class Messages:
    """Layers of templates; in each the message key is tried, then the code. A template that lacks an
    entry of the issue's metadata is passed over."""

    layers: tuple[dict[str, str], ...] = field(default_factory=tuple)

    @staticmethod
    def of(templates: dict[str, str]) -> "Messages":
        return Messages((dict(templates),))

    def template(self, key: str) -> str | None:
        return next((layer[key] for layer in self.layers if key in layer), None)

    def templates(self) -> dict[str, str]:
        return {k: v for layer in reversed(self.layers) for k, v in layer.items()}

    def falling_back_to(self, other: "Messages") -> "Messages":
        return Messages(self.layers + other.layers)

    def with_overrides(self, templates: dict[str, str]) -> "Messages":
        return Messages((dict(templates), *self.layers))

    def candidates(self, code: str, message_key: str) -> list[str]:
        """Templates in the order they are tried."""
        return [layer[k] for layer in self.layers for k in dict.fromkeys((message_key, code)) if k in layer]

    def resolve(self, code: str, message_key: str, meta: dict) -> str:
        made = (interpolate_fully(t, meta) for t in self.candidates(code, message_key))
        return next((m for m in made if m is not None), f"validation failed: {code}")


# The templates for text that is not JSON.
ENGLISH = Messages.of(parse_properties(ENGLISH_TEXT)).with_overrides({"invalid_format.json": "not valid JSON"})
JAPANESE = Messages.of(parse_properties(JAPANESE_TEXT)).with_overrides({"invalid_format.json": "JSONとして読めません"}).falling_back_to(ENGLISH)


def meta_value(text: str):
    """A metadata entry back from its JSON text."""
    return json.loads(text, parse_int=str, parse_float=str)
