"""Paths as segments, on the driver and in columns; an index is its decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Path(tuple):
    """Immutable segments: Path.of("/a~1b/0"), path.key("a"), path.index(3), str(path)."""

    @staticmethod
    def of(pointer: str) -> Path:
        """A path of JSON Pointer text; anything else is refused."""
        if pointer and not pointer.startswith("/"):
            raise ValueError("a pointer is empty or starts with /")
        for part in pointer.split("~")[1:]:
            if part[:1] not in ("0", "1"):
                raise ValueError("~ stands before 0 or 1")
        return Path(s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:])

    def key(self, name: str) -> Path:
        return Path((*self, name))

    def index(self, n: int) -> Path:
        if n < 0:
            raise ValueError("an index cannot be negative")
        return Path((*self, str(n)))

    def append(self, other: Path) -> Path:
        return Path((*self, *other))

    def is_root(self) -> bool:
        return not self

    def segments(self) -> list[str]:
        return list(self)

    def __str__(self) -> str:
        return "".join("/" + s.replace("~", "~0").replace("/", "~1") for s in self)


def segments_of(pointer: Column) -> Column:
    """array<string> of a column of JSON Pointer text."""
    parts = F.split(F.substring(pointer, F.lit(2), F.length(pointer)), "/")
    plain = F.transform(parts, lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer == "", F.expr("cast(array() as array<string>)")).otherwise(plain)
