"""Bounded string joining: at most so many elements, characters or code points, with a choice of where to cut."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collectors import to_list

_WORD = re.compile(r"\w+(?:['’]\w+)*|\s+|[^\w\s]")


def utf16(text: str) -> int:
    """Length in 16-bit units: two for a code point beyond the basic plane."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def graphemes(text: str) -> list[str]:
    """Clusters of a code point and the marks, joiners and selectors that follow it; flags by two, line breaks as one."""
    out: list[str] = []
    flags = 0
    for c in text:
        flag = 0x1F1E6 <= ord(c) <= 0x1F1FF
        extends = unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Mc") or c in "‍️︎" or 0x1F3FB <= ord(c) <= 0x1F3FF
        if out and (extends or out[-1].endswith("‍") or out[-1] == "\r" and c == "\n" or flag and flags % 2):
            out[-1] += c
        else:
            out.append(c)
        flags = flags + 1 if flag else 0
    return out


@dataclass(frozen=True)
class Joining:
    """A joiner of strings; the limit covers prefix and suffix, and the ellipsis shows that something was cut."""

    delimiter: str = ""
    prefix: str = ""
    suffix: str = ""
    ellipsis: str = "..."
    cut: str = "grapheme"
    unit: str = "chars"
    limit: int | None = None

    def with_ellipsis(self, text: str) -> Joining:
        return replace(self, ellipsis=text)

    def wrap(self, prefix: str, suffix: str) -> Joining:
        return replace(self, prefix=prefix + self.prefix, suffix=self.suffix + suffix)

    def max_elements(self, n: int) -> Joining:
        return replace(self, limit=n, unit="elements")

    def max_chars(self, n: int) -> Joining:
        return replace(self, limit=n, unit="chars")

    def max_code_points(self, n: int) -> Joining:
        return replace(self, limit=n, unit="code_points")

    def max_graphemes(self, n: int) -> Joining:
        return replace(self, limit=n, unit="graphemes")

    def cut_anywhere(self) -> Joining:
        return replace(self, cut="anywhere")

    def cut_at_code_point(self) -> Joining:
        return replace(self, cut="code_point")

    def cut_at_grapheme(self) -> Joining:
        return replace(self, cut="grapheme")

    def cut_at_word(self) -> Joining:
        return replace(self, cut="word")

    def cut_before_delimiter(self) -> Joining:
        return replace(self, cut="before_delimiter")

    def cut_after_delimiter(self) -> Joining:
        return replace(self, cut="after_delimiter")

    def size(self, text: str) -> int:
        return {"chars": utf16, "code_points": len, "graphemes": lambda t: len(graphemes(t))}[self.unit](text)

    def _first(self, text: str, room: int, cut: str) -> str:
        """The longest beginning that fits and ends where the policy allows."""
        if cut == "word":
            parts = _WORD.findall(text)
        elif cut == "grapheme":
            parts = graphemes(text)
        else:
            parts = list(text)
        out, used = [], 0
        for p in parts:
            used += self.size(p)
            if used > room:
                break
            out.append(p)
        return "".join(out)

    def join(self, items: list[str]) -> str:
        """The joined string of a list."""
        whole = self.delimiter.join(items)
        if self.limit is None:
            return self.prefix + whole + self.suffix
        if self.unit == "elements":
            if len(items) > self.limit:
                kept = self.delimiter.join(items[: self.limit])
                whole = kept + (self.delimiter if self.limit else "") + self.ellipsis
            return self.prefix + whole + self.suffix
        room = self.limit - self.size(self.prefix) - self.size(self.suffix)
        if room <= 0:
            return self._first(self.prefix + self.suffix, self.limit, "code_point")
        if self.size(whole) <= room:
            return self.prefix + whole + self.suffix
        left = room - self.size(self.ellipsis)
        if left < 0:
            return self.prefix + self._first(self.ellipsis, room, "code_point") + self.suffix
        if self.cut in ("before_delimiter", "after_delimiter"):
            kept = ""
            for k in range(len(items)):
                one = self.delimiter.join(items[: k + 1]) + (self.delimiter if self.cut == "after_delimiter" and k + 1 < len(items) else "")
                if self.size(one) > left:
                    break
                kept = one
        else:
            kept = self._first(whole, left, self.cut)
        return self.prefix + kept + self.ellipsis + self.suffix

    def __call__(self, x: Column, at: Column) -> Column:
        """The joiner as a collector. Limits of elements and none at all stay in the engine, others cut an ordered list in Python."""
        text = F.coalesce(x.cast("string"), F.lit("null"))
        items = to_list(text, at)
        if self.limit is None or self.unit == "elements":
            joined = F.array_join(items, self.delimiter)
            if self.limit is not None:
                cut = F.concat(F.array_join(F.slice(items, 1, self.limit), self.delimiter), F.lit((self.delimiter if self.limit else "") + self.ellipsis))
                joined = F.when(F.size(items) > self.limit, cut).otherwise(joined)
            return F.concat(F.lit(self.prefix), joined, F.lit(self.suffix))
        one = F.udf(self.join, T.StringType(), useArrow=True)
        return one(items)
