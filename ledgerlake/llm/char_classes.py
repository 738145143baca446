"""Unicode classes as explicit ranges, so that the standard ``re`` can run patterns with letters and numbers."""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# White_Space of the Unicode standard, below U+10000 (there is none above).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache
def bmp_class(major: str) -> str:
    """Ranges of the code points below U+10000 whose general category begins with ``major``."""
    out, low = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and unicodedata.category(chr(c))[0] == major
        if inside and low is None:
            low = c
        if not inside and low is not None:
            out.append(f"\\u{low:04x}-\\u{c - 1:04x}")
            low = None
    return "".join(out)


class Matcher:
    """``findall`` of a pattern with {L}, {N} (class contents) and {S} (white space): by ``re`` where every
    character is below U+10000, else by ``regex`` with the same pattern over Unicode properties."""

    def __init__(self, pattern: str):
        put = lambda l, n, s: pattern.replace("{L}", l).replace("{N}", n).replace("{S}", s)
        self.narrow = re.compile(put(bmp_class("L"), bmp_class("N"), SPACE))
        self.wide = regex.compile(put("\\p{L}", "\\p{N}", "\\p{White_Space}"))
        self.astral = re.compile("[\U00010000-\U0010ffff]")

    def findall(self, text: str) -> list[str]:
        return (self.wide if not text.isascii() and self.astral.search(text) else self.narrow).findall(text)
