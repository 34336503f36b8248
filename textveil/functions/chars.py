"""Character classes as regular-expression text, valid in Java's and RE2's dialects alike where nothing else is said."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

#: The 29 code points that count as white space.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: All others, for Java alone: it looks at the parts of a union one by one, so the commonest come first.
SEEN = f"[!-~[^{WHITE}!-~]]"
#: White space, for Java alone: most others are told by their range.
BLANK = f"[\\x09-\\x20\\x85-\\x{{3000}}&&[{WHITE}]]"


@lru_cache(1)
def wide() -> str:
    """Code points of East Asian width wide or full, as ranges."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        is_wide = c <= sys.maxunicode and unicodedata.east_asian_width(chr(c)) in "WF"
        if is_wide and start is None:
            start = c
        elif not is_wide and start is not None:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{c - 1:x}}}")
            start = None
    return "".join(ranges)


def wide_class() -> str:
    """The class of wide characters, for Java alone: those before the first range are told by one look."""
    return f"[\\x{{1100}}-\\x{{10ffff}}&&[{wide()}]]"


def is_wide(character: str) -> bool:
    return unicodedata.east_asian_width(character) in "WF"
