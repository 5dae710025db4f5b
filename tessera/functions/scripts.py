"""Scripts and written clusters of characters, as classes of code points for patterns of either engine."""

from __future__ import annotations

import unicodedata
from functools import cache

#: Scripts by the first word of a letter's or mark's Unicode name, as they are called here; all others are OTHER.
NAMED = ("LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "THAI", "HIRAGANA", "KATAKANA", "HANGUL", "HAN")

#: First words of names that belong to no script.
NEUTRAL = {"MODIFIER", "COMBINING", "ZERO", "NO", "RIGHT", "LEFT"}

JOINER = "‍"


def script_of(c: str) -> str:
    """COMMON for digits, punctuation, symbols, blanks and neutral marks, else the script's name."""
    if unicodedata.category(c)[0] in "NPSZC":
        return "COMMON"
    first = unicodedata.name(c, "OTHER").split(" ")[0]
    first = "HAN" if first == "CJK" else first
    return "COMMON" if first in NEUTRAL else first if first in NAMED else "OTHER"


def joins_next(c: str) -> bool:
    """Whether what follows ``c`` belongs to the same written cluster: a virama, Tamil's pulli or a zero-width joiner."""
    name = unicodedata.name(c, "")
    return c == JOINER or "VIRAMA" in name or "SIGN PULLI" in name


def _ranges(points: list[int]) -> str:
    """Code points in order as the inside of a character class."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(rf"\x{{{start:X}}}-\x{{{p:X}}}" if p > start else rf"\x{{{p:X}}}")
            start = None
    return "".join(out)


@cache
def classes() -> dict[str, str]:
    """The inside of a character class for each script but OTHER, and JOINS for what joins_next holds of."""
    found: dict[str, list[int]] = {}
    for p in range(0x110000):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        found.setdefault(script_of(c), []).append(p)
        if joins_next(c):
            found.setdefault("JOINS", []).append(p)
    return {k: _ranges(v) for k, v in found.items() if k != "OTHER"}


def runs_pattern() -> str:
    """Matches every maximal run of one script; OTHER is what no class holds."""
    held = [v for k, v in sorted(classes().items()) if k != "JOINS"]
    return "|".join([*(f"[{v}]+" for v in held), f"[^{''.join(held)}]+"])
