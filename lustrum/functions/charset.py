"""Which code points are invisible, as sets, Java regex classes and neighbour rules.

Format characters come from the interpreter's Unicode tables on the driver, joining
types and pictographs from the ``regex`` module's, so that no range table is kept here.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from ..constants import CF, FILLERS, SELECTORS

#: Code points that render blank without being format characters.
FILLER_POINTS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0)
SELECTOR_RANGES = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
ZWNJ, ZWJ, TEXT_STYLE, EMOJI_STYLE, BOM = "‌", "‍", "︎", "️", "﻿"


@functools.cache
def format_points() -> frozenset[int]:
    return frozenset(i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf")


@functools.cache
def extra_points() -> frozenset[int]:
    """Invisible code points that aren't format characters."""
    return frozenset(FILLER_POINTS) | {i for a, b in SELECTOR_RANGES for i in range(a, b + 1)}


@functools.cache
def invisible_points() -> frozenset[int]:
    return format_points() | extra_points()


def _runs(points) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def java_class(points) -> str:
    """A Java regex class body of the code points."""
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in _runs(points))


def re2_class(points) -> str:
    """The same for RE2 (DuckDB)."""
    return java_class(points)


def quick(body: str) -> str:
    """A Java class of the code points in ``body``, all of them beyond U+00AC.

    Java tries the parts of a class in turn; the range in front turns most characters of
    most texts away at the first.
    """
    return rf"[\x{{AD}}-\x{{10FFFF}}&&[{body}]]"


@functools.cache
def java_classes() -> dict[str, str]:
    """Class bodies by category, in reporting order."""
    selectors = {i for a, b in SELECTOR_RANGES for i in range(a, b + 1)}
    return {CF: java_class(format_points()), SELECTORS: java_class(selectors), FILLERS: java_class(FILLER_POINTS)}


@functools.cache
def java_invisible() -> str:
    return java_class(invisible_points())


@functools.cache
def invisible_pattern() -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _runs(invisible_points())) + "]")


@functools.lru_cache(maxsize=1024)
def category(ch: str) -> str | None:
    p = ord(ch)
    if p in format_points():
        return CF
    if any(a <= p <= b for a, b in SELECTOR_RANGES):
        return SELECTORS
    return FILLERS if p in FILLER_POINTS else None


@functools.cache
def _property(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=65_536)
def joining_type(ch: str) -> str:
    """D, R, L, T, C or U: how a character joins its neighbours in cursive scripts."""
    for letter in "DRLTC":
        if ch and _property(rf"\p{{Joining_Type={letter}}}").match(ch):
            return letter
    return "U"


@functools.lru_cache(maxsize=4096)
def is_virama(ch: str) -> bool:
    return bool(ch) and _property(r"\p{Indic_Syllabic_Category=Virama}").match(ch) is not None


@functools.lru_cache(maxsize=4096)
def is_pictograph(ch: str) -> bool:
    return bool(ch) and _property(r"\p{Extended_Pictographic}").match(ch) is not None


@functools.lru_cache(maxsize=4096)
def is_emoji_part(ch: str) -> bool:
    """A pictograph, or the skin tone that may follow one."""
    return bool(ch) and _property(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}]").match(ch) is not None


def is_selector(ch: str) -> bool:
    return bool(ch) and any(a <= ord(ch) <= b for a, b in SELECTOR_RANGES)


def joining_ranges() -> list[tuple[int, int, str]]:
    """(start, end, type) of all code points that join, for range joins."""
    out: list[list] = []
    for p in range(sys.maxunicode + 1):
        if 0xD800 <= p < 0xE000:
            continue
        t = joining_type.__wrapped__(chr(p))
        if t == "U":
            continue
        if out and out[-1][1] == p - 1 and out[-1][2] == t:
            out[-1][1] = p
        else:
            out.append([p, p, t])
    return [tuple(r) for r in out]
