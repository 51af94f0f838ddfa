"""Text functions for Python strings: what needs neighbours, state or a parser runs these.

A Python string may hold lone surrogates, so everything here also takes text decoded
from binary with ``surrogatepass``.
"""

from __future__ import annotations

import codecs
import functools
import re
from dataclasses import dataclass

from .. import constants as K
from . import charset as C

# The escape grammar. A string command runs to its terminator, or to the
# end of the text if it has none; a control sequence has an introducer, up to a dozen
# intermediate signs, numbers, and one final sign.
_STRING = r"(?:\x1b\]|\x9d)(?:[^\x07\x1b\x9c\x9d]*(?:\x1b\\|\x9c|\x07)|[\s\S]*\Z)"
_SEQUENCE = r"[\x1b\x9b][\[()#;?]{0,12}(?:(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-PR-TZcf-ntqry=><~])"
_ESCAPES = re.compile(f"(?:{_STRING}|{_SEQUENCE})")
_COLOUR = re.compile(r"(?:\x1b\[|\x9b)[0-9;]*m")
INTRODUCER = re.compile("[\x1b\x80-\x9f]")
_SURROGATE = re.compile("[\ud800-\udfff]")


def _spelt(error: UnicodeError) -> tuple[str, int]:
    """Half a surrogate pair where bytes spell one, else a replacement character."""
    try:
        return codecs.lookup_error("surrogatepass")(error)
    except UnicodeError:
        return "\ufffd", error.end


codecs.register_error("lustrum.spelt", _spelt)


def decoded(raw: bytes) -> str:
    """UTF-8 that may spell lone surrogates; what else is malformed is replaced, so that no bytes fail."""
    return raw.decode("utf-8", "lustrum.spelt")


def drop_escapes(text: str) -> str:
    """Escape sequences deleted until none is left: deletions may join new ones."""
    if not INTRODUCER.search(text):
        return text
    while (shorter := _ESCAPES.sub("", text)) != text:
        text = shorter
    return text


def colour_only(text: str) -> bool:
    return INTRODUCER.search(_COLOUR.sub("", text)) is None


@dataclass
class Judged:
    """A text's invisible characters: where they are, their categories, and which do work."""

    size: int
    at: list[int]
    codes: list[str]
    works: list[str | None]

    @property
    def payload(self) -> int:
        return self.works.count(None)

    @property
    def visible(self) -> int:
        return self.size - len(self.at)


def judge(text: str) -> Judged:
    at = [m.start() for m in C.invisible_pattern().finditer(text)]
    return Judged(len(text), at, [C.category(text[i]) for i in at], [_work(text, i) for i in at])


def _work(text: str, i: int) -> str | None:
    if text[i] in (C.ZWNJ, C.ZWJ):
        return "joiner" if _joins(text, i) else None
    return "style" if text[i] in (C.TEXT_STYLE, C.EMOJI_STYLE) and i and C.is_emoji_part(text[i - 1]) else None


def _joins(text: str, i: int) -> bool:
    """Whether the joiner at ``i`` shapes what stands around it."""
    if text[i] == C.ZWJ and C.is_pictograph(text[i + 1 : i + 2]):
        k = i - 1
        while k >= 0 and C.is_selector(text[k]):
            k -= 1
        if k >= 0 and C.is_emoji_part(text[k]):
            return True
    if i and C.is_virama(text[i - 1]):
        return True
    left, right = _solid(text, i, -1), _solid(text, i, 1)
    if {left, right} & {C.ZWNJ, C.ZWJ}:
        return False
    ends = [C.joining_type(ch) in ("D", "R", "L") for ch in (left, right)]
    return all(ends) if text[i] == C.ZWNJ else any(ends)


def _solid(text: str, i: int, step: int) -> str:
    """The nearest character from ``i`` on that isn't a transparent mark; none: empty."""
    k = i + step
    while 0 <= k < len(text):
        if C.joining_type(text[k]) != "T":
            return text[k]
        k += step
    return ""


def payload_count(text: str) -> int:
    return judge(text).payload


def drop_invisible(text: str) -> tuple[str, list[str]]:
    """(cleaned, categories removed). One leading byte-order mark stays."""
    if text[:1] == C.BOM:
        rest, found = drop_invisible_body(text[1:])
        return C.BOM + rest, found
    return drop_invisible_body(text)


def drop_invisible_body(text: str) -> tuple[str, list[str]]:
    j = judge(text)
    if not j.at:
        return text, []
    keep_any = j.payload < K.SCATTERED
    budget = max(K.BUDGET_FLOOR, -(-j.visible // K.VISIBLE_PER_JOINER))
    out, gone, start, last = [], set(), 0, -1
    in_cluster = kept = 0
    for i, code, work in zip(j.at, j.codes, j.works, strict=True):
        if i - last > 2:  # two visible characters in a row end a joined cluster
            in_cluster = 0
        last = i
        if keep_any and work and kept < budget and (work == "style" or in_cluster < K.CLUSTER_CAP):
            in_cluster += work == "joiner"
            kept += 1
        else:
            gone.add(code)
            out.append(text[start:i])
            start = i + 1
    return "".join(out) + text[start:], [c for c in (K.CF, K.SELECTORS, K.FILLERS) if c in gone]


@dataclass
class Layer1:
    cleaned: str
    de_ansi: str
    found: list[str]


def layer1(text: str) -> Layer1:
    """Escapes, then invisible characters, then escapes that this joined, then stray introducers."""
    de_ansi = drop_escapes(text)
    cleaned, found = drop_invisible(de_ansi)
    again = drop_escapes(cleaned) if cleaned != de_ansi else cleaned
    swept = INTRODUCER.sub("", again)
    if de_ansi != text or again != cleaned or swept != again:
        found = [*found, K.ANSI]
    return Layer1(swept, de_ansi, found)


def mend_surrogates(text: str) -> str:
    """Pairs joined, lone surrogates replaced by U+FFFD."""
    if not _SURROGATE.search(text):
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def has_lone_surrogate(text: str) -> bool:
    return mend_surrogates(text).count("\ufffd") > text.count("\ufffd")


def long_runs(text: str) -> list[tuple[int, str]]:
    """(start, run) of each run of invisible characters long enough to carry a payload."""
    return [(m.start(), m[0]) for m in _long_run().finditer(text)]


@functools.cache
def _long_run() -> re.Pattern:
    return re.compile(f"{C.invisible_pattern().pattern}{{{K.LONG_RUN},}}")


def describe_stripped(found: list[str], de_ansi: str) -> str:
    return "Stripped: " + ", ".join(K.LABELS[c] for c in found) + (K.LONG_RUN_NOTE if long_runs(de_ansi) else "") + K.HEX_DUMP_NOTE
